"""SQL of the training-text operators that SQL can express."""

from __future__ import annotations

import unicodedata

from quillon.llm import lookalike, neardup


def folded(x: str) -> str:
    """The look-alike-mapped form in DuckDB: compatibility forms by rule (single characters and ligatures), look-alikes, invisible characters."""
    one, other, several = [], [], []
    for c in [*range(0xA0, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)]:
        to = unicodedata.normalize("NFKC", chr(c))
        if to == unicodedata.normalize("NFC", chr(c)) or "'" in to:
            continue
        if len(to) == 1:
            one.append(chr(c))
            other.append(to)
        elif 0x2000 <= c < 0x2200 or c < 0x250 or 0xFB00 <= c < 0xFB07:
            several.append((chr(c), to))
    out = f"translate({x}, '{''.join(one)}', '{''.join(other)}')"
    marks = "".join(a for a, _ in several)
    each = f"CASE WHEN regexp_matches({x}, '[{marks}]') THEN {'replace(' * len(several)}{out}{''.join(f", '{a}', '{b}')" for a, b in several)} ELSE {out} END"
    pairs = [(a, b) for a, b in lookalike.MAPPED.items() if len(a) == 1 and len(b) == 1]
    mapped = f"translate(nfc_normalize({each}), '{''.join(a for a, _ in pairs)}', '{''.join(b for _, b in pairs)}')"
    hidden = "".join(f"\\x{{{ord(c):X}}}" for c in lookalike.INVISIBLE)
    return f"CASE WHEN regexp_matches({x}, '[^\\x00-\\x7F]') THEN nfc_normalize(regexp_replace({mapped}, '[{hidden}]', '', 'g')) ELSE {x} END"


def _looks() -> str:
    aliases = """coalesce(from_json(aliases_json, '["VARCHAR"]'), [])"""
    return f"""WITH raws AS (
        SELECT DISTINCT 'lnote_entities' AS table_name, entity_order AS row_id, unnest(list_concat([name], {aliases})) AS raw FROM lnote_entities
        UNION ALL SELECT 'lnote_claims', claim_order, text FROM lnote_claims),
      looks AS (SELECT table_name, row_id, raw, {folded('raw')} AS look FROM raws WHERE raw IS NOT NULL)"""


def near_pairs() -> str:
    """Exact similarity of all pairs that share a run of words."""
    return f"""WITH w AS (SELECT section_row, regexp_extract_all(lower(coalesce(title, '') || chr(10) || coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM lnote_sections),
      s AS (SELECT DISTINCT section_row, unnest(list_transform(range(1, len(w) - {neardup.WORDS - 2}), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS run FROM w WHERE len(w) >= {neardup.WORDS}),
      n AS (SELECT section_row, count(*) AS n FROM s GROUP BY 1),
      c AS (SELECT a.section_row AS section_row_a, b.section_row AS section_row_b, count(*) AS common FROM s a JOIN s b ON a.run = b.run AND a.section_row < b.section_row GROUP BY 1, 2)
      SELECT section_row_a, section_row_b FROM c JOIN n x ON x.section_row = section_row_a JOIN n y ON y.section_row = section_row_b
      WHERE common * {neardup.THRESHOLD[1]} >= (x.n + y.n - common) * {neardup.THRESHOLD[0]}"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": near_pairs(),
        "p5_found": "SELECT section_row FROM lnote_sections WHERE length(text) > 5000",
        "p6_found": _looks() + """ SELECT DISTINCT a.table_name, a.row_id AS row_a, b.row_id AS row_b FROM looks a JOIN looks b
          ON a.table_name = b.table_name AND a.look = b.look AND a.row_id < b.row_id AND a.raw <> b.raw""",
        "p6_canonical": _looks() + """, n AS (SELECT table_name, look, raw, count(*) AS n FROM looks GROUP BY ALL),
          k AS (SELECT table_name, look, arg_min(raw, (-n, encode(raw))) AS canonical_form FROM n GROUP BY ALL)
          SELECT table_name, row_id, raw, canonical_form FROM looks JOIN k USING (table_name, look)""",
    }
