import itertools
import json
import unicodedata

from quillon.llm import lookalike

ENT = "entity_order long, name string, aliases_json string, look string"
CLA = "claim_order long, text string"
NAMES = ["Rosatin gel", "Rоsаtin gel", "Rosatin gel", "Ro​satin gel", "rosatin gel", "Ｒosatin gel", "Rosatin-gel", "Rosatin‑gel", "éclair", "éclair", "eclair", "Ⅳ", "IV", "", "​", "ёлка", "ёлка", "елка", "Νικη"]


def same(a, b):
    return lookalike.fold_text(a) == lookalike.fold_text(b)


def test_what_looks_the_same():
    assert same("Rosatin", "Rоsаtin") and same("éclair", "éclair") and same("ﬁn", "fin") and same("a b", "a b")
    assert same("ïle", "їle") and same("x‑y", "x-y") and same("Ａ１", "A1")
    for a, b in (("e", "é"), ("a", "A"), ("1", "l"), ("п", "n"), ("a b", "ab"), ("a–b", "a-b"), ("и", "й")):
        assert not same(a, b)


def test_fold_is_stable():
    for n in NAMES:
        once = lookalike.fold_text(n)
        assert lookalike.fold_text(once) == once
        assert unicodedata.is_normalized("NFC", once)


def brute(rows):
    out = set()
    for (i, a), (j, b) in itertools.combinations(sorted(rows), 2):
        if any(same(x, y) and x != y for x in a for y in b):
            out.add((i, j))
    return out


def test_found_equals_brute_force(spark, save):
    ents = [(i, n, json.dumps([NAMES[(i * 5) % len(NAMES)], None]) if i % 2 else (None if i % 3 else "[]"), "x") for i, n in enumerate(NAMES)]
    ents += [(100, None, None, None), (101, None, "no json", None)]
    claims = [(i, n) for i, n in enumerate(NAMES * 2)] + [(200, None), (201, "long " * 5000), (202, "lоng " * 5000)]
    save("lnote_entities", ents, ENT)
    where = save("lnote_claims", claims, CLA)
    want = {("lnote_entities", *p) for p in brute([(i, [n] + ([x for x in json.loads(a) if x is not None] if a and a.startswith("[") else [])) for i, n, a, _ in ents if n is not None])}
    want |= {("lnote_claims", *p) for p in brute([(i, [t]) for i, t in claims if t is not None])}
    assert {tuple(r) for r in lookalike.found(spark, where).collect()} == want
    forms = lookalike.canonical(spark, where).collect()
    assert all(same(r["raw"], r["canonical_form"]) for r in forms)
    by_class = {}
    for r in forms:
        by_class.setdefault((r["table_name"], lookalike.fold_text(r["raw"])), set()).add(r["canonical_form"])
    assert all(len(v) == 1 for v in by_class.values())


def test_empty(spark, save):
    save("lnote_entities", [], ENT)
    where = save("lnote_claims", [], CLA)
    assert lookalike.found(spark, where).count() == 0
    assert lookalike.canonical(spark, where).count() == 0
