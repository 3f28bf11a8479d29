"""String functions of the knowledge model as Column expressions; Arrow UDFs only where Spark has no built-in."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Dashes that normalisation unifies.
DASHES = "‐‑‒–—―−"
TOKEN = r"[\p{L}\p{N}]+(?:[+./-][\p{L}\p{N}]+)*"
# Words that are no content terms of a statement.
STOP_WORDS = (
    "а без более бы был была были было в во для до его ее её и из или их к как ко ли на не но о об от по при с со так также то у что это этот эта эти "
    "the a an and or of to in on for with without is are was were be this that these those"
).split()
# Stop words and negations of claim comparison.
CLAIM_STOP_WORDS = "для при или как что это его ее их the and for with that this из на по в во к до от с со a an of to in is are".split()
NEGATIONS = "не нет нельзя запрещен запрещено without not no never contraindicated".split()
# Patterns of negation in answers and of statements about the answer itself.
NEGATION_PATTERN = (
    r"(?iu)(?:^|[^\p{L}\p{N}])(?:не|нет|без|not|no|without)(?:$|[^\p{L}\p{N}])|отсутств|не\s+выяв|не\s+обнаруж|absent"
)
META_PATTERN = (
    r"(?iu)данных недостаточно|источник(?:и|ах)? не (?:содерж|позвол)|нельзя сделать (?:надёжный )?вывод|по предоставленным источникам"
    r"|insufficient (?:data|evidence)|sources? (?:do|does) not"
)
# Words and ranges that limit whom a statement is about.
SCOPE_PATTERNS = [
    r"(?iu)(?<![\p{L}\p{N}_])(?:дети|детей|детям|детьми|детск\p{L}*|ребен\p{L}*|взросл\p{L}*|беременн\p{L}*|новорожденн\p{L}*|младенц\p{L}*)(?![\p{L}\p{N}_])",
    r"(?iu)(?<![A-Za-z0-9_])(?:children|child|adult\p{L}*|pregnan\p{L}*|newborn\p{L}*|infant\p{L}*)(?![A-Za-z0-9_])",
    r"(?iu)(?<![\p{L}\p{N}_])(?:до|старше|младше|не менее|не более)\s+\d+(?:[.,]\d+)?\s*(?:лет|год\p{L}*|месяц\p{L}*|недел\p{L}*)(?![\p{L}\p{N}_])",
    r"(?iu)(?<![A-Za-z0-9_])(?:under|over|younger than|older than|at least|at most)\s+\d+(?:[.,]\d+)?\s*(?:years?|months?|weeks?)(?![A-Za-z0-9_])",
]


def _form(name: str):
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(name, x))

    return run


_FORMS: dict[str, object] = {}


def _stable(form: str) -> str:
    """Pattern of texts that are surely in a normal form, made by rule: characters of common blocks that it keeps, no combining marks."""
    blocks = [(0x00, 0x180), (0x2B0, 0x300), (0x370, 0x530), (0x2010, 0x2060), (0x20A0, 0x20C0), (0x2190, 0x2600)]
    kept = [c for low, high in blocks for c in range(low, high) if unicodedata.normalize(form, chr(c)) == chr(c) and unicodedata.category(chr(c))[0] != "M"]
    ranges: list[list[int]] = []
    for c in kept:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "(?s)^[" + "".join(f"\\x{{{x:X}}}-\\x{{{y:X}}}" for x, y in ranges) + "]*+$"


_STABLE = {form: _stable(form) for form in ("NFKC", "NFKD")}


def compose(c: Column, form: str = "NFKC") -> Column:
    """Unicode normal form. Texts that have it already, as most have, stay in the JVM; only others are sent to Python."""
    udf = _FORMS.setdefault(form, _form(form))
    return F.coalesce(udf(F.when(~c.rlike(_STABLE[form]), c)), c)


def normalize_text(c: Column, composed: bool = False) -> Column:
    """Lower-case words: ё as е, dashes unified, everything but letters, digits and + % . / - a single space.

    composed: the text is known to be in compatibility form already, so nothing leaves the JVM.
    """
    c = c if composed else compose(c)
    c = F.regexp_replace(F.lower(c), "ё", "е")
    c = F.translate(c, DASHES, "-" * len(DASHES))
    c = F.regexp_replace(c, r"[^\p{L}\p{N}+%./-]+", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def tokenize(c: Column, composed: bool = False) -> Column:
    """Tokens of normalised text; null text has none."""
    return F.regexp_extract_all(normalize_text(F.coalesce(c, F.lit("")), composed), F.lit(TOKEN), F.lit(0))


def clean_text(c: Column) -> Column:
    """LF line ends, no blanks before them, at most one blank line, trimmed."""
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t]+\n", "\n")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")


def slugify(c: Column, fallback: str = "item", composed: bool = False) -> Column:
    c = F.regexp_replace(F.lower(c if composed else compose(c, "NFKD")), "ё", "е")
    c = F.regexp_replace(c, r"[^\p{L}\p{N}]+", "-")
    c = F.substring(F.regexp_replace(c, "^-+|-+$", ""), 1, 96)
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, fallback).otherwise(c)


def snippet_around(text: Column, terms: list[str], length: int = 260) -> Column:
    """About `length` characters from 32 % before the first term of the normalised text, with ellipses at cut ends."""
    source = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    normal = normalize_text(source)
    places = [F.when(F.locate(t, normal) > 0, F.locate(t, normal) - 1) for t in terms]
    first = F.least(*places, F.lit(None).cast("int")) if len(places) > 0 else F.lit(None).cast("int")
    start = F.greatest(F.lit(0), F.coalesce(first - int(length * 0.32), F.lit(0)))
    stop = F.least(F.length(source), start + length)
    cut = F.trim(F.substring(source, start + 1, stop - start))
    framed = F.concat(F.when(start > 0, "…").otherwise(""), cut, F.when(stop < F.length(source), "…").otherwise(""))
    return F.when(F.length(source) <= length, source).otherwise(framed)


def clip_text(c: Column, limit: int) -> Column:
    c = F.trim(c)
    return F.when(F.length(c) > limit, F.concat(F.rtrim(F.substring(c, 1, limit - 1)), F.lit("…"))).otherwise(c)


def strip_markup(c: Column) -> Column:
    """Without citations, list and heading marks and Markdown signs; spaces collapsed."""
    c = F.regexp_replace(c, r"\[S\d+\]", " ")
    c = F.regexp_replace(c, r"(?m)^\s*(?:[-*+]|\d+[.)]|#{1,6})\s+", "")
    c = F.regexp_replace(c, r"[*_`>#]", "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def citation_ids(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\[(S\d+)\]"), F.lit(1))


def split_statements(c: Column) -> Column:
    """Sentences: lines, cut after . ! ? before a capital letter or a digit."""
    lines = F.split(F.coalesce(c, F.lit("")), r"\n+")
    parts = F.flatten(F.transform(lines, lambda x: F.split(x, r"(?<=[.!?])\s+(?=[\p{Lu}\p{N}])")))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def content_terms(c: Column, composed: bool = False) -> Column:
    tokens = tokenize(strip_markup(F.coalesce(c, F.lit(""))), composed)
    long = F.filter(tokens, lambda t: (F.length(t) >= 3) & ~t.rlike(r"^\d+(?:[.,]\d+)?$"))
    return F.array_except(F.array_distinct(long), F.array(*map(F.lit, STOP_WORDS)))


def shares_stem(a: Column, b: Column) -> Column:
    """Equal first max(4, n - 2) letters, n the length of the shorter word, of at least five letters."""
    n = F.least(F.length(a), F.length(b))
    need = F.greatest(F.lit(4), n - 2)
    return (n >= 5) & (F.substring(a, F.lit(1), need) == F.substring(b, F.lit(1), need))


def coverage(statement: Column, fragment: Column, composed: bool = False) -> tuple[Column, Column]:
    """(number of content terms of the statement, number of them that a token of the fragment supports)."""
    terms, tokens = content_terms(statement, composed), F.array_distinct(tokenize(fragment, composed))
    hit = F.filter(terms, lambda t: F.exists(tokens, lambda k: (k == t) | shares_stem(t, k)))
    return F.size(terms), F.size(hit)


def support_threshold(terms: Column) -> Column:
    return F.when(terms <= 2, 0.5).when(terms <= 5, 0.6).otherwise(0.55)


def answer_negation(c: Column) -> Column:
    return F.coalesce(c.rlike(NEGATION_PATTERN), F.lit(False))


def is_meta_statement(c: Column) -> Column:
    clean = strip_markup(F.coalesce(c, F.lit("")))
    return (clean == "") | clean.rlike(r"^.{1,80}:$") | clean.rlike(META_PATTERN)


def claim_words(c: Column, composed: bool = False) -> Column:
    """Normalised text of claim comparison: lower-case words that keep % . , ° -."""
    c = F.coalesce(c, F.lit(""))
    c = F.regexp_replace(F.lower(F.trim(c if composed else compose(c))), "ё", "е")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}%.,°-]+", " "), r"\s+", " "))


def claim_tokens(c: Column, composed: bool = False) -> Column:
    words = F.filter(F.split(claim_words(c, composed), " "), lambda t: F.length(t) >= 3)
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, CLAIM_STOP_WORDS)))


def claim_negation(c: Column, composed: bool = False) -> Column:
    return F.arrays_overlap(F.split(claim_words(c, composed), " "), F.array(*map(F.lit, NEGATIONS)))


def scope_cues(c: Column, composed: bool = False) -> Column:
    """Distinct, sorted words and ranges that limit the population."""
    words = claim_words(c, composed)
    return F.array_sort(F.array_distinct(F.concat(*[F.regexp_extract_all(words, F.lit(p), F.lit(0)) for p in SCOPE_PATTERNS])))


def token_similarity(a: Column, b: Column) -> tuple[Column, Column]:
    """(shared tokens, overlap coefficient) of two token arrays."""
    shared = F.size(F.array_intersect(a, b))
    return shared, shared / F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))


def source_extension(c: Column) -> Column:
    return F.regexp_extract(F.lower(F.regexp_extract(c, r"([^/\\]*)$", 1)), r"[^.](\.[^.]+)$", 1)


def title_from_filename(c: Column) -> Column:
    name = F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r"\.[^.]+$", "")
    name = F.trim(F.regexp_replace(name, "[-_]+", " "))
    return F.when(F.coalesce(name, F.lit("")) == "", "Документ").otherwise(name)


# Extensions of office formats and of text formats, and MIME types.
OFFICE = "doc docx docm ppt pps pot pptx pptm ppsx ppsm xls xlsx xlsm xlsb odt ods odp rtf epub csv".split()
TEXTUAL = (
    "txt text md markdown mdx json jsonl ndjson xml html htm yaml yml toml ini cfg conf log sql graphql gql js mjs cjs jsx ts mts cts tsx py rs go java kt kts "
    "swift c h cc cpp cxx hpp cs rb php lua r sh bash zsh fish ps1 css scss sass less vue svelte"
).split()
MIME = {
    "pdf": "application/pdf", "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "xls": "application/vnd.ms-excel",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "odt": "application/vnd.oasis.opendocument.text",
    "rtf": "application/rtf", "epub": "application/epub+zip", "csv": "text/csv", "txt": "text/plain", "text": "text/plain", "md": "text/markdown",
    "markdown": "text/markdown", "mdx": "text/markdown", "json": "application/json", "jsonl": "application/x-ndjson", "ndjson": "application/x-ndjson",
    "xml": "application/xml", "html": "text/html", "htm": "text/html", "yaml": "application/yaml", "yml": "application/yaml", "toml": "application/toml",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml", "mp3": "audio/mpeg",
    "wav": "audio/wav", "ogg": "audio/ogg", "m4a": "audio/mp4", "mp4": "video/mp4", "webm": "video/webm", "zip": "application/zip",
    "sqlite": "application/vnd.sqlite3", "db": "application/octet-stream",
}


def source_kind(c: Column) -> Column:
    e = F.substring(source_extension(c), 2, 20)
    return F.when(e == "pdf", "pdf").when(e.isin(OFFICE), "office").when(e.isin(TEXTUAL), "text").otherwise("attachment")


def mime_type(c: Column) -> Column:
    e = F.substring(source_extension(c), 2, 20)
    table = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.coalesce(table[e], F.when(e.isin(TEXTUAL), "text/plain").otherwise("application/octet-stream"))


def stable_id(first: Column, *rest: Column, composed: bool = False) -> Column:
    """slug(first) and twelve hex digits of the SHA-256 of all parts joined by U+241F."""
    return F.concat_ws(".", slugify(first, composed=composed), F.substring(F.sha2(F.concat_ws("␟", first, *rest), 256), 1, 12))


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("␟", F.least(a, b), F.greatest(a, b))


def qualify(pack: Column, ref: Column) -> Column:
    """pack::id, unless the reference names its pack; blank references stay empty."""
    ref = F.trim(F.coalesce(ref, F.lit("")))
    return F.when((ref == "") | ref.contains("::"), ref).otherwise(F.concat_ws("::", pack, ref))


def format_cell(c: Column, limit: int = 100_000) -> Column:
    """Text of a database cell: (null) for null, clipped with an ellipsis."""
    s = c.cast("string")
    return F.when(c.isNull(), "(null)").when(F.length(s) > limit, F.concat(F.substring(s, 1, limit), F.lit("…"))).otherwise(s)


def format_blob(c: Column) -> Column:
    return F.when(c.isNull(), "(null)").otherwise(
        F.concat(F.lit("<BLOB "), F.octet_length(c).cast("string"), F.lit(" bytes sha256:"), F.sha2(c, 256), F.lit(">"))
    )


def format_bytes(c: Column) -> Column:
    units = [("GB", 1 << 30), ("MB", 1 << 20), ("KB", 1 << 10)]
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for name, size in units:
        out = out.when(c >= size, F.concat(F.format_number(c / size, 1), F.lit(f" {name}")))
    return out.otherwise(F.concat(c.cast("string"), F.lit(" B")))


def normalize_relevance(score: Column, top: Column) -> Column:
    """Whole number 0..100 of a score against the best one."""
    r = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score / top))
    value = F.floor((r * 0.72 + F.sqrt(r) * 0.28) * 100 + 0.5).cast("int")
    return F.when((score > 0) & (top > 0), F.least(F.lit(100), F.greatest(F.lit(0), value))).otherwise(0)


def fuzzy_limit(c: Column) -> Column:
    n = F.length(c)
    return F.when(n <= 3, 0).when(n <= 6, 1).when(n <= 11, 2).otherwise(3)


def osa(left: str, right: str, limit: int) -> int:
    """Optimal string alignment distance; limit + 1 once it must exceed the limit."""
    if abs(len(left) - len(right)) > limit:
        return limit + 1
    two: list[int] = []
    one = list(range(len(right) + 1))
    for i, a in enumerate(left, 1):
        row = [i]
        for j, b in enumerate(right, 1):
            best = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (a != b))
            if i > 1 and j > 1 and a == right[j - 2] and left[i - 2] == b:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        if min(row) > limit:
            return limit + 1
        two, one = one, row
    return min(one[-1], limit + 1)


@F.pandas_udf(T.IntegerType())
def osa_distance(left: pd.Series, right: pd.Series, limit: pd.Series) -> pd.Series:
    """Of normalised words; use after levenshtein(left, right) <= 2 * limit, which it implies."""
    return pd.Series([None if a is None or b is None else osa(a, b, n) for a, b, n in zip(left, right, limit, strict=True)], dtype="Int32")


def _lcs_marks(a: list[str], b: list[str]) -> tuple[list[bool], list[bool]]:
    """Which words of a and b lie on a longest common subsequence; long inputs keep common ends only."""
    ma, mb = [False] * len(a), [False] * len(b)
    if len(a) > 180 or len(b) > 180:
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            ma[k] = mb[k] = True
            k += 1
        t = 1
        while t <= min(len(a), len(b)) - k and a[-t] == b[-t]:
            ma[-t] = mb[-t] = True
            t += 1
        return ma, mb
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            size[i][j] = size[i + 1][j + 1] + 1 if a[i] == b[j] else max(size[i + 1][j], size[i][j + 1])
    i = j = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            ma[i] = mb[j] = True
            i, j = i + 1, j + 1
        elif size[i + 1][j] >= size[i][j + 1]:
            i += 1
        else:
            j += 1
    return ma, mb


def diff_words(left: str, right: str) -> tuple[list[tuple[str, bool]], list[tuple[str, bool]]]:
    """Segments (text, changed) of both sides."""
    import re

    a, b = re.findall(r"\s+|[^\s]+", left), re.findall(r"\s+|[^\s]+", right)

    def runs(words: list[str], kept: list[bool]) -> Iterator[tuple[str, bool]]:
        text, state = "", None
        for w, k in zip(words, kept, strict=True):
            if state is None or k == state:
                text += w
            else:
                yield text, not state
                text = w
            state = k
        if text:
            yield text, not state

    ma, mb = _lcs_marks(a, b)
    return list(runs(a, ma)), list(runs(b, mb))


_SEGMENTS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("changed", T.BooleanType())]))


@F.pandas_udf(T.StructType([T.StructField("left", _SEGMENTS), T.StructField("right", _SEGMENTS)]))
def text_diff(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    pairs = [diff_words(a or "", b or "") for a, b in zip(left, right, strict=True)]
    shape = lambda side: [{"text": t, "changed": c} for t, c in side]
    return pd.DataFrame({"left": [shape(p[0]) for p in pairs], "right": [shape(p[1]) for p in pairs]})


def fnv1a(s: str) -> str:
    h = 0x811C9DC5
    for ch in s:
        h = ((h ^ ord(ch)) * 0x01000193) & 0xFFFFFFFF
    return f"{h:08x}"


@F.pandas_udf(T.StringType())
def short_hash(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else fnv1a(x))


def highlight_ranges(text: Column, terms: list[str]) -> Column:
    """Merged [start, stop) ranges of the terms in the normalised text, from left to right; text in compatibility form (see compose)."""
    normal = normalize_text(text, composed=True)
    found = [
        F.transform(
            F.filter(F.sequence(F.lit(1), F.greatest(F.length(normal), F.lit(1))), _starts(normal, t)),
            _range(len(t)),
        )
        for t in terms
    ]
    every = F.array_sort(F.flatten(F.array(*found)))
    empty = F.array().cast("array<struct<start:int,stop:int>>")
    return F.aggregate(every, empty, _merge)


def _starts(normal: Column, term: str):
    return lambda i: normal.substr(i, F.lit(len(term))) == F.lit(term)


def _range(n: int):
    return lambda i: F.struct((i - 1).cast("int").alias("start"), (i - 1 + n).cast("int").alias("stop"))


def _merge(done: Column, r: Column) -> Column:
    joins = (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["stop"] >= r["start"])
    grown = F.struct(F.get(done, F.size(done) - 1)["start"].alias("start"), F.greatest(F.get(done, F.size(done) - 1)["stop"], r["stop"]).alias("stop"))
    return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(r)))
