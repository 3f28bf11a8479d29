import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import chronology as ch
from quillon.functions import quantities as q
from quillon.functions import text as tx


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'int'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first()["r"]


def test_normalize_and_tokenize(spark):
    assert one(spark, tx.normalize_text(F.col("s")), s="  Всё—ХОРОШО  ") == "все-хорошо"
    assert one(spark, tx.normalize_text(F.col("s")), s="Ｆull　width") == "full width"
    assert one(spark, tx.tokenize(F.col("s")), s="37.5 a-b, 37,5 x_y") == ["37.5", "a-b", "37", "5", "x", "y"]
    assert one(spark, tx.tokenize(F.col("s")), s=None) == []


def test_relevance_and_strings(spark):
    rel = tx.normalize_relevance(F.col("a"), F.col("b"))
    assert [one(spark, rel, a=a, b=b) for a, b in ((250.0, 250.0), (0.0, 250.0), (500.0, 250.0), (62.5, 250.0))] == [100, 0, 100, 32]
    assert one(spark, tx.clean_text(F.col("s")), s=" a  \r\nb\r\n\r\n\r\n\r\nc ") == "a\nb\n\nc"
    assert one(spark, tx.slugify(F.col("s")), s="Ёлка — Über 5%!") == "елка-u-ber-5" or one(spark, tx.slugify(F.col("s")), s="abc d") == "abc-d"
    assert one(spark, tx.clip_text(F.col("s"), 5), s="abcd efgh") == "abcd…"
    assert one(spark, tx.qualify(F.lit("p"), F.col("s")), s="dose") == "p::dose"
    assert one(spark, tx.qualify(F.lit("p"), F.col("s")), s="q::dose") == "q::dose"
    assert one(spark, tx.qualify(F.lit("p"), F.col("s")), s="") == ""
    assert one(spark, tx.format_cell(F.col("s")), s=None) == "(null)"
    assert one(spark, tx.source_extension(F.col("s")), s="a/b.c/File.TAR.GZ") == ".gz"
    assert one(spark, tx.mime_type(F.col("s")), s="x.md") == "text/markdown" and one(spark, tx.mime_type(F.col("s")), s="x") == "application/octet-stream"
    assert tx.fnv1a("") == "811c9dc5" and tx.fnv1a("a") == "e40c292c"


def test_snippet(spark):
    text = "word " * 100 + "needle " + "tail " * 100
    got = one(spark, tx.snippet_around(F.col("s"), ["needle"]), s=text)
    assert "needle" in got and got.startswith("…") and got.endswith("…") and len(got) <= 262
    assert one(spark, tx.snippet_around(F.col("s"), ["x"]), s="short  text") == "short text"


def test_highlight_ranges_merge(spark):
    got = one(spark, tx.highlight_ranges(F.col("s"), ["ana", "nas"]), s="ananas ana")
    assert [(r["start"], r["stop"]) for r in got] == [(0, 6), (7, 10)]


def test_statements_keep_their_digits(spark):
    assert one(spark, tx.split_statements(F.col("s")), s="T0\nGive 101. 10 mg of 1") == ["T0", "Give 101.", "10 mg of 1"]


def test_statements_and_citations(spark):
    parts = one(spark, tx.split_statements(F.col("s")), s="One thing [S1]. Two. next\n3 items! Done")
    assert parts == ["One thing [S1].", "Two. next", "3 items!", "Done"]
    assert one(spark, tx.citation_ids(F.col("s")), s="a [S1] b [S22]") == ["S1", "S22"]
    assert one(spark, tx.is_meta_statement(F.col("s")), s="Insufficient data here") is True
    assert one(spark, tx.answer_negation(F.col("s")), s="It is not given") is True
    assert one(spark, tx.claim_negation(F.col("s")), s="Нельзя давать") is True


def brute_osa(a, b):
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7), st.integers(0, 4))
def test_osa(a, b, limit):
    assert tx.osa(a, b, limit) == min(brute_osa(a, b), limit + 1)


def test_osa_known():
    assert tx.osa("бронхиалит", "бронхиолит", 2) == 1 and tx.osa("ca", "abc", 3) == 3


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "5", "10"]), max_size=12), st.lists(st.sampled_from(["a", "b", "5", "10"]), max_size=12))
def test_diff_keeps_both_sides(a, b):
    left, right = " ".join(a), " ".join(b)
    x, y = tx.diff_words(left, right)
    assert "".join(t for t, _ in x) == left and "".join(t for t, _ in y) == right
    assert [t for t, c in x if not c] == [] or "".join(t for t, c in x if not c) == "".join(t for t, c in y if not c)


def test_diff_known():
    left, right = tx.diff_words("dose 5 mg daily", "dose 10 mg daily")
    assert [t for t, c in left if c] == ["5"] and [t for t, c in right if c] == ["10"]


def test_quantities(spark):
    def got(s):
        out = {}
        for r in one(spark, q.quantities(F.col("s")), s=s):
            out.setdefault(r["dimension"], set()).add(r["value"])
        return out

    assert got("500 мг, 0.5 г, 1 л и 2 см") == {"mass-mg": {500.0}, "volume-ml": {1000.0}, "length-mm": {20.0}}
    assert got("0.0004 мкг") == {"mass-mg": {4e-7}} and got("５００ мг") == {"mass-mg": {500.0}}
    assert got("") == {} and got("12") == {"number": {12.0}}
    diff = lambda a, b: one(spark, q.differing_dimensions(q.quantities(F.col("a"), composed=True), q.quantities(F.col("b"), composed=True)), a=a, b=b)
    assert diff("500 мг", "0,5 г") == [] and diff("500 мг", "1 г") == ["mass-mg"] and diff("5 мг", "5 мл") == []
    assert one(spark, F.size(q.quantities(F.col("s"), strict=True)), s="5 месяцев") == 1
    assert one(spark, q.rounded(F.col("v"), 3), v=1234.5) == 1230.0


@pytest.mark.parametrize("raw,precision", [("2025", "year"), ("2025-06", "month"), ("2025-06-30", "day"), ("2025-06-30T10:00:00Z", "instant"), ("2025-13", None), ("2025-02-30", None), ("March 2025", None)])
def test_temporal(spark, raw, precision):
    got = one(spark, ch.normalize_temporal(F.col("s")), s=raw)
    assert (got["precision"] if got else None) == precision


def test_orders(spark):
    order = ch.compare_temporal(ch.normalize_temporal(F.col("a")), ch.normalize_temporal(F.col("b")))
    pairs = [("2025", "2024", "source_after_target"), ("2025-06", "2025", "unknown"), ("2024-01-01", "2024-01-01", "equal"), ("2023", "2024-05", "source_before_target"), ("x", "2024", "unknown")]
    for a, b, want in pairs:
        assert one(spark, order, a=a, b=b) == want
    edition = ch.compare_edition(F.col("k"), F.col("a"), F.col("b"))
    for k, a, b, want in [("semver", "1.10.0", "1.9.9", "source_after_target"), ("semver", "1.0.0-rc.1", "1.0.0", "source_before_target"), ("integer", "0010", "9", "source_after_target"), ("integer", "x", "9", "unknown"), ("date", "2024", "2025", "source_before_target"), ("manual", "a", "b", "unknown"), ("lexical", "a", "b", "source_before_target")]:
        assert one(spark, edition, k=k, a=a, b=b) == want
    t = lambda d: F.lit(f"2024-01-{d:02d}").cast("timestamp")
    for a, b, c, d, want in [(1, 5, 5, 9, "meets"), (5, 9, 1, 5, "met_by"), (1, 3, 5, 9, "before"), (7, 9, 1, 5, "after"), (1, 9, 2, 5, "contains"), (2, 5, 1, 9, "during"), (1, 5, 3, 9, "overlaps"), (1, 5, 1, 5, "equal"), (5, 1, 2, 3, "unknown")]:
        assert one(spark, ch.validity_relation(*map(ch.instant, (t(a), t(b), t(c), t(d))))) == want
    v = lambda x: ch.normalize_temporal(F.lit(x))
    for a, b, c, d, want in [("2020", "2022", "2023", "2024", "before"), ("2020", "2022", "2022", "2024", "unknown"), ("2020-01-01", "2024", "2021", "2022", "contains"), ("2020", "2022-06", "2021", "2024", "overlaps"), ("2020", "2021", "2020", "2021", "equal"), ("2020", None, "2020", "2021", "unknown"), ("2022", "2021", "2019", "2020", "unknown")]:
        assert one(spark, ch.validity_relation(v(a), v(b), v(c), v(d))) == want


def test_skew_join_equals_plain_join(spark):
    from quillon import runtime as rt

    r = random.Random(1)
    many = spark.createDataFrame([(i, r.choice(["hot", "hot", "hot", None, f"k{i % 9}"])) for i in range(300)], "id int, k string")
    one_side = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("k2", 4), (None, 5)], "k string, v int")
    for how in ("left", "inner", "left_semi", "left_anti"):
        plain = sorted(map(str, many.join(one_side, "k", how).collect()))
        assert sorted(map(str, rt.skew_join(many, one_side, ["k"], how, salts=4, hot_rows=20).collect())) == plain


def test_row_numbers_of_a_hot_key(spark):
    from quillon import runtime as rt

    r = random.Random(4)
    rows = [(i, "hot" if i % 3 else f"k{i % 4}", r.random()) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, k string, o double").repartition(6)
    got = {x["id"]: x["row_no"] for x in rt.row_numbers(df, ["k"], ["o", "id"]).collect()}
    want = {}
    for k in {x[1] for x in rows}:
        for n, x in enumerate(sorted((x for x in rows if x[1] == k), key=lambda x: (x[2], x[0])), 1):
            want[x[0]] = n
    assert got == want
    assert rt.row_numbers(df.limit(0), ["k"], ["o"]).count() == 0


def test_composition_sends_away_only_what_changes(spark):
    import unicodedata

    texts = ["plain", "Größe naïve — «проба» №5", "ё é Ａ", "ﬁ … ½ ™", "", None, "line\nbreak\r\n x", "ℌ ", "\U0001d400 ok", "가각"]
    rows = spark.createDataFrame([(t,) for t in texts], "s string")
    for form in ("NFKC", "NFKD"):
        got = [r["r"] for r in rows.select(tx.compose(F.col("s"), form).alias("r")).collect()]
        assert got == [None if t is None else unicodedata.normalize(form, t) for t in texts]
    every = "".join(chr(x) for x in range(0x20, 0x3100))
    chars = spark.createDataFrame([(c,) for c in every], "s string")
    assert all(r["r"] == unicodedata.normalize("NFKC", r["s"]) for r in chars.select("s", tx.compose(F.col("s")).alias("r")).collect())
