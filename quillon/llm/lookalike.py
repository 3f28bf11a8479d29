"""One consistent form for strings that look the same but differ in their characters.

Width and compatibility forms are composed (NFKC), invisible characters dropped,
spaces and hyphens unified and look-alike Greek and Cyrillic letters mapped to
Latin ones; the mapped values are grouped in SQL under the accent-sensitive
UNICODE collation, which also ignores how accents are composed. The canonical
member of a class is its most frequent string, among equals the first in byte
order, and is joined back to every row.

Defined cases: null strings and null or unreadable alias lists have no form;
empty strings form one class, with strings of invisible characters only; case,
accents, digits and other letters stay visible differences; repeated rows each
get the form.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon import runtime as rt

# Cyrillic and Greek letters and the Latin letters they look like.
LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХҮаеѕіјорсухүһԁԛԝⅼӏ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυχϲϳ",
        "ABESIJKMHOPCTYXYaesijopcyxyhdqwll" + "ABEZHIKMNOPTYXaiκvopuxcj",
        strict=True,
    )
)
LOOKALIKES["к"] = LOOKALIKES["κ"] = "κ"
HYPHENS = "‐‑‒−﹣－⁃"
SPACES = "             　"
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩ㅤ︀︁︂︃︄︅︆︇︈︉︊︋︌︍︎️﻿ﾠ"


def letter_map() -> dict[str, str]:
    """Look-alike letters and, by rule, their accented forms that have a composed Latin counterpart."""
    out = {a: b for a, b in LOOKALIKES.items() if a != b}
    for code in [*range(0x370, 0x530), *range(0x1F00, 0x2000)]:
        ch = chr(code)
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) > 1 and parts[0] in LOOKALIKES:
            composed = unicodedata.normalize("NFC", LOOKALIKES[parts[0]] + parts[1:])
            if len(composed) == 1 and composed != ch:
                out[ch] = composed
    return out


MAPPED = letter_map() | dict.fromkeys(HYPHENS, "-") | dict.fromkeys(SPACES, " ")
_TABLE = {ord(a): b for a, b in MAPPED.items()} | {ord(a): None for a in INVISIBLE}


def fold_text(s: str) -> str:
    """The look-alike-mapped form of one string, canonically composed."""
    if s.isascii():
        return s
    return unicodedata.normalize("NFC", unicodedata.normalize("NFKC", s).translate(_TABLE))


@F.pandas_udf(T.StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else fold_text(x))


def folded(raw: str) -> Column:
    """The look-alike-mapped form; Spark has no compatibility composition, so this is an Arrow UDF."""
    return _fold(F.col(raw))


def knowledge_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, row_id, raw): names and aliases of entities, texts of claims."""
    entities = rt.table(spark, sf_dir, "lnote_entities", "entity_order", "name", "aliases_json")
    claims = rt.table(spark, sf_dir, "lnote_claims", "claim_order", "text")
    aliases = F.coalesce(F.from_json("aliases_json", "array<string>"), F.array().cast("array<string>"))
    names = entities.select(
        F.lit("lnote_entities").alias("table_name"), F.col("entity_order").cast("long").alias("row_id"),
        F.explode(F.array_distinct(F.concat(F.array("name"), aliases))).alias("raw"),
    )
    texts = claims.select(F.lit("lnote_claims").alias("table_name"), F.col("claim_order").cast("long").alias("row_id"), F.col("text").alias("raw"))
    return names.unionByName(texts).where("raw is not null")


def classes(strings: DataFrame) -> DataFrame:
    """strings with `look`, the mapped form under the accent-sensitive collation that decides equality."""
    return strings.withColumn("look", F.collate(folded("raw"), "UNICODE"))


def members(strings: DataFrame) -> DataFrame:
    """(table_name, row_id, raw, look) of the rows in classes that hold more than one string, as a written table; look is one mapped form per class."""
    rows = classes(strings)
    several = strings.sparkSession.sql(
        "SELECT table_name, collate(look, 'UTF8_BINARY') AS form FROM {rows} GROUP BY table_name, look HAVING min(raw) <> max(raw)", rows=rows
    )
    several = rt.written(several, "looks")
    known = several.select("table_name", F.collate("form", "UNICODE").alias("look"), "form")
    if rt.fits_broadcast(several):
        member = rows.join(F.broadcast(known), ["table_name", "look"])
    else:
        member = rt.skew_join(rows, known, ["table_name", "look"], "inner")
    return rt.written(member.select("table_name", "row_id", "raw", F.col("form").alias("look")), "look-members")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows with strings that look the same but are not: (table_name, row_a, row_b). Large classes are compared in blocks."""
    pairs = rt.pairs_within(members(knowledge_strings(spark, sf_dir)), ["table_name", "look"], "row_id").where("x.raw <> y.raw")
    return pairs.select("table_name", F.col("x.row_id").alias("row_a"), F.col("y.row_id").alias("row_b")).distinct()


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every string with its class's canonical member: (table_name, row_id, raw, canonical_form).

    Only classes of several strings are grouped and joined back; the one string of any other class is its canonical form.
    """
    strings = knowledge_strings(spark, sf_dir)
    values = members(strings).groupBy("table_name", "look", "raw").agg(F.count(F.lit(1)).alias("n"))
    chosen = spark.sql(
        "SELECT table_name, look, min(struct(-n AS rarity, raw)).raw AS canonical_form FROM {valued} GROUP BY table_name, look", valued=values
    )
    forms = rt.written(values.join(chosen, ["table_name", "look"]).select("table_name", "raw", "canonical_form"), "look-forms")
    if rt.fits_broadcast(forms):
        rows = strings.join(F.broadcast(forms), ["table_name", "raw"], "left")
    else:
        rows = rt.skew_join(strings, forms, ["table_name", "raw"], "left")
    return rows.select("table_name", "row_id", "raw", F.coalesce("canonical_form", "raw").alias("canonical_form"))
