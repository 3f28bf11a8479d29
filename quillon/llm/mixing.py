"""Mixing sources to target weights by Pareto order sampling.

The largest total T is taken at which every source can give its share with at
most max_repeats uses. A source then gives certain whole copies of all its
documents; of the tokens still due it draws documents with unequal probabilities,
in proportion to their size: lambda = min(1, theta x tokens), theta such that the
expected tokens are those due, so that documents of the largest sizes may be
certain too. Documents are ranked by (u / (1 - u)) / (lambda / (1 - lambda)) with
u a hash of seed and doc_id, and the sample is the head of the ranking whose
tokens come nearest to the tokens due. theta comes from sums per size class
(a sixteenth of an octave) and the cut of the ranking from sums per rank class
(BINS classes, and BINS within the class of the cut), so no source is sorted in
one task and no such sums reach the driver.

Defined cases: documents of no listed source, or of none, take no part; a source
without tokens, or with a null or non-positive share or max_repeats of 0, gives
nothing and does not hold T back; a null max_repeats counts as 1; documents
without tokens are in the whole copies but never drawn.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon import runtime as rt
from quillon.llm.tokens import with_tokens

#: Rank classes per source at each of two levels, and size classes per octave.
BINS, SIZE_CLASSES = 4096, 16
#: Most sources a mixture may list; the plan of a mixture is made on the driver.
MAX_SOURCES = 10_000
SEED = 20240501


@dataclass
class Share:
    source: str
    target: float
    repeats: int
    tokens: int
    whole: int = 0
    fraction: float = 0.0
    due: float = 0.0


def plan(rows: list[tuple[str, float, int, int]]) -> list[Share]:
    """Whole copies and fraction per source from (source, target_share, max_repeats, tokens)."""
    shares = [Share(s, t, r, n) for s, t, r, n in rows]
    able = [x for x in shares if x.target > 0 and x.repeats > 0 and x.tokens > 0]
    if able:
        scale = sum(x.target for x in able)
        total = min(x.repeats * x.tokens / (x.target / scale) for x in able)
        for x in able:
            due = total * x.target / scale
            x.whole = min(x.repeats, int(due / x.tokens + 1e-12))
            x.due = due - x.whole * x.tokens if x.whole < x.repeats else 0.0
            x.fraction = min(max(x.due / x.tokens, 0.0), 1.0)
    return shares


def rank(u: Column, chance: Column) -> Column:
    """Pareto ranking variable mapped to (0, 1), same order."""
    odds = (u / (1 - u)) / (chance / (1 - chance))
    return F.when((chance > 0) & (chance < 1), odds / (1 + odds)).otherwise(F.lit(0.0))


def uniform(seed: int, *keys: str) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)


def sized_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[Share]]:
    targets = rt.table(spark, sf_dir, "mix_targets", "source", "target_share", "max_repeats").where("source is not null")
    targets = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    listed = targets.limit(MAX_SOURCES + 1).collect()
    if len(listed) > MAX_SOURCES:
        raise ValueError(f"a mixture may list {MAX_SOURCES} sources")
    docs = rt.table(spark, sf_dir, "documents", F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    docs = docs.where(F.col("source").isin([r["source"] for r in listed]))
    sized = rt.written(with_tokens(docs), "source-tokens")
    tokens = dict(sized.groupBy("source").agg(F.sum("tokens")).collect())
    return sized, plan([(r["source"], r["target_share"] or 0.0, r["max_repeats"], tokens.get(r["source"]) or 0) for r in sorted(listed)])


def inclusion(sized: DataFrame, dues: DataFrame) -> DataFrame:
    """(source, theta): chances min(1, theta x tokens) of the documents have the expected tokens `due`; dues: (source, due).

    Of the size classes from the largest on, the fewest are certain that leave all others a chance of at most 1.
    """
    x = F.col("tokens").cast("double")
    sums = sized.where("tokens > 0").groupBy("source", F.floor(F.log2(x) * SIZE_CLASSES).alias("class")).agg(
        F.sum(x).alias("sum"), F.sum(x * x).alias("squares"), F.max(x).alias("most")
    )  # some hundred classes per source
    classes = sums.join(F.broadcast(dues), "source")
    larger = Window.partitionBy("source").orderBy(F.col("class").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("source").orderBy("class")
    tried = classes.withColumn("theta", (F.col("due") - F.coalesce(F.sum("sum").over(larger), F.lit(0.0))) / F.sum("squares").over(rest))
    good = tried.where((F.col("theta") > 0) & (F.col("theta") * F.col("most") <= 1))
    best = good.groupBy("source").agg(F.max_by("theta", "class").alias("theta"))
    # where even the smallest class must be partly certain, all its documents are near 1
    return dues.select("source").join(best, "source", "left").withColumn("theta", F.coalesce("theta", F.lit(1.0)))


def _cut(ranked: DataFrame, dues: DataFrame, place: Column) -> DataFrame:
    """(source, cut, rest): the rank class in which the tokens due are reached, and how many are due within it."""
    sums = ranked.groupBy("source", place.alias("cut")).agg(F.sum("tokens").alias("n"))  # at most BINS per source
    so_far = F.sum("n").over(Window.partitionBy("source").orderBy("cut"))
    reached = sums.join(F.broadcast(dues), "source").withColumn("rest", F.col("due") - (so_far - F.col("n"))).where("rest > 0")
    return reached.groupBy("source").agg(F.max("cut").alias("cut"), F.min("rest").alias("rest"))


def select(sized: DataFrame, shares: list[Share], seed: int = SEED) -> DataFrame:
    """(source, doc_id, tokens, copies) of the documents that the mixture uses."""
    spark = sized.sparkSession
    sampled = [x for x in shares if 0 < x.fraction < 1 and x.due >= 1]
    base = spark.createDataFrame([(x.source, x.whole) for x in shares if x.whole or x in sampled], "source string, whole int")
    dues = spark.createDataFrame([(x.source, float(x.due)) for x in sampled], "source string, due double")
    if not sampled:
        chosen = sized.join(F.broadcast(base), "source").where("whole > 0")
        return chosen.select("source", "doc_id", "tokens", F.col("whole").alias("copies"))
    # sides of one row per listed source, at most MAX_SOURCES
    theta = rt.written(inclusion(sized, dues), "inclusion")
    chance = F.least(F.lit(1.0), F.col("theta") * F.col("tokens"))
    ranked = sized.join(F.broadcast(base), "source").join(F.broadcast(theta), "source", "left")
    drawn = F.col("theta").isNotNull() & (F.col("tokens") > 0)
    ranked = ranked.withColumn("rank", F.when(drawn, rank(uniform(seed, "doc_id"), chance)))
    bin1 = F.least(F.floor(F.col("rank") * BINS), F.lit(BINS - 1)).cast("int")
    bin2 = F.least(F.floor((F.col("rank") * BINS - bin1) * BINS), F.lit(BINS - 1)).cast("int")
    ranked = ranked.withColumns({"bin": bin1, "part": bin2})
    one = rt.written(_cut(ranked.where("rank is not null"), dues, F.col("bin")).withColumnRenamed("cut", "cut_bin").withColumnRenamed("rest", "due"), "mixture-cut")
    near = ranked.join(F.broadcast(one.select("source", "cut_bin")), "source").where("bin = cut_bin")
    two = rt.written(_cut(near, one.select("source", "due"), F.col("part")).withColumnRenamed("cut", "cut_part"), "mixture-cut")
    cuts = one.drop("due").join(two, "source", "left")
    ranked = ranked.join(F.broadcast(cuts), "source", "left")
    below = (F.col("bin") < F.col("cut_bin")) | ((F.col("bin") == F.col("cut_bin")) & (F.col("part") < F.col("cut_part")))
    at = F.coalesce((F.col("bin") == F.col("cut_bin")) & (F.col("part") == F.col("cut_part")), F.lit(False))
    kept = ["source", "doc_id", "tokens", "whole"]
    edge = ranked.where(at)  # 1 / BINS squared of a source
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = edge.select(*kept, (before + F.col("tokens") / 2 <= F.col("rest")).alias("taken"))
    others = ranked.where(~at).select(*kept, F.coalesce(below, F.lit(False)).alias("taken"))
    both = others.unionByName(edge)
    return both.select("source", "doc_id", "tokens", (F.col("whole") + F.col("taken").cast("int")).alias("copies")).where("copies > 0")


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    return select(*sized_sources(spark, sf_dir)).select("source", "doc_id", "copies", "tokens")


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share per source."""
    sized, shares = sized_sources(spark, sf_dir)
    used = select(sized, shares).groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies")
    )
    listed = spark.createDataFrame([(x.source, x.target, x.repeats, x.tokens) for x in shares], "source string, target_share double, max_repeats int, available_tokens long")
    out = listed.join(used, "source", "left").fillna(0, ["used_tokens", "documents", "most_copies"])
    total = F.sum("used_tokens").over(Window.partitionBy(F.lit(0)))  # one row per listed source
    return out.withColumn("actual_share", F.round(F.when(total > 0, F.col("used_tokens") / total).otherwise(0.0), 9))
