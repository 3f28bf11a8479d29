"""Inverted index and ranking: postings, BM25, fallback score, fuzzy correction, suggestions."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon import runtime as rt
from quillon.functions import text as tx

# Weights of the fields of a record.
FIELD_WEIGHTS = {"title": 4.5, "document_title": 3.5, "aliases": 5.0, "entity_names": 4.5, "tags": 1.4, "body": 1.0}
BM25_WEIGHTS = {"title": 4.5, "document_title": 3.5, "body": 1.0, "aliases": 5.0, "entity_names": 4.5, "tags": 1.4}
PREFIX_CAP, FUZZY_CAP = 32, 48
K1, B = 1.2, 0.75
#: Of what an index holds; an index of another version is not opened.
INDEX_VERSION = 1


def query_tokens(query: str) -> list[str]:
    """Distinct tokens of a query in order, normalised as texts are."""
    import unicodedata

    q = unicodedata.normalize("NFKC", query).lower().replace("ё", "е")
    q = q.translate({ord(c): "-" for c in tx.DASHES})
    return list(dict.fromkeys(re.findall(r"[^\W_]+(?:[+./-][^\W_]+)*", re.sub(r"[^\w+%./-]|_", " ", q))))


def _struct(score: float, tf: float, n: int) -> Callable[[Column], Column]:
    return lambda t: F.struct(t.alias("token"), F.lit(score).alias("score"), F.lit(tf).alias("tf"), F.lit(n).alias("n"))


def token_scores(records: DataFrame) -> DataFrame:
    """(id, token, score, tf, n): weights of the fields in which a token occurs, weighted and plain number of its occurrences.

    All occurrences and, once more, the distinct tokens of every field are summed up in one pass without joins.
    """
    rows = records.select("id", *[tx.tokenize(F.col(f)).alias(f"t_{f}") for f in FIELD_WEIGHTS])
    occurs = [F.transform(f"t_{f}", _struct(0.0, BM25_WEIGHTS[f], 1)) for f in FIELD_WEIGHTS]
    stands = [F.transform(F.array_distinct(f"t_{f}"), _struct(w, 0.0, 0)) for f, w in FIELD_WEIGHTS.items()]
    each = rows.select("id", F.inline(F.concat(*occurs, *stands)))
    return each.groupBy("id", "token").agg(F.sum("score").alias("score"), F.sum("tf").alias("tf"), F.sum("n").alias("n"))


class SearchIndex:
    """Written tables of an inverted index: postings in buckets by token, vocabulary, sizes and heads of the records.

    ``opened`` builds an index once per state of its sources and reuses it from then on, also in later sessions that share the
    folder. A build counts once its marker is written; queries read the postings of the buckets of their tokens only.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        self.postings, self.vocabulary, self.sizes, self.heads = read("postings"), read("vocabulary"), read("sizes"), read("heads")

    @classmethod
    def build(cls, records: DataFrame, path: str, buckets: int = 16) -> SearchIndex:
        spark = records.sparkSession
        put = lambda df, name, *by: (df.write.partitionBy(*by) if by else df.write).option("compression", "zstd").parquet(f"{path}/{name}")
        bucketed = token_scores(records).withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))
        put(bucketed.hint("rebalance", "bucket"), "postings", "bucket")
        posted = spark.read.parquet(f"{path}/postings")
        put(posted.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("score").alias("weight")), "vocabulary")
        put(posted.groupBy("id").agg(F.sum("n").alias("size")), "sizes")
        put(records.select("id", "kind", "relation", "authority", "title"), "heads")
        rt.touch(spark, f"{path}/complete-{buckets}")
        return cls(spark, path)

    @classmethod
    def opened(cls, spark: SparkSession, state: str, records: Callable[[], DataFrame]) -> SearchIndex:
        """The index of a state of the sources (a fingerprint); built from records() if there is none yet."""
        root = f"{rt.shared_dir(spark)}/search-index-{INDEX_VERSION}-{state}"
        for name in rt.names_in(spark, root):
            if any(n.startswith("complete-") for n in rt.names_in(spark, f"{root}/{name}")):
                return cls(spark, f"{root}/{name}")
        return cls.build(records(), f"{root}/{uuid.uuid4().hex}")

    def of_tokens(self, tokens: Sequence[str]) -> DataFrame:
        """Postings of the tokens, which are few, read from their buckets."""
        if not tokens:
            return self.postings.limit(0)
        buckets = next(int(n.split("-")[1]) for n in rt.names_in(self.spark, self.path) if n.startswith("complete-"))
        named = self.spark.createDataFrame([(t,) for t in tokens], "token string").select(F.pmod(F.xxhash64("token"), F.lit(buckets)).alias("b"))
        wanted = sorted({r["b"] for r in named.collect()})
        return self.postings.where(F.col("bucket").isin(wanted) & F.col("token").isin(list(tokens)))

    def search(self, query: str, limit: int = 40, fuzzy: bool = True, personal_priority: bool = False) -> DataFrame:
        """As search_postings, over the written tables."""
        hits = query_hits(self.vocabulary.select("token", "df"), query_tokens(query), fuzzy).collect()  # at most (1 + 32 + 48) per query token
        schema = "query_token string, token string, df long, match double"
        found = self.of_tokens(sorted({h["token"] for h in hits}))
        return best_records(self.heads, found, self.spark.createDataFrame([tuple(h) for h in hits], schema), limit, personal_priority)

    def bm25(self, query: str, limit: int = 20) -> DataFrame:
        """BM25 with prefix terms and column weights: idf ln((N - n + .5) / (n + .5)), at least 1e-6; length over all columns."""
        tokens = query_tokens(query)
        begins = [F.col("token").startswith(t) for t in tokens]
        if not tokens:
            return ranked(self.heads.limit(0).withColumn("score", F.lit(0.0)), limit)
        some = begins[0]
        for x in begins[1:]:
            some = some | x
        sums = [F.round(F.sum(F.when(x, F.col("tf")).otherwise(0.0)), 6).alias(f"f{i}") for i, x in enumerate(begins)]
        rows = rt.written(self.postings.where(some).groupBy("id").agg(*sums), "bm25-hits")
        counts = rows.agg(*[F.sum((F.col(f"f{i}") > 0).cast("long")).alias(f"n{i}") for i in range(len(tokens))]).first()
        # a record without any token has no posting, but counts
        total, length = self.heads.count(), self.sizes.agg(F.sum("size")).first()[0] or 0
        score = F.lit(0.0)
        for i in range(len(tokens)):
            n, f = counts[f"n{i}"] or 0, F.col(f"f{i}")
            idf = max(1e-6, math.log((total - n + 0.5) / (n + 0.5)))
            score = score + F.lit(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("size") / F.lit(length / total if length else 1.0)))
        few = rt.fits_broadcast(rows)
        sized = self.sizes.join(F.broadcast(rows) if few else rows, "id").select("id", F.round(score, 6).alias("score")).where("score > 0")
        best = sized.orderBy(F.col("score").desc(), "id").limit(limit)
        return ranked(self.heads.join(F.broadcast(best), "id"), limit)


def vocabulary(postings: DataFrame) -> DataFrame:
    return postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def posting_lists(postings: DataFrame, longest: int = 50) -> DataFrame:
    """token, document frequency and its best `longest` postings (score descending, id): a top-k per token, not the whole list."""
    w = Window.partitionBy("token").orderBy(F.col("score").desc(), "id")
    best = postings.withColumn("n", F.row_number().over(w)).where(F.col("n") <= longest)
    lists = best.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("n", "id", "score"))).alias("postings"))
    return vocabulary(postings).join(lists, "token")


def ranked_postings(postings: DataFrame) -> DataFrame:
    """The inverted index in long form: token, df, rank by descending score and id, id, score; whole lists, however long."""
    numbered = rt.row_numbers(postings.withColumn("below", -F.col("score")), ["token"], ["below", "id"], "rank")
    vocab = rt.written(vocabulary(postings), "vocabulary")
    joined = numbered.join(F.broadcast(vocab), "token") if rt.fits_broadcast(vocab) else rt.skew_join(numbered, vocab, ["token"], "inner")
    return joined.select("token", "df", "rank", "id", "score")


def candidates(vocab: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """(query_token, token, df, match): exact tokens and, for words of two letters and more, the first 32 longer ones in key order.

    One scan of the vocabulary serves all query tokens; a group limit keeps 32 rows per token in every partition.
    """
    words = F.array(*[F.lit(t) for t in tokens]) if tokens else F.array().cast("array<string>")
    hits = vocab.select(F.explode(F.filter(words, lambda t: F.col("token").startswith(t))).alias("query_token"), "token", "df")
    hits = hits.where((F.col("token") == F.col("query_token")) | (F.length("query_token") >= 2)).withColumn("exact", F.col("token") == F.col("query_token"))
    place = F.row_number().over(Window.partitionBy("query_token", "exact").orderBy("token"))
    kept = hits.withColumn("place", place).where(F.col("place") <= PREFIX_CAP)
    return kept.select("query_token", "token", "df", F.when(F.col("exact"), 1.0).otherwise(0.76).alias("match"))


def fuzzy_candidates(vocab: DataFrame, tokens: Sequence[str], limit: int | None = FUZZY_CAP) -> DataFrame:
    """Near tokens in key order for words of four letters and more; levenshtein <= 2 x limit is a sound filter before the exact distance."""
    spark = vocab.sparkSession
    parts = []
    for q in tokens:
        most = 0 if len(q) <= 3 else 1 if len(q) <= 6 else 2 if len(q) <= 11 else 3
        if len(q) < 4:
            continue
        near = vocab.where((F.abs(F.length("token") - len(q)) <= most) & (F.levenshtein(F.col("token"), F.lit(q), 2 * most) >= 0))
        near = near.withColumn("distance", tx.osa_distance(F.lit(q), F.col("token"), F.lit(most))).where(F.col("distance") <= most)
        near = near if limit is None else near.orderBy("token").limit(limit)
        match = F.greatest(F.lit(0.28), 0.62 - 0.12 * F.col("distance"))
        parts.append(near.select(F.lit(q).alias("query_token"), "token", "df", match.alias("match"), "distance"))
    if not parts:
        return spark.createDataFrame([], "query_token string, token string, df long, match double, distance int")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def multiplier(personal_priority: bool = False) -> Column:
    """By kind, relation and authority of a record."""
    note = F.col("kind") == "note"
    relation = F.col("relation")
    by_relation = F.when(~note, 1.0).when(relation == "supersedes", 2.6).when(relation == "contradicts", 1.9).when(relation == "refines", 1.45).otherwise(1.15)
    personal = F.when(note & F.lit(personal_priority), 2.1).otherwise(1.0)
    return by_relation * personal * F.when(F.col("authority") == "reference", 1.04).otherwise(1.0)


def query_hits(vocab: DataFrame, tokens: Sequence[str], fuzzy: bool = True) -> DataFrame:
    """(query_token, token, df, match): exact and longer tokens, or near ones of a query token that has neither."""
    hits = candidates(vocab, tokens)
    if fuzzy:
        near = fuzzy_candidates(vocab, [t for t in tokens if len(t) >= 4]).drop("distance")
        hits = hits.unionByName(near.join(hits.select("query_token").distinct(), "query_token", "left_anti"))
    return hits


def best_records(heads: DataFrame, postings: DataFrame, hits: DataFrame, limit: int, personal_priority: bool = False) -> DataFrame:
    """Posting score x match / max(1, log2(2 + df)) summed per record, first the 4 x limit best ids, then multipliers and relevance."""
    found = postings.join(F.broadcast(hits), "token")  # at most (1 + 32 + 48) tokens per query token
    scored = found.groupBy("id").agg(F.sum(F.col("score") * F.col("match") / F.greatest(F.lit(1.0), F.log2(2.0 + F.col("df")))).alias("raw"))
    first = scored.orderBy(F.col("raw").desc(), "id").limit(max(4 * limit, 80))
    kept = heads.join(F.broadcast(first), "id").withColumn("score", F.round(F.col("raw") * multiplier(personal_priority), 6)).where("score > 0")
    return ranked(kept, limit)


def search_postings(records: DataFrame, postings: DataFrame, query: str, limit: int = 40, fuzzy: bool = True) -> DataFrame:
    """Best records by postings that are not written as an index."""
    return best_records(records, postings, query_hits(vocabulary(postings), query_tokens(query), fuzzy), limit)


def ranked(scored: DataFrame, limit: int) -> DataFrame:
    """The best rows with rank and relevance against the best of them (at most `limit` rows are in the window)."""
    best = scored.orderBy(F.col("score").desc(), "id").limit(limit)
    every = Window.partitionBy(F.lit(0))
    return best.select(
        "id", "title", "score", F.row_number().over(every.orderBy(F.col("score").desc(), "id")).alias("rank"),
        tx.normalize_relevance(F.col("score"), F.max("score").over(every)).alias("relevance"),
    )


def fallback_score(tokens: Sequence[str], query: str) -> Column:
    """Phrase and word points over normalised title, aliases, body and tags (columns n_title, n_aliases, n_body, n_tags)."""
    title, aliases, body, tags = (F.col(f"n_{c}") for c in ("title", "aliases", "body", "tags"))
    score = F.lit(0)
    if query:
        for c, points in ((title, 38), (aliases, 34), (body, 18)):
            score = score + F.when(c.contains(query), points).otherwise(0)
    for t in tokens:
        for c, whole, part in ((title, 14, 9), (aliases, 16, 10), (body, 6, 3)):
            score = score + F.when(F.array_contains(F.split(c, " "), t), whole).when(c.contains(t), part).otherwise(0)
        score = score + F.when(tags.contains(t), 2).otherwise(0)
    return score


def search_fallback(records: DataFrame, query: str, limit: int = 40) -> DataFrame:
    norm = lambda *c: tx.normalize_text(F.concat_ws(" ", *c))
    rows = records.select(
        "id", "kind", "title", "authority", "relation", norm("title", "document_title").alias("n_title"), norm("aliases", "entity_names").alias("n_aliases"),
        norm("body").alias("n_body"), norm("tags").alias("n_tags"),
    )
    rows = rt.written(rows, "normalised-records")  # else every use of a field normalises it again
    tokens = query_tokens(query)
    scored = rows.withColumn("score", F.round(fallback_score(tokens, " ".join(tokens)) * multiplier(), 6)).where("score > 0")
    return ranked(scored, limit)


def suggest(vocab: DataFrame, prefix: str, limit: int = 5) -> DataFrame:
    """Of the first max(5 x limit, 20) tokens with the prefix in key order, those with the highest document frequency."""
    first = vocab.where(F.col("token").startswith(prefix)).orderBy("token").limit(max(5 * limit, 20))
    return first.orderBy(F.col("df").desc(), "token").limit(limit)


def corrections(vocab: DataFrame, tokens: Sequence[str], best: int = 3) -> DataFrame:
    """The three nearest, then most frequent words for each query word among those sharing its first two letters."""
    near = fuzzy_candidates(vocab, tokens, None).where(F.substring("token", 1, 2) == F.substring("query_token", 1, 2))
    w = Window.partitionBy("query_token").orderBy("distance", F.col("df").desc(), "token")
    return near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= best).select("query_token", "token", "distance", "df", "place")


def expanded_query(entities: DataFrame, query: str) -> DataFrame:
    """Names and aliases of the entities one of whose names stands in the normalised query: (addition)."""
    normal = " ".join(query_tokens(query))
    names = entities.select("entity_id", F.explode(F.array_compact(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("addition"))
    names = names.withColumn("normal", tx.normalize_text(F.col("addition")))
    hit = names.where((F.col("normal") != "") & F.lit(normal).contains(F.col("normal"))).select("entity_id").distinct()
    return names.join(hit, "entity_id", "left_semi").select("addition").distinct()


def index_stats(postings: DataFrame) -> DataFrame:
    return postings.agg(F.count_distinct("id").alias("records"), F.count_distinct("token").alias("tokens"), F.count(F.lit(1)).alias("postings"))
