"""Near-duplicate sections by tensored minhash banding, verified exactly.

Two small collections of hashes are kept per text: FIRST bands of three minhashes
and SECOND lanes of two. A table key is a pair (band i, lane j); forming keys by
pairs makes 16 x 12 tables of five minhashes each from 72 minhashes instead of
960. A pair is a candidate if it shares one whole table key. Where few texts
share a band they are joined on it and the lane halves, which ride along, are
compared after the join; a band that more than rt.PAIR_BLOCK texts share (a
boilerplate) is joined on whole table keys, and keys that are still hot in
blocks. Candidates are screened with all 72 minhashes (8 bits of each) and then
verified on their exact shingle sets.

``exact=True`` finds candidates without hashing instead: two texts of the
similarity share one of the rarest shingles of either (prefix filter). It loses
no pair but explodes all shingles, and serves to measure the recall.

Texts with the same words form one class, represented by its least row; only
representatives are compared, and all rows are put back at the end.

Defined cases: null titles and texts count as empty; texts of fewer than three
words have no shingles and no near-duplicates, not even exact repeats; repeated
rows are pairs of similarity 1; whole texts are used, however long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import runtime as rt

WORDS = 3
THRESHOLD = (3, 5)  # a similarity of at least 3/5
FIRST, FIRST_ROWS = 16, 3
SECOND, SECOND_ROWS = 12, 2
HASHES = FIRST * FIRST_ROWS + SECOND * SECOND_ROWS
#: Of the 72 minhashes a candidate must share this many; at similarity 0.6 about three pairs in a million have fewer.
SCREEN = 24
WORD = re.compile(r"[^\W_]+")
CHUNK = 150_000
CACHE = 400_000

_rng = np.random.default_rng(60_317)
_MULTIPLIERS = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _words(title: str | None, text: str | None) -> list[str]:
    return WORD.findall(f"{title or ''}\n{text or ''}".lower())


def shingles(words: list[str], seen: dict[str, int]) -> np.ndarray:
    """64-bit hashes of the runs of three consecutive words, repeats included."""
    if len(seen) > CACHE:
        seen.clear()
    for w in words:
        if w not in seen:
            seen[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    if len(h) < WORDS:
        return h[:0]
    s = (h[:-2] * _MIX + h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
    s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    return s ^ (s >> np.uint64(32))


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), HASHES) of uint32; every set must be non-empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat((flat * _MULTIPLIERS[k]) >> np.uint64(32), starts)
    return out


def _combined(sig: np.ndarray, rows: int) -> np.ndarray:
    """Hash of each group of `rows` neighbouring columns."""
    parts = sig.reshape(len(sig), -1, rows).astype(np.uint64)
    key = np.zeros(parts.shape[:2], np.uint64)
    for r in range(rows):
        key = (key + parts[:, :, r] + np.uint64(1)) * _MIX
        key ^= key >> np.uint64(31)
    return key


FEATURES = "section_row long, c1 long, c2 long, words int, bands array<int>, lanes array<long>, sketch array<tinyint>"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, int] = {}

    def rows(ids: list, digests: list, counts: list, sets: list) -> pa.RecordBatch:
        n = len(ids)
        full = [i for i in range(n) if len(sets[i])]
        bands = np.zeros((n, FIRST), np.uint32)
        lanes = np.zeros((n, SECOND // 4), np.uint64)
        sketch = np.zeros((n, HASHES), np.uint8)
        if full:
            sig = minhashes([sets[i] for i in full])
            cut = FIRST * FIRST_ROWS
            bands[full] = (_combined(sig[:, :cut], FIRST_ROWS) >> np.uint64(32)).astype(np.uint32)
            short = (_combined(sig[:, cut:], SECOND_ROWS) >> np.uint64(48)).reshape(len(full), -1, 4)
            lanes[full] = (short << (np.arange(4, dtype=np.uint64) * np.uint64(16))).sum(axis=2, dtype=np.uint64)
            sketch[full] = (sig & np.uint32(255)).astype(np.uint8)
        high, low = zip(*digests, strict=True)
        fixed = lambda a, t: pa.ListArray.from_arrays(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32), pa.array(a.ravel().view(t)))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array(np.array(high, np.uint64).view(np.int64)), pa.array(np.array(low, np.uint64).view(np.int64)),
                pa.array(counts, pa.int32()), fixed(bands, np.int32), fixed(lanes, np.int64), fixed(sketch, np.int8),
            ],
            names=["section_row", "c1", "c2", "words", "bands", "lanes", "sketch"],
        )

    for batch in batches:
        ids, digests, counts, sets, size = [], [], [], [], 0
        for row, title, text in zip(*(c for c in batch.columns), strict=True):
            words = _words(title.as_py(), text.as_py())
            digest = xxhash.xxh3_128_intdigest(" ".join(words))
            ids.append(row.as_py())
            digests.append((digest >> 64, digest & (2**64 - 1)))
            counts.append(len(words))
            sets.append(shingles(words, seen))
            size += len(words)
            if size > CHUNK:
                yield rows(ids, digests, counts, sets)
                ids, digests, counts, sets, size = [], [], [], [], 0
        if ids:
            yield rows(ids, digests, counts, sets)


def _exact_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, int] = {}
    for batch in batches:
        sets = [np.unique(shingles(_words(ti.as_py(), te.as_py()), seen)).view(np.int64) for ti, te in zip(batch.column(1), batch.column(2), strict=True)]
        flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
        offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["id", "shingles"])


def same_lanes(a: str, b: str) -> Column:
    """How many of the twelve 16-bit lanes agree."""
    total = F.lit(0)
    for k in range(SECOND // 4):
        x = F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))
        for lane in range(4):
            mask = 0xFFFF << (16 * lane)
            total = total + F.when(x.bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask)) == 0, 1).otherwise(0)
    return total


class NearDuplicates:
    """Classes of equal texts and the verified pairs between their representatives, as written tables."""

    def __init__(self, sections: DataFrame, exact: bool = False):
        """sections: (section_row, title, text); exact: candidates by prefix filter."""
        sections = sections.select(F.col("section_row").cast("long").alias("section_row"), "title", "text")
        features = rt.written(rt.spread(sections, "section_row").mapInArrow(_features, FEATURES), "neardup-features")
        classes = features.groupBy("c1", "c2").agg(F.min("section_row").alias("rep"), F.count(F.lit(1)).alias("copies"))
        repeated = rt.written(classes.where("copies > 1"), "neardup-repeated")
        # rows of repeated texts: (section_row, rep); every other row represents itself
        few = rt.fits_broadcast(repeated)
        keyed = features.select("section_row", "c1", "c2", "words")
        self.copies = rt.written(
            keyed.join(F.broadcast(repeated) if few else repeated, ["c1", "c2"]).select("section_row", "rep", "words"), "neardup-copies"
        )
        extra = self.copies.where("section_row <> rep").select("section_row")
        few = rt.fits_broadcast(extra)
        reps = features.where(f"words >= {WORDS}").join(F.broadcast(extra) if few else extra, "section_row", "left_anti")
        self.sections = sections
        self.pairs = self._verified(self._prefix_candidates(reps) if exact else self._candidates(reps), None if exact else reps)
        rt.forget(features, repeated)

    def _candidates(self, reps: DataFrame) -> DataFrame:
        lanes = [f"l{k}" for k in range(SECOND // 4)]
        keyed = reps.select(F.col("section_row").alias("id"), *[F.col("lanes")[k].alias(n) for k, n in enumerate(lanes)], F.posexplode("bands").alias("band", "half"))
        key = F.shiftleft(F.col("band").cast("long"), 32).bitwiseOR(F.col("half").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
        keyed = keyed.select(key.alias("key"), "id", *lanes)
        hot = rt.hot_keys(keyed, ["key"], rt.PAIR_BLOCK)
        plain = keyed if hot is None else keyed.join(F.broadcast(hot), "key", "left_anti")
        other = plain.select("key", F.col("id").alias("id_b"), *(F.col(n).alias(n.replace("l", "r")) for n in lanes))
        joined = plain.join(other.hint("merge"), "key").where((F.col("id") < F.col("id_b")) & (same_lanes("l", "r") > 0))
        pairs = joined.select(F.col("id").alias("a"), F.col("id_b").alias("b"))
        if hot is not None:
            each = [F.shiftrightunsigned(n, 16 * k).bitwiseAND(F.lit(0xFFFF)) for n in lanes for k in range(4)]
            whole = keyed.join(F.broadcast(hot), "key", "left_semi").select("key", "id", F.posexplode(F.array(*each)).alias("lane", "lane_half"))
            met = rt.pairs_within(whole, ["key", "lane", "lane_half"], "id")
            pairs = pairs.unionByName(met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")))
        return pairs.distinct()

    def _prefix_candidates(self, reps: DataFrame) -> DataFrame:
        """Pairs that share one of the n - ceil(0.6 n) + 1 rarest shingles of both, as any pair of the similarity does."""
        few = reps.select("section_row")
        sets = rt.written(rt.checked_semi_join(self.sections, few, "section_row").mapInArrow(_exact_sets, "id long, shingles array<long>"), "neardup-all-sets")
        each = sets.select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
        often = rt.written(each.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "neardup-shingles")
        ranked = rt.skew_join(each, often, ["s"], "inner").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("shared"))
        # shingles of one text only come first in the order; they fill the prefix but meet nothing
        prefix = F.col("n") - F.ceil(F.col("n") * (THRESHOLD[0] / THRESHOLD[1]) - 1e-9) + 1 - (F.col("n") - F.size("shared"))
        rows = ranked.select("id", "n", F.explode(F.slice("shared", F.lit(1), F.greatest(prefix.cast("int"), F.lit(0)))).alias("p"))
        met = rt.pairs_within(rows.select(F.col("p.s").alias("s"), "id", "n"), ["s"], "id")
        near = met.where((F.least("x.n", "y.n") * THRESHOLD[1] >= F.greatest("x.n", "y.n") * THRESHOLD[0]))
        return near.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()

    def _verified(self, candidates: DataFrame, reps: DataFrame | None) -> DataFrame:
        if reps is not None:
            sketch = reps.select(F.col("section_row").alias("id"), "sketch")
            candidates = (
                candidates.join(sketch.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a")
                .join(sketch.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b")
                .where(F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda e: e)) >= SCREEN)
                .select("a", "b")
            )
        screened = rt.written(candidates, "neardup-screened")
        ids = screened.select(F.explode(F.array("a", "b")).alias("section_row")).distinct()
        texts = rt.checked_semi_join(self.sections, ids, "section_row")
        sets = rt.written(texts.mapInArrow(_exact_sets, "id long, shingles array<long>"), "neardup-sets")
        both = screened.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(
            sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b"
        )
        common = F.size(F.array_intersect("x", "y"))
        either = F.size("x") + F.size("y") - F.col("common")
        sizes = both.select("a", "b", common.alias("common"), "x", "y").select("a", "b", "common", either.alias("either"))
        near = sizes.where(F.col("common") * THRESHOLD[1] >= F.col("either") * THRESHOLD[0])
        pairs = rt.written(near, "neardup-pairs")
        rt.forget(screened, sets)
        return pairs

    def row_pairs(self) -> DataFrame:
        """Every pair of rows: between classes, and within classes of equal texts; hot classes are spread over tasks."""
        ids = self.pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        alone = ids.join(self.copies.select("rep").distinct(), "rep", "left_anti").select("rep", F.col("rep").alias("row"))
        members = rt.written(self.copies.join(ids, "rep", "left_semi").select("rep", F.col("section_row").alias("row")).unionByName(alone), "neardup-members")
        one = rt.skew_join(members.select(F.col("rep").alias("a"), F.col("row").alias("x")), self.pairs.select("a", "b"), ["a"], "inner")
        two = rt.skew_join(one.select("b", "x"), members.select(F.col("rep").alias("b"), F.col("row").alias("y")), ["b"], "inner")
        across = two.select(F.least("x", "y").alias("section_row_a"), F.greatest("x", "y").alias("section_row_b"))
        inside = rt.pairs_within(self.copies.where(f"words >= {WORDS}").select("rep", "section_row"), ["rep"], "section_row")
        return across.unionByName(inside.select(F.col("x.section_row").alias("section_row_a"), F.col("y.section_row").alias("section_row_b")))

    def groups(self) -> DataFrame:
        """One row per section: class representative, group (least row of its component) and links to other texts."""
        rows = self.sections.select("section_row").join(self.copies.select("section_row", "rep"), "section_row", "left")
        rows = rows.select("section_row", F.coalesce("rep", "section_row").alias("class_row"))
        ends = self.pairs.select(F.col("a").alias("class_row"), F.col("b").alias("other")).unionByName(
            self.pairs.select(F.col("b").alias("class_row"), F.col("a").alias("other"))
        )
        links = ends.groupBy("class_row").agg(F.count(F.lit(1)).alias("links"))
        labels = components(self.pairs.select("a", "b"))
        out = rt.skew_join(rows, links.join(labels.withColumnRenamed("id", "class_row"), "class_row"), ["class_row"], "left")
        return out.select(
            "section_row", "class_row", F.coalesce("label", "class_row").alias("group_row"), F.coalesce("links", F.lit(0)).alias("links")
        )


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, label): label is the least id connected with id. Labels spread along edges and jump to their own label's label."""
    both = rt.written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = rt.written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("label")).select("id", F.least("id", "label").alias("label")), "labels")
    written = labels
    for _ in range(most_rounds):
        seen = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        nearer = labels.join(seen, "id").select("id", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        step = nearer.join(jump, "label", "left").select("id", "old", F.least("label", "further").alias("label"))
        step = rt.written(step, "labels")
        rt.forget(written)
        written, labels = step, step.select("id", "label")
        if step.where("label <> old").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def near_duplicates(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    return NearDuplicates(rt.table(spark, sf_dir, "lnote_sections", "section_row", "title", "text"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sections of similarity 0.6 or more: (section_row_a, section_row_b)."""
    return near_duplicates(spark, sf_dir).row_pairs()


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every section."""
    return near_duplicates(spark, sf_dir).groups()
