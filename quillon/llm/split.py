"""Oversized texts cut into pieces at natural boundaries, by balanced targets.

The least number of pieces is computed, equal-length targets are placed, each cut
is snapped to the strongest boundary near its target, and if any piece exceeds
the limit the text gets one piece more. Consecutive pieces overlap by `overlap`
characters, or less if a boundary lies nearer. Lengths are code points.

Defined cases: null, empty and short texts are not cut (one piece in ``cut``,
none in ``pieces``); text without any boundary is cut between grapheme clusters;
CRLF stays together; repeated rows are cut alike under different ids.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import runtime as rt

LIMIT = 5000
OVERLAP = 200
#: A cut may move from its target by this share of the target length.
REACH = 0.18
# Boundary kinds from the strongest; a piece starts where the match ends.
BOUNDARIES = [
    ("paragraph", re.compile(r"(?:\r?\n[ \t]*){2,}")),
    ("line", re.compile(r"\r?\n")),
    ("sentence", re.compile(r"[.!?…。！？]+[\"'»”’)\]]*\s+|[。！？]")),
    ("clause", re.compile(r"[,;:—–]\s+")),
    ("word", re.compile(r"\s+")),
]
CLUSTER = regex.compile(r"\X")
#: Characters looked back at first for the start of a grapheme cluster.
CLUSTER_REACH = 64


def cluster_start(text: str, at: int, low: int) -> int:
    """The largest start of a grapheme cluster not after `at` and above `low`; `at` itself if there is none.

    Looks back CLUSTER_REACH characters, and twice as far as long as these lie within one cluster.
    """
    reach = CLUSTER_REACH
    while True:
        base = max(low, at - reach)
        best = None
        for m in CLUSTER.finditer(text, base):
            if m.start() > at:
                break
            if m.start() > base:
                best = m.start()
        if best is not None:
            return best
        if base == low:
            return at
        reach *= 2


def strongest(text: str, low: int, high: int, wanted: int) -> tuple[int, str] | None:
    """Of the boundaries p with low <= p <= high, one of the strongest kind nearest to `wanted`."""
    span = text[max(0, low - 80) : high]
    shift = max(0, low - 80)
    for kind, pattern in BOUNDARIES:
        at = [m.end() + shift for m in pattern.finditer(span)]
        at = [p for p in at if low <= p <= high and p < len(text)]
        if at:
            return min(at, key=lambda p: (abs(p - wanted), p)), kind
    return None


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start, stop, kind of the boundary at stop) of every piece; the pieces cover the text."""
    size = len(text)
    if size <= limit:
        return [(0, size, "end")]
    overlap = min(overlap, limit - 1)
    count = max(2, math.ceil((size - overlap) / (limit - overlap)))
    while True:
        pieces = _cut_into(text, count, limit, overlap)
        if pieces:
            return pieces
        count += 1


def _cut_into(text: str, count: int, limit: int, overlap: int) -> list[tuple[int, int, str]] | None:
    size = len(text)
    length = (size + (count - 1) * overlap) / count
    reach = int(length * REACH)
    pieces, start = [], 0
    for k in range(1, count):
        target = round(k * (length - overlap) + overlap)
        low, high = max(start + overlap + 1, target - reach), min(target + reach, start + limit, size - 1)
        if low > high:
            return None
        snapped = strongest(text, low, high, target)
        if snapped is None:
            stop, kind = cluster_start(text, min(target, high), start), "cluster"
        else:
            stop, kind = snapped
        if stop <= start or stop - start > limit:
            return None
        pieces.append((start, stop, kind))
        after = strongest(text, stop - overlap, stop - 1, stop - overlap)
        if after is None:
            back = stop - overlap
            begun = cluster_start(text, back, start)
            # cluster_start only goes back; the overlap must not grow beyond its limit
            following = stop if begun == back else next((m.end() for m in CLUSTER.finditer(text, begun)), stop)
            next_start = begun if begun == back else min(following, stop)
        else:
            next_start = after[0]
        if next_start <= start:
            return None
        start = next_start
    if size - start > limit:
        return None
    return [*pieces, (start, size, "end")]


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shape = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())]))
    for batch in batches:
        out = [[{"start": a, "stop": b, "kind": k} for a, b, k in cut(t)] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, shape)], names=["section_row", "cuts"])


CUTS = "section_row long, cuts array<struct<start:int, stop:int, kind:string>>"


def oversized(sections: DataFrame) -> DataFrame:
    """(section_row, cuts) of the sections longer than the limit; only their texts go to Python."""
    long = sections.where(F.length("text") > LIMIT)
    return long.select(F.col("section_row").cast("long"), "text").mapInArrow(_cut_batches, CUTS)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that are cut: (section_row)."""
    sections = rt.table(spark, sf_dir, "lnote_sections", "section_row", "text")
    return oversized(sections).where(F.size("cuts") > 1).select("section_row")


#: Rounds in which sections whose ids are taken try their next form. Forms hold the row number, so few rounds suffice.
MOST_ROUNDS = 50
#: The beginning of an id of the form of a piece's.
STEM = r"^(.*)-part-\d+$"


def stems(sections: DataFrame) -> DataFrame:
    """(section_row, stem) of the oversized sections; stem-part-k is unique in the document, whatever ids it has.

    The first delivery of section s tries the stem ``s``, any other delivery, and a section without id, ``s-row<section_row>``;
    where another section wants the same stem, or an id of the document begins with it as a piece's id does, the next form
    ``s-row<section_row>-2``, ``-3`` … is tried. An id of that form ends with ``-part-`` and a number in one way only, so pieces
    have equal ids only if they have equal stems. Null packs, documents and ids are values like others.
    """
    place, own = F.to_json(F.struct("pack_id", "document_id")), F.to_json(F.struct("section_id"))
    ids = sections.select("section_row", place.alias("place"), own.alias("own"), "section_id", (F.length("text") > LIMIT).alias("long"))
    taken = ids.select("place", F.regexp_extract("section_id", STEM, 1).alias("stem")).where(F.col("section_id").rlike(STEM)).distinct()
    taken = rt.written(taken, "taken-stems")
    long = ids.where("long").groupBy("section_row").agg(*[F.min(c).alias(c) for c in ("place", "own", "section_id")])
    first = long.groupBy("place", "own").agg(F.min("section_row").alias("first_row"))
    left = rt.written(long.join(first, ["place", "own"]), "long-sections")
    done, row = None, F.col("section_row").cast("string")
    base = F.coalesce("section_id", F.lit("section"))
    for turn in range(MOST_ROUNDS):
        if turn:
            form = F.concat(base, F.lit("-row"), row, F.lit(f"-{turn + 1}"))
        else:
            form = F.when((F.col("section_row") == F.col("first_row")) & F.col("section_id").isNotNull(), base).otherwise(F.concat(base, F.lit("-row"), row))
        tried = left.withColumn("stem", form)
        free = tried.groupBy("place", "stem").agg(F.count(F.lit(1)).alias("n")).where("n = 1").drop("n").join(taken, ["place", "stem"], "left_anti")
        judged = rt.written(tried.join(free.withColumn("free", F.lit(True)), ["place", "stem"], "left"), "stems")
        got = judged.where("free")
        done = got if done is None else done.unionByName(got)
        left = judged.where("free is null").drop("free", "stem")
        if left.isEmpty():
            return done.select("section_row", "stem")
        taken = taken.unionByName(got.select("place", "stem"))
    raise RuntimeError(f"no free ids after {MOST_ROUNDS} forms")


def _piece_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shape = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("text", pa.string())]))
    for batch in batches:
        out = [[{"start": a, "stop": b, "kind": k, "text": t[a:b]} for a, b, k in cut(t)] for t in batch.column(5).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, shape)], names=["section_row", "pack_id", "document_id", "section_id", "title", "cuts"])


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every oversized section with ids that are unique in the document (see stems).

    A row that is delivered again with its own number is the same section: its pieces come out again under the same ids.
    """
    sections = rt.table(spark, sf_dir, "lnote_sections", "section_row", "pack_id", "document_id", "section_id", "title", "text")
    sections = sections.withColumn("section_row", F.col("section_row").cast("long"))
    shape = "section_row long, pack_id string, document_id string, section_id string, title string, cuts array<struct<start:int, stop:int, kind:string, text:string>>"
    cuts = sections.where(F.length("text") > LIMIT).mapInArrow(_piece_batches, shape)
    named = rt.written(stems(sections), "piece-stems")
    each = cuts.join(F.broadcast(named) if rt.fits_broadcast(named) else named, "section_row")
    each = each.select("*", F.size("cuts").alias("piece_count"), F.posexplode("cuts").alias("at", "c"))
    return each.select(
        "section_row", "pack_id", "document_id", "section_id", "title", (F.col("at") + 1).alias("piece_no"), "piece_count",
        F.concat("stem", F.lit("-part-"), (F.col("at") + 1).cast("string")).alias("piece_section_id"),
        F.col("c.start").alias("start"), F.col("c.stop").alias("stop"), F.col("c.kind").alias("boundary"), F.col("c.text").alias("piece_text"),
    )
