"""Filling containers of fixed capacity with documents: the linear grouping scheme.

A document longer than the capacity fills containers of its own, which need no
packing; its rest is packed like a document, so every document has one piece to
pack at most. The pieces are spread by hash over blocks of about BLOCK pieces,
each packed on its own, so that no task holds more. In a block, lengths above a
share of the capacity are rounded up within groups of equal cardinality; the
configurations of the few group sizes and how often each is used are the solution
of the configuration program (column generation with a knapsack for the prices),
rounded down; actual documents take the places, each the longest that the place
and the room left by shorter ones before it admit; what remains is filled with
the other documents by best fit, longest first. Should plain best fit of the
whole block need fewer containers, its result is taken.

Defined cases: documents without tokens (null or empty text) lie in the first
container of their block; repeated rows are packed each.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import runtime as rt
from quillon.llm.tokens import with_tokens

#: Pieces of a block, on average.
BLOCK = 25_000
GROUPS = 32
#: Lengths above capacity / SMALL are grouped, the others fill gaps.
SMALL = 10
#: Steps of the capacity in the search for a better configuration, and most such searches.
STEPS, SEARCHES = 2048, 400
#: Least fill of a configuration's container; documents of an emptier one go to best fit.
KEPT = 0.997
#: Container types a run may have; they are part of the plan.
MOST_TYPES = 1000


def best_configuration(units: np.ndarray, prices: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Value and counts of the most valuable configuration of sizes (in steps) within the room. Sizes allow few items, so items are added one by one."""
    best = np.zeros(room + 1)
    choice: list[np.ndarray] = []
    for _ in range(room // int(units.min())):
        now, took = best.copy(), np.full(room + 1, -1, np.int16)
        for g, u in enumerate(units):
            if prices[g] <= 0:
                continue
            value = best[: room + 1 - u] + prices[g]
            better = value > now[u:] + 1e-12
            now[u:][better] = value[better]
            took[u:][better] = g
        if (took < 0).all():
            break
        best = now
        choice.append(took)
    counts, at = np.zeros(len(units)), room
    for took in reversed(choice):
        g = int(took[at])
        if g >= 0:
            counts[g] += 1
            at -= int(units[g])
    return float(best[room]), counts


def configurations(tops: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations of the group sizes and how often to use each: the program's solution, rounded down.

    Revised simplex over the groups; a column enters while a configuration is worth more than one container at the present prices.
    """
    n = len(tops)
    room = min(STEPS, capacity)
    units = np.minimum(-(-tops * room // capacity), room)
    columns = np.diag(np.maximum(1, capacity // tops)).astype(float)
    basis = columns.copy()
    amount = counts / np.diag(columns)
    for _ in range(SEARCHES):
        prices = np.linalg.solve(basis.T, np.ones(n))
        value, column = best_configuration(units, prices, room)
        if value <= 1 + 1e-7:
            break
        move = np.linalg.solve(basis, column)
        ratio = np.where(move > 1e-9, amount / np.where(move > 1e-9, move, 1), np.inf)
        leaves = int(np.argmin(ratio))
        amount = np.maximum(amount - ratio[leaves] * move, 0)
        amount[leaves] = ratio[leaves]
        basis[:, leaves] = column
    return [(basis[:, k].round().astype(int), int(amount[k] + 1e-9)) for k in range(n) if amount[k] >= 1]


def best_fit(order: list[int], sizes: np.ndarray, capacity: int, place: np.ndarray, used: list[int]) -> int:
    """Put items into the fullest container that holds them, opening new ones; the number of containers."""
    room = sorted((capacity - u, b) for b, u in enumerate(used) if u < capacity)
    count = len(used)
    for i in order:
        size = int(sizes[i])
        if size == 0:
            place[i] = 0
            count = max(count, 1)
            continue
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, count
            count += 1
        place[i] = b
        if left > size:
            insort(room, (left - size, b))
    return count


def grouped_fit(order: np.ndarray, sizes: np.ndarray, capacity: int, groups: int, place: np.ndarray) -> int:
    """Place items by configurations of grouped sizes, the rest by best fit; the number of containers."""
    large = order[sizes[order] * SMALL > capacity]
    used: list[int] = []
    if len(large):
        parts = np.array_split(large, min(groups, len(large)))
        tops = np.array([sizes[p[0]] for p in parts])
        falling = -sizes[large]  # sorted upwards
        after = list(range(len(large) + 1))  # the next item not yet placed, found by halving paths

        def free(k: int) -> int:
            while after[k] != k:
                after[k] = after[after[k]]
                k = after[k]
            return k

        for plan, times in configurations(tops, np.array([len(p) for p in parts]), capacity):
            targets = [int(tops[g]) for g in range(len(tops)) for _ in range(plan[g])]
            for _ in range(times):
                slack, total, held = capacity - sum(targets), 0, []
                for t in targets:
                    k = free(int(np.searchsorted(falling, -(t + slack), side="left")))
                    if k == len(large):
                        slack += t
                        continue
                    held.append(k)
                    after[k] = k + 1
                    total += int(-falling[k])
                    slack += t + int(falling[k])
                if total >= KEPT * capacity:
                    place[large[held]] = len(used)
                    used.append(total)
                else:  # too few documents are left for it
                    for k in held:
                        after[k] = k
    rest = [int(i) for i in order if place[i] < 0]
    return best_fit(rest, sizes, capacity, place, used)


def pack(sizes: np.ndarray, capacity: int, groups: int = GROUPS) -> np.ndarray:
    """Container number of every item; sizes must not exceed the capacity."""
    sizes = np.asarray(sizes, np.int64)
    order = np.argsort(-sizes, kind="stable")
    place, plain = np.full(len(sizes), -1, np.int64), np.full(len(sizes), -1, np.int64)
    scheme = grouped_fit(order, sizes, capacity, groups, place)
    return place if scheme <= best_fit(order.tolist(), sizes, capacity, plain, []) else plain


ASSIGNED = "container_type string, container_id string, doc_id long, piece_no int, token_start long, tokens long"


def _pack_block(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "row_id"], kind="stable").reset_index(drop=True)
    kind, block, capacity = pdf["container_type"].iloc[0], int(pdf["block"].iloc[0]), int(pdf["capacity_tokens"].iloc[0])
    place = pack(pdf["tokens"].to_numpy(), capacity)
    pdf["container_id"] = [f"{kind}-{block}-{b}" for b in place]
    return pdf[["container_type", "container_id", "doc_id", "piece_no", "token_start", "tokens"]]


def sized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rt.table(spark, sf_dir, "documents", F.col("doc_id").cast("long").alias("doc_id"), "text")
    # the row number is written with the table and tells repeated rows apart
    return rt.written(with_tokens(docs).withColumn("row_id", F.monotonically_increasing_id()), "document-tokens")


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document (in pieces of at most the capacity) in a container of each type."""
    sized = sized_documents(spark, sf_dir)
    blocks = max(1, round(sized.count() / BLOCK))
    types = rt.table(spark, sf_dir, "containers", "container_type", "capacity_tokens").where("container_type is not null and capacity_tokens > 0")
    types = types.groupBy("container_type").agg(F.max("capacity_tokens")).orderBy("container_type").limit(MOST_TYPES + 1).collect()
    if len(types) > MOST_TYPES:
        raise ValueError(f"at most {MOST_TYPES} container types")
    kinds = [F.struct(F.lit(k).alias("container_type"), F.lit(int(c)).cast("long").alias("capacity_tokens")) for k, c in types]
    if not kinds:
        return spark.createDataFrame([], ASSIGNED)
    every = sized.select("doc_id", "row_id", "tokens", F.inline(F.array(*kinds))).withColumn("full", F.floor(F.col("tokens") / F.col("capacity_tokens")))
    full = every.where("full > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("k")).select(
        "container_type", F.concat_ws("-", "container_type", F.lit("full"), "row_id", "k").alias("container_id"), "doc_id",
        (F.col("k") + 1).cast("int").alias("piece_no"), (F.col("k") * F.col("capacity_tokens")).alias("token_start"), F.col("capacity_tokens").alias("tokens"),
    )
    rest = every.where("tokens = 0 or tokens > full * capacity_tokens").select(
        "container_type", "capacity_tokens", F.pmod(F.xxhash64("doc_id", "row_id"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "row_id",
        (F.col("full") + 1).cast("int").alias("piece_no"), (F.col("full") * F.col("capacity_tokens")).alias("token_start"),
        (F.col("tokens") - F.col("full") * F.col("capacity_tokens")).alias("tokens"),
    )
    return rest.groupBy("container_type", "block").applyInPandas(_pack_block, ASSIGNED).unionByName(full)


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per container type: documents, containers, tokens and the share of capacity left unused."""
    types = rt.table(spark, sf_dir, "containers", "container_type", "capacity_tokens").groupBy("container_type").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    filled = assignments(spark, sf_dir).groupBy("container_type", "container_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
    per_type = filled.groupBy("container_type").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest")
    )
    return per_type.join(types, "container_type").select(
        "container_type", "capacity_tokens", "pieces", "containers", "tokens", "fullest",
        F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("unused_share"),
    )
