"""Event-driven tasks: latest state, activity, queue order, percentiles, smoothed speed; and a keyed store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon import runtime as rt

TERMINAL = ["completed", "failed", "cancelled"]


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event of every key; a maximum of structs, aggregated before the shuffle."""
    rest = [c for c in events.columns if c not in (key, *order)]
    out = events.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("r"))
    return out.select(key, *[F.col(f"r.{c}").alias(c) for c in (*order, *rest)])


def normalized_progress(loaded: Column, total: Column, progress: Column) -> Column:
    ratio = F.when(total > 0, loaded / total).otherwise(F.when(progress > 1, progress / 100).otherwise(progress))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(ratio, F.lit(0.0))))


def section_activity(tasks: DataFrame) -> DataFrame:
    """Running tasks per section: count and mean progress."""
    return tasks.where("status = 'active'").groupBy("section").agg(F.count(F.lit(1)).alias("running"), F.round(F.avg("progress"), 6).alias("mean_progress"))


def runnable(tasks: DataFrame, slots: int = 4) -> DataFrame:
    """Next queued tasks by priority (high first), creation and id, as many as slots are free."""
    return tasks.where("status = 'queued'").orderBy(F.col("priority").desc(), "created_at", "id").limit(slots)


def kept_snapshot(tasks: DataFrame, keep: int = 100) -> DataFrame:
    """The last `keep` tasks of the queue order (its low-priority tail)."""
    return tasks.orderBy(F.col("priority"), F.col("created_at").desc(), F.col("id").desc()).limit(keep)


def restored(tasks: DataFrame) -> DataFrame:
    """After a restart active tasks are queued again if they resume by themselves, else interrupted."""
    return tasks.withColumn("status", F.when(F.col("status") == "active", F.when(F.col("auto_resume"), "queued").otherwise("interrupted")).otherwise(F.col("status")))


def timing_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, mean, nearest-rank p50 and p95, maximum; exact, and no key's values have to fit in one task. Null values do not count."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg("__v"), 6).alias("mean"), F.max("__v").alias("max"))
    ranked = rt.row_numbers(rows, keys, ["__v"], "__rank").join(F.broadcast(sums) if rt.fits_broadcast(sums) else sums, keys)
    at = lambda p: F.max(F.when(F.col("__rank") == F.greatest(F.lit(1), F.ceil(F.col("samples") * p)), F.col("__v")))
    return ranked.groupBy(*keys, "samples", "mean", "max").agg(at(0.5).alias("p50"), at(0.95).alias("p95")).select(*keys, "samples", "mean", "p50", "p95", "max")


def smoothed_by(df: DataFrame, key: str, order: list[str], value: str, keep: float = 0.65) -> DataFrame:
    """(key, speed): the running speed after the last row of every key, as a weighted sum, so that no key's rows are collected.

    The speed is keep x old + (1 - keep) x new: a row k from the end weighs (1 - keep) keep^k, the first one keep^(n - 1).
    """
    rows = rt.row_numbers(df.select(key, *order, F.col(value).alias("__v")), [key], order, "__n")
    last = rows.groupBy(key).agg(F.max("__n").alias("__last"))
    aged = rt.skew_join(rows, last, [key], "inner").withColumn("age", F.pow(F.lit(keep), (F.col("__last") - F.col("__n")).cast("double")))
    weight = F.when(F.col("__n") == 1, F.col("age")).otherwise(F.col("age") * (1 - keep))
    return aged.groupBy(key).agg(F.sum(F.col("__v") * weight).alias("speed"))


def smoothed(values: Column) -> Column:
    """Running speed 0.65 old + 0.35 new over an ordered array; null for an empty one."""
    first = F.get(values, F.lit(0))
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), first, lambda s, x: s * 0.65 + x * 0.35)


class KeyedStore:
    """Rows by key in a parquet table: put, delete, clear, get; every write makes a new version and removes the old one.

    Of several rows of one key in one put the last by all its columns counts. Frames read before a write are not to be used after it.
    """

    def __init__(self, rows: DataFrame, key: str = "id"):
        self.key = key
        self.rows = rt.written(rows, "store")

    def all(self) -> DataFrame:
        return self.rows.select("*")

    def one(self, value: object) -> DataFrame:
        return self.rows.where(F.col(self.key) == F.lit(value)).limit(1)

    def put(self, rows: DataFrame) -> None:
        new = rows.select(self.rows.columns).groupBy(self.key).agg(F.max(F.struct(*self.rows.columns)).alias("r")).select("r.*")
        kept = self.rows.join(new.select(self.key), self.key, "left_anti")
        self._replace(kept.select(self.rows.columns).unionByName(new))

    def delete(self, keys: DataFrame) -> None:
        self._replace(self.rows.join(keys.select(self.key).distinct(), self.key, "left_anti").select(self.rows.columns))

    def clear(self) -> None:
        self._replace(self.rows.limit(0))

    def _replace(self, rows: DataFrame) -> None:
        old, self.rows = self.rows, rt.written(rows, "store")
        rt.forget(old)
