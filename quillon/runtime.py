"""Session-level helpers: shared folder, written intermediates, skew-safe joins."""

from __future__ import annotations

import atexit
import hashlib
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key that a single task handles without trouble.
HOT_ROWS = 100_000
#: Most keys ever salted, the most frequent ones; any other key has less than 1/HOT_KEYS of the rows.
HOT_KEYS = 100_000
#: Members of one key that are compared with each other in a single task.
PAIR_BLOCK = 4_000
#: Rows below which a side may be broadcast (checked by counting, see fits_broadcast).
BROADCAST_ROWS = 400_000
#: Bytes of a broadcast side at most.
BROADCAST_BYTES = 24 << 20

_local_root: str | None = None


def build_session(app: str = "quillon", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only in local mode (tests) may it be unset; then a temporary folder is made,
    set as the checkpoint folder and removed when the process ends. A cluster
    without the setting is an error, as no folder of one machine serves all.
    """
    global _local_root
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(?:\[[^\]]*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder all executors share (master {master})")
    if _local_root is None or not os.path.isdir(_local_root):
        _local_root = tempfile.mkdtemp(prefix="quillon-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_local_root)
    return "file://" + _local_root


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Cut lineage with a parquet table in the shared folder and read it back.

    The table survives the loss of any executor.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path).select(df.columns)
    out.__dict__["_written_at"] = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Remove written tables that nothing needs any more."""
    for df in tables:
        path = None if df is None else df.__dict__.pop("_written_at", None)
        if path is not None:
            drop_path(df.sparkSession, path)


def _file_system(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Sorted names in a folder of a bounded number of entries; none if there is no such folder."""
    fs, at = _file_system(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def touch(spark: SparkSession, path: str) -> None:
    """Create an empty file, which marks a write as complete."""
    fs, at = _file_system(spark, path)
    fs.create(at, True).close()


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table."""
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def files_state(spark: SparkSession, *paths: str) -> str:
    """Digest of names, sizes and times of the files below the paths: it changes when they do. Lists files, reads none."""
    digest = hashlib.sha256()
    for path in paths:
        fs, at = _file_system(spark, path)
        found, each = [], fs.listFiles(at, True)
        while each.hasNext():
            f = each.next()
            found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
        digest.update("\n".join(sorted(found)).encode())
    return digest.hexdigest()[:24]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One input table; naming the columns prunes the scan and drops unknown extra columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Spread few input partitions over all cores before heavy per-row work.

    Does nothing where the scan already has at least one partition per core, as
    every large input has; so only inputs of a few files are shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() * 2 > cores:
        return df
    return df.repartition(cores, *keys)


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """(keys, rows) of the keys with more than hot_rows rows as a written table, at most the HOT_KEYS most frequent; None if there are none.

    Counts are aggregated before the shuffle.
    """
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > hot_rows)
    if counted.agg(F.count(F.lit(1))).first()[0] == 0:
        return None
    return written(counted.orderBy(F.col("__rows").desc(), *keys).limit(HOT_KEYS), "hot-keys")


def skew_join(
    many: DataFrame,
    one: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    salts: int = 32,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Equi-join of a skewed side with a side that has few rows per key.

    Hot keys of `many` are counted (pre-aggregated before the shuffle) and only
    these are salted: their rows are spread over `salts` partitions, the matching
    rows of `one` are repeated once per salt. Results equal a plain join.
    """
    keys = list(keys)
    hot = hot_keys(many, keys, hot_rows)
    if hot is None:
        return many.join(one, keys, how)
    hot = F.broadcast(hot.select(*keys, F.lit(True).alias("__hot")))  # at most HOT_KEYS keys
    # by the row's own values and its input partition: a recomputed task salts its rows alike, and equal rows spread too
    salt = F.pmod(F.xxhash64(*many.columns) + F.spark_partition_id(), F.lit(salts)).cast("int")
    left = many.withColumn("__own", salt).join(hot, keys, "left")
    left = left.withColumn("__salt", F.when(F.col("__hot"), F.col("__own")).otherwise(F.lit(0))).drop("__own", "__hot")
    every = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = one.join(hot, keys, "left").withColumn("__salt", F.explode(every)).drop("__hot")
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def pairs_within(df: DataFrame, keys: Sequence[str], id_col: str, block: int = PAIR_BLOCK) -> DataFrame:
    """(keys, x, y): x and y are structs of the other columns of any two rows of equal keys, every pair once, x with the lower id.

    A key with more than `block` rows is cut into blocks by a hash of the id, and every pair of blocks is a join key of its
    own, so that no task compares more than 2 x `block` rows. Rows of equal id are no pair; null keys meet nothing.
    """
    keys = list(keys)
    body = F.struct(*[c for c in df.columns if c not in keys])
    hot = hot_keys(df, keys, block)
    if hot is None:
        x, y = df.select(*keys, body.alias("x")), df.select(*keys, body.alias("y"))
        return x.join(y, keys).where(F.col(f"x.{id_col}") < F.col(f"y.{id_col}"))
    sized = df.join(F.broadcast(hot), keys, "left").select(*keys, body.alias("r"), F.coalesce(F.ceil(F.col("__rows") / block).cast("int"), F.lit(1)).alias("n"))
    sized = sized.withColumn("own", F.pmod(F.xxhash64(F.lit(block), F.col(f"r.{id_col}")), F.col("n")).cast("int"))
    first = sized.select(*keys, F.col("r").alias("x"), F.col("own").alias("i"), F.explode(F.sequence("own", F.col("n") - 1)).alias("j"))
    second = sized.select(*keys, F.col("r").alias("y"), F.col("own").alias("j"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"))
    met = first.join(second, [*keys, "i", "j"])
    lower = F.col(f"x.{id_col}") < F.col(f"y.{id_col}")
    met = met.where(F.when(F.col("i") == F.col("j"), lower).otherwise(F.col(f"x.{id_col}") != F.col(f"y.{id_col}")))
    return met.select(*keys, F.when(lower, F.col("x")).otherwise(F.col("y")).alias("x"), F.when(lower, F.col("y")).otherwise(F.col("x")).alias("y"))


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a (written) table was counted and measured small enough to be broadcast."""
    width = F.lit(8 * len(df.columns))
    for name, kind in df.dtypes:
        if kind == "string" or kind.startswith("string collate"):
            width = width + F.coalesce(F.octet_length(name), F.lit(0))
    r = df.select(width.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("b")).first()
    return r["n"] <= rows and (r["b"] or 0) <= size


def checked_semi_join(df: DataFrame, ids: DataFrame, key: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of df whose key is in ids. ids is broadcast only if measured small, else shuffled."""
    return df.join(F.broadcast(ids) if fits_broadcast(ids, limit) else ids, key, "left_semi")


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "row_no") -> DataFrame:
    """df with the 1-based number of every row among the rows of its keys, in order; no key has to fit in one task.

    Rows are range-partitioned by keys and order, so a hot key spreads over many partitions, numbered within each
    partition, and shifted by the counts of the key's earlier partitions (at most one spanning key per boundary).
    """
    from pyspark.sql import Window

    by = [*keys, *order]
    ranged = written(df.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    spanning = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("__parts")).where("__parts > 1").drop("__parts")
    spans = counts.join(spanning, list(keys), "left_semi")
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = spans.select(*keys, "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__shift"))
    own = F.row_number().over(Window.partitionBy("__part", *keys).orderBy(*order))
    out = ranged.withColumn("__own", own).join(F.broadcast(shift), [*keys, "__part"], "left")  # one row per partition boundary
    return out.withColumn(name, (F.col("__own") + F.coalesce("__shift", F.lit(0))).cast("long")).drop("__own", "__shift", "__part")
