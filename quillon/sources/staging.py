"""Declarative staging of files and databases into parquet tables with provenance."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from quillon import runtime as rt

# Options each file type may set, and settings a configuration must not have.
ALLOWED = {
    "csv": "header all_varchar auto_detect delim quote escape nullstr union_by_name filename hive_partitioning".split(),
    "json": "auto_detect format records maximum_object_size union_by_name filename".split(),
    "parquet": "union_by_name filename file_row_number hive_partitioning".split(),
}
DATABASES = ["sqlite", "postgres", "mysql"]
FORBIDDEN = "sql query where dsn password token secret user connection".split()


class ConfigError(ValueError):
    """A staging configuration that is not allowed."""


@dataclass(frozen=True)
class Target:
    name: str
    kind: str
    locator: str
    config: str
    read: Callable[[SparkSession], DataFrame]


def table_name(value: str) -> str:
    name = value.strip().lower()
    if not re.fullmatch(r"[a-z_][a-z0-9_]{0,62}", name) or name.startswith("lnote_"):
        raise ConfigError(f"target name not allowed: {value}")
    return name


def _forbid(tree: object) -> None:
    if isinstance(tree, Mapping):
        for k, v in tree.items():
            if k.lower() in FORBIDDEN:
                raise ConfigError(f"setting not allowed: {k}")
            _forbid(v)
    elif isinstance(tree, list):
        for v in tree:
            _forbid(v)


def _options(kind: str, given: Mapping) -> dict:
    for k in given:
        if k not in ALLOWED[kind]:
            raise ConfigError(f"{kind} has no option {k}")
    return dict(given)


def read_file(spark: SparkSession, kind: str, path: str, o: Mapping) -> DataFrame:
    """csv, json or parquet with the staging options; an option that cannot be honoured is an error.

    union_by_name matches the columns of several files by name (JSON files always are); hive_partitioning false keeps folder
    names out of the columns.
    """
    reader = spark.read
    if o.get("hive_partitioning") is False:
        reader = reader.option("recursiveFileLookup", True)
    if kind == "csv":
        reader = reader.option("header", o.get("header", True)).option("inferSchema", not o.get("all_varchar", False) and o.get("auto_detect", True))
        for ours, sparks in (("delim", "sep"), ("quote", "quote"), ("escape", "escape"), ("nullstr", "nullValue")):
            if ours in o:
                reader = reader.option(sparks, o[ours])
        df = _by_name(spark, reader, path) if o.get("union_by_name") and o.get("header", True) else reader.csv(path)
    elif kind == "json":
        if o.get("auto_detect", True) is not True or o.get("records", "auto") not in (True, "auto", "true") or "maximum_object_size" in o:
            raise ConfigError("of auto_detect, records and maximum_object_size only the defaults are supported")
        df = reader.option("multiLine", o.get("format") == "array").json(path)
    else:
        df = reader.option("mergeSchema", o.get("union_by_name", False)).parquet(path)
    if o.get("filename"):
        df = df.withColumn("filename", F.col("_metadata.file_path"))
    if o.get("file_row_number"):
        df = df.withColumn("file_row_number", F.col("_metadata.row_index"))
    return df


def _by_name(spark: SparkSession, reader: DataFrameReader, path: str) -> DataFrame:
    """CSV files with different columns: files of one header are read at once, and the few headers united by name."""
    heads = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
    heads = heads.where("at = 0").groupBy("file").agg(F.first("value").alias("head"))  # the first line of a file's first block
    groups: dict[str, list[str]] = {}
    for r in heads.collect():
        groups.setdefault(r["head"], []).append(r["file"])
    out = None
    for head in sorted(groups):
        df = reader.csv(sorted(groups[head]))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return reader.csv(path) if out is None else out


def plan(config: Mapping, base: str = ".", environment: Mapping | None = None) -> list[Target]:
    """Targets of a configuration {schemaVersion: 1, sources: [...]}; nothing is read yet."""
    if config.get("schemaVersion") != 1 or not config.get("sources"):
        raise ConfigError("schemaVersion 1 and sources are required")
    _forbid([{k: v for k, v in s.items() if k != "secretEnv"} for s in config["sources"]])
    environment = os.environ if environment is None else environment
    out: list[Target] = []
    for s in config["sources"]:
        kind = s.get("type")
        shown = json.dumps({k: v for k, v in s.items() if k != "secretEnv"}, sort_keys=True, ensure_ascii=False)
        if kind in ALLOWED:
            if re.match(r"^[a-z]+://", s["path"]):
                raise ConfigError("only local paths may be staged")
            path, options = os.path.join(base, s["path"]), _options(kind, s.get("options", {}))
            out.append(Target(table_name(s["table"]), kind, s["path"], shown, lambda spark, k=kind, p=path, o=options: read_file(spark, k, p, o)))
        elif kind == "sqlite":
            from quillon.sources.database import read_sqlite

            for t in s["tables"]:
                out.append(Target(table_name(t["target"]), kind, f"{s['path']}#{t['source']}", shown, lambda spark, p=os.path.join(base, s["path"]), n=t["source"]: read_sqlite(spark, p, n)))
        elif kind in DATABASES:
            secret = {k: environment.get(v, "") for k, v in s.get("secretEnv", {}).items()}
            url = f"jdbc:{'postgresql' if kind == 'postgres' else 'mysql'}://{secret.get('host', 'localhost')}/{secret.get('database', '')}"
            for t in s["tables"]:
                def read(spark: SparkSession, url: str = url, name: str = t["source"], secret: dict = secret) -> DataFrame:
                    return spark.read.format("jdbc").options(url=url, dbtable=name, user=secret.get("user", ""), password=secret.get("password", "")).load()

                out.append(Target(table_name(t["target"]), kind, f"{s.get('alias', kind)}.{t['source']}", shown, read))
        else:
            raise ConfigError(f"source type not allowed: {kind}")
    names = [t.name for t in out]
    if len(set(names)) < len(names):
        raise ConfigError("a target is named twice")
    return out


def redact(text: str, secrets: list[str]) -> str:
    for s in secrets:
        if s:
            text = text.replace(s, "***")
    return text


def stage(spark: SparkSession, targets: list[Target], out: str, staged_at: str) -> DataFrame:
    """Write every target as a parquet table under `out` and return the provenance rows; on a failure nothing is left."""
    try:
        for t in targets:
            t.read(spark).write.mode("error").parquet(f"{out}/{t.name}")
        meta = spark.createDataFrame([(t.name, t.kind, t.locator, t.config, staged_at) for t in targets], "target_table string, source_type string, source_locator string, source_config_json string, staged_at string")
        meta.write.parquet(f"{out}/stage_sources")
        return spark.read.parquet(f"{out}/stage_sources")
    except Exception:
        rt.drop_path(spark, out)
        raise


def missing_targets(staged: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected targets (target_table) that were not staged."""
    return expected.join(staged.select("target_table"), "target_table", "left_anti")
