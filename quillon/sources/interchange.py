"""Relational export of packs, its inverse, and JSON texts of packs of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


TABLES = ["packs", "documents", "sections", "entities", "claims", "relations", "statement_relations"]
ARRAYS = {"entities": "entities", "claims": "claims", "relations": "relations", "statement_relations": "statementRelations"}
#: Place of a line after all sections of a document.
LAST = (1 << 31) - 1


def _array(v: str, field: str) -> Column:
    """An array field of a map of JSON values; null if it is absent or no array."""
    return F.expr(f"try_cast({v}['{field}'] AS array<variant>)")


def export(packs: DataFrame) -> dict[str, DataFrame]:
    """Seven tables of packs (pack_id, json): numbers of order and payloads keep every field of every record, also unknown ones.

    Arrays that a pack does not have stay absent (has_…); objects lose nothing but the order of their keys.
    """
    top = packs.select("pack_id", F.from_json("json", "map<string,variant>").alias("top"))
    arrays = ["documents", *ARRAYS.values()]
    own = F.to_json(F.map_filter("top", lambda k, v: ~k.isin(arrays)))
    out = {"packs": top.select("pack_id", own.alias("manifest_json"), *[_array("top", f).isNotNull().alias(f"has_{f}") for f in arrays])}
    docs = top.select("pack_id", F.posexplode(_array("top", "documents")).alias("document_order", "v")).select("pack_id", "document_order", F.expr("cast(v AS map<string,variant>)").alias("d"))
    out["documents"] = docs.select(
        "pack_id", "document_order", F.expr("try_cast(d['id'] AS string)").alias("document_id"), F.expr("try_cast(d['title'] AS string)").alias("title"),
        F.to_json(F.map_filter("d", lambda k, v: k != "sections")).alias("payload_json"), _array("d", "sections").isNotNull().alias("has_sections"),
    )
    secs = docs.select("pack_id", "document_order", F.expr("try_cast(d['id'] AS string)").alias("document_id"), F.posexplode(_array("d", "sections")).alias("section_order", "s"))
    text = lambda f: F.expr(f"try_variant_get(s, '$.{f}', 'string')").alias
    out["sections"] = secs.select("pack_id", "document_order", "document_id", "section_order", text("id")("section_id"), text("title")("title"), text("text")("text"), F.to_json("s").alias("payload_json"))
    for table, field in ARRAYS.items():
        rows = top.select("pack_id", F.posexplode(_array("top", field)).alias("row_order", "r"))
        out[table] = rows.select("pack_id", "row_order", F.to_json("r").alias("payload_json"))
    return out


def pack_lines(tables: dict[str, DataFrame]) -> DataFrame:
    """(pack_id, part, place, inner, line): the JSON text of every pack as lines; in this order they are the text.

    However large a pack is, none of its records meets another: a line tells from its own number whether a comma goes before it.
    """
    number = lambda n: F.lit(n).cast("int")

    def line(df: DataFrame, part: int, place: Column, inner: Column, text: Column) -> DataFrame:
        return df.select("pack_id", number(part).alias("part"), place.cast("int").alias("place"), inner.cast("int").alias("inner"), text.alias("line"))

    inside = lambda c: F.expr(f"substring({c}, 2, length({c}) - 2)")
    comma = lambda before: F.when(before, ",").otherwise("")
    packs = tables["packs"].withColumn("filled", F.col("manifest_json") != "{}")
    out = line(packs, 0, number(0), number(0), F.concat(F.lit("{"), inside("manifest_json")))
    before = F.col("filled")
    for k, (table, field) in enumerate([("documents", "documents"), *ARRAYS.items()], 1):
        has = packs.where(f"has_{field}")
        out = out.unionByName(line(has, k, number(-1), number(0), F.concat(comma(before), F.lit(f'"{field}":['))))
        out = out.unionByName(line(has, k, number(LAST), number(0), F.lit("]")))
        before = before | F.col(f"has_{field}")
        if table != "documents":
            out = out.unionByName(line(tables[table], k, F.col("row_order"), number(0), F.concat(comma(F.col("row_order") > 0), "payload_json")))
    docs = tables["documents"]
    body = F.concat(comma(F.col("document_order") > 0), F.lit("{"), inside("payload_json"))
    opened = F.concat(comma(F.col("payload_json") != "{}"), F.lit('"sections":['))
    out = out.unionByName(line(docs, 1, F.col("document_order"), number(-1), F.concat(body, F.when(F.col("has_sections"), opened).otherwise("}"))))
    out = out.unionByName(line(docs.where("has_sections"), 1, F.col("document_order"), number(LAST), F.lit("]}")))
    out = out.unionByName(line(tables["sections"], 1, F.col("document_order"), F.col("section_order"), F.concat(comma(F.col("section_order") > 0), "payload_json")))
    return out.unionByName(line(packs, 9, number(0), number(0), F.lit("}")))


def line_json(lines: DataFrame) -> DataFrame:
    """Lines of packs with `json`, what a line says as a JSON value of its own; null for lines that only close something."""
    bare = F.regexp_replace("line", "^,", "")
    own = F.when(F.col("part") == 0, F.concat(bare, F.lit("}"))).when(F.col("line").isin("]", "]}", "}"), None)
    own = own.when(F.col("place") == -1, F.concat(F.lit("{"), bare, F.lit("]}")))
    opened = (F.col("part") == 1) & (F.col("inner") == -1) & F.col("line").endswith("[")
    return lines.withColumn("json", own.when(opened, F.concat(bare, F.lit("]}"))).otherwise(bare))


def export_lines(lines: DataFrame) -> dict[str, DataFrame]:
    """The seven tables of packs given as lines (see pack_lines), record by record, so that a pack may be of any size."""
    own, fields = line_json(lines), ["documents", *ARRAYS.values()]
    records = own.where("place >= 0 and json is not null")
    head = own.where("part = 0 or place = -1").groupBy("pack_id").agg(
        F.max(F.when(F.col("part") == 0, F.to_json(F.from_json("json", "map<string,variant>")))).alias("manifest_json"),
        *[F.bool_or((F.col("part") == k) & (F.col("place") == -1)).alias(f"has_{f}") for k, f in enumerate(fields, 1)],
    )
    out = {"packs": head}
    docs = records.where("part = 1 and inner = -1").select("pack_id", F.col("place").alias("document_order"), F.from_json("json", "map<string,variant>").alias("d"))
    out["documents"] = docs.select(
        "pack_id", "document_order", F.expr("try_cast(d['id'] AS string)").alias("document_id"), F.expr("try_cast(d['title'] AS string)").alias("title"),
        F.to_json(F.map_filter("d", lambda k, v: k != "sections")).alias("payload_json"), _array("d", "sections").isNotNull().alias("has_sections"),
    )
    secs = records.where("part = 1 and inner >= 0").select("pack_id", F.col("place").alias("document_order"), F.col("inner").alias("section_order"), F.parse_json("json").alias("s"))
    text = lambda f: F.expr(f"try_variant_get(s, '$.{f}', 'string')").alias
    secs = secs.select("pack_id", "document_order", "section_order", text("id")("section_id"), text("title")("title"), text("text")("text"), F.to_json("s").alias("payload_json"))
    ids = out["documents"].select("pack_id", "document_order", "document_id")
    out["sections"] = secs.join(ids, ["pack_id", "document_order"], "left").select("pack_id", "document_order", "document_id", *secs.columns[2:])
    for k, table in enumerate(ARRAYS, 2):
        out[table] = records.where(F.col("part") == k).select("pack_id", F.col("place").alias("row_order"), F.to_json(F.parse_json("json")).alias("payload_json"))
    return out


def pack_digests(lines: DataFrame) -> DataFrame:
    """(pack_id, digest) of packs given as lines: equal if the lines are, but for the order of keys. Summed over the lines, so no pack meets in a task before it is one row."""
    said = F.coalesce(F.to_json(F.parse_json("json")), "line")
    comma = F.when(F.startswith("line", F.lit(",")), ",").otherwise("")
    each = line_json(lines).select("pack_id", F.sha2(F.concat_ws("␟", "part", "place", "inner", comma, said), 256).alias("h"))
    part = lambda at: F.sum(F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return each.groupBy("pack_id").agg(F.concat_ws(":", F.count(F.lit(1)), part(1), part(16), part(31)).alias("digest"))


def write_pack_json(tables: dict[str, DataFrame], path: str) -> None:
    """Text files below path whose lines, file by file, are the JSON texts of the packs in the order of their ids."""
    order = ["pack_id", "part", "place", "inner"]
    pack_lines(tables).repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.text(path)


def restore(tables: dict[str, DataFrame]) -> DataFrame:
    """(pack_id, json): every pack in one value; for packs that fit into a row. write_pack_json has no such bound."""
    lines = pack_lines(tables).groupBy("pack_id").agg(F.array_sort(F.collect_list(F.struct("part", "place", "inner", "line"))).alias("x"))
    return lines.select("pack_id", F.array_join(F.transform("x", lambda r: r["line"]), "").alias("json"))


def write(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-independent digest of all rows: sum of row hashes and count, aggregated in partitions first."""
    row = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(row).cast("string").alias("digest"))


def artifact_state(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """Prebuilt indexes that may be reused: same id, digest and fingerprint."""
    return wanted.join(stored, ["id", "sha256", "fingerprint"], "left_semi")


