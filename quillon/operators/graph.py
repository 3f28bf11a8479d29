"""The corpus as a property graph: merged nodes with weighted categories, de-duplicated edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import runtime as rt
from quillon.operators import model

EXPLICIT, INFERRED, INHERITED, UNKNOWN = 3, 2, 1, 0


def inferred_category(*parts: Column) -> Column:
    """Array of (id, weight) from the words of a node's own text; empty if they say nothing."""
    text = F.lower(F.concat_ws(" ", *parts))
    both = F.array(F.struct(F.lit("pediatrics").alias("id"), F.lit(0.5).alias("weight")), F.struct(F.lit("dentistry").alias("id"), F.lit(0.5).alias("weight")))
    one = lambda name: F.array(F.struct(F.lit(name).alias("id"), F.lit(1.0).alias("weight")))
    child = text.rlike(r"pediatr|детск|реб[её]н|младен|груднич")
    tooth = text.rlike(r"dent|стомат|зуб")
    eruption = text.rlike(r"прорезыван[а-я]*\s+зуб|срок[а-я]*\s+прорезыван|tooth\s+eruption")
    return F.when(eruption | (child & tooth), both).when(child, one("pediatrics")).when(tooth, one("dentistry")).otherwise(F.array().cast("array<struct<id:string,weight:double>>"))


def explicit_categories(json: Column) -> Column:
    given = F.coalesce(F.from_json(json, "array<struct<id:string,weight:double>>"), F.array().cast("array<struct<id:string,weight:double>>"))
    named = F.filter(given, lambda c: c["id"].isNotNull() & (F.trim(c["id"]) != ""))
    return F.transform(named, lambda c: F.struct(F.trim(c["id"]).alias("id"), F.when(c["weight"] > 0, c["weight"]).otherwise(1.0).alias("weight")))


def nodes_raw(spark: SparkSession, d: str) -> DataFrame:
    """Every appearance of a node: (id, type, label, pack_id, seen, categories, priority)."""
    pack = model.packs(spark, d)
    given = explicit_categories(F.col("categories_json"))
    guess = inferred_category(F.col("id"), F.col("title"), F.col("kind"), F.col("description"))
    pack = pack.select(
        F.col("id").alias("pack_id"), "title", F.when(F.size(given) > 0, given).otherwise(guess).alias("pack_categories"),
        F.when(F.size(given) > 0, EXPLICIT).when(F.size(guess) > 0, INFERRED).otherwise(UNKNOWN).alias("pack_priority"),
    )
    own = lambda own_c, parent: (
        F.when(F.size(own_c) > 0, own_c).otherwise(parent), F.when(F.size(own_c) > 0, INFERRED).when(F.size(parent) > 0, INHERITED).otherwise(UNKNOWN),
    )
    row = lambda id_, kind, label, seen, c, p: [
        id_.alias("id"), F.lit(kind).alias("type"), label.alias("label"), F.col("pack_id"), seen.alias("seen"), c.alias("categories"), p.alias("priority"),
    ]
    packs = pack.select(*row(F.concat(F.lit("pack:"), "pack_id"), "pack", F.col("title"), F.lit(0).cast("long"), F.col("pack_categories"), F.col("pack_priority")))
    doc = model.documents(spark, d).join(pack.select("pack_id", "pack_categories"), "pack_id")
    dc, dp = own(inferred_category(F.col("title"), F.col("summary"), F.col("tags_json")), F.col("pack_categories"))
    docs = doc.select(*row(F.concat_ws(":", F.lit("document"), "pack_id", "document_id"), "document", F.col("title"), F.col("document_order"), dc, dp))
    sec = rt.skew_join(
        model.sections(spark, d, False).select("section_row", "pack_id", "document_id", "section_id", "title", "tags_json"),
        doc.select("pack_id", "document_id", dc.alias("document_categories")), ["pack_id", "document_id"], "inner",
    )
    sc, sp = own(inferred_category(F.col("title"), F.col("tags_json")), F.col("document_categories"))
    secs = sec.select(*row(F.concat_ws(":", F.lit("section"), "pack_id", "document_id", "section_id"), "section", F.col("title"), F.col("section_row"), sc, sp))
    ent = model.entities(spark, d).join(pack.select("pack_id", "pack_categories"), "pack_id")
    ec, ep = own(inferred_category(F.col("name"), F.col("type"), F.col("description")), F.col("pack_categories"))
    ents = ent.select(*row(F.concat(F.lit("concept:"), "entity_id"), "concept", F.col("name"), F.col("entity_order"), ec, ep))
    return packs.unionByName(docs).unionByName(secs).unionByName(ents)


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes merged by id: last label, packs, categories of the highest priority with weights summing to 1."""
    raw = nodes_raw(spark, d)
    merged = raw.groupBy("id", "type").agg(
        F.max(F.struct("seen", "pack_id", "label")).getField("label").alias("label"), F.count_distinct("pack_id").alias("pack_count"), F.max("priority").alias("priority")
    )
    weights = category_weights(raw).groupBy("id").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat("category", F.lit("="), F.format_string("%.4f", "weight")))), ",").alias("categories")  # few per node
    )
    return merged.join(weights, "id", "left").select("id", "type", "label", "pack_count", "priority", F.coalesce("categories", F.lit("")).alias("categories"))


def category_weights(raw: DataFrame) -> DataFrame:
    """(id, category, weight) of the appearances with a node's highest priority, normalised per node."""
    top = raw.groupBy("id").agg(F.max("priority").alias("top"))
    each = raw.join(top, "id").where("priority = top").select("id", F.explode("categories").alias("c")).groupBy("id", F.col("c.id").alias("category")).agg(F.sum("c.weight").alias("w"))
    total = each.groupBy("id").agg(F.sum("w").alias("total"))
    return each.join(total, "id").select("id", "category", (F.col("w") / F.col("total")).alias("weight"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """contains and mentions edges between existing nodes, each once, without loops: (type, source, target)."""
    pack = model.packs(spark, d).select(F.col("id").alias("pack_id"))
    doc = model.documents(spark, d).join(pack, "pack_id").select("pack_id", "document_id")
    sec = rt.skew_join(model.sections(spark, d, False).select("pack_id", "document_id", "section_id", "entity_ids_json"), doc, ["pack_id", "document_id"], "left_semi")
    node = lambda kind, *c: F.concat_ws(":", F.lit(kind), *c)
    edge = lambda df, kind, a, b: df.select(F.lit(kind).alias("type"), a.alias("source"), b.alias("target"))
    refs = sec.select("pack_id", "document_id", "section_id", F.explode(model.strings("entity_ids_json")).alias("entity_id"))
    refs = rt.skew_join(refs, model.entities(spark, d).select("pack_id", "entity_id"), ["pack_id", "entity_id"], "left_semi")
    out = (
        edge(doc, "contains", node("pack", "pack_id"), node("document", "pack_id", "document_id"))
        .unionByName(edge(sec, "contains", node("document", "pack_id", "document_id"), node("section", "pack_id", "document_id", "section_id")))
        .unionByName(edge(refs, "mentions", node("section", "pack_id", "document_id", "section_id"), node("concept", "entity_id")))
    )
    return out.where("source <> target").distinct()


def ego_network(edge_rows: DataFrame, node_id: str) -> DataFrame:
    """Neighbours one step from a node, with direction and edge type."""
    out = edge_rows.where(F.col("source") == node_id).select(F.col("target").alias("neighbour"), "type", F.lit("out").alias("direction"))
    into = edge_rows.where(F.col("target") == node_id).select(F.col("source").alias("neighbour"), "type", F.lit("in").alias("direction"))
    return out.unionByName(into)


def layout(node_rows: DataFrame, width: int = 240, height: int = 64) -> DataFrame:
    """Columns by type, rows by label: (id, x, y)."""
    order = F.array_position(F.array(*map(F.lit, ["pack", "document", "section", "concept"])), F.col("type")) - 1
    keyed = node_rows.select("id", "type", F.coalesce("label", F.lit("")).alias("label"), order.alias("column"))
    rows = rt.row_numbers(keyed, ["type"], ["label", "id"], "row")
    return rows.select("id", (F.col("column") * width).cast("int").alias("x"), ((F.col("row") - 1) * height).cast("int").alias("y"))
