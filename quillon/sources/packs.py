"""Building a pack from a folder of texts: documents, bounded sections, discovered entities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import runtime as rt
from quillon.functions import text as tx
from quillon.operators import notes
from quillon.sources import documents

EXTENSIONS = ["md", "markdown", "txt", "json"]


@dataclass
class Pack:
    """Tables of a built pack: (document_id, title, summary, tag), (document_id, section_id, section_order, title, text) and (entity_id, name, aliases)."""

    documents: DataFrame
    sections: DataFrame
    entities: DataFrame


def from_texts(files: DataFrame) -> Pack:
    """files: (relative, text), one row per file; the extension tells how a text is read, other files are left out.

    Sections beyond the limit are cut; ids are slugs with the number of the section in its document. Entities are the
    abbreviations that texts explain, each with its long form as name. Null texts and texts of blanks have no document.
    """
    kind = F.regexp_replace(tx.source_extension(F.col("relative")), r"^\.", "")
    rows = files.withColumn("kind", kind).where(F.col("kind").isin(EXTENSIONS) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    of = lambda *kinds: rows.where(F.col("kind").isin(*kinds))
    read = documents.markdown_documents(of("md", "markdown"), "relative", "text", "relative")
    read = read.unionByName(documents.plain_documents(of("txt"), "relative", "text", "relative"))
    read = read.unionByName(documents.json_documents(of("json"), "relative", "text", "relative"))
    cut = rt.written(documents.sized(read), "pack-sections")
    document_id = F.concat(F.lit("doc."), tx.slugify(F.col("relative")))
    docs = cut.select("relative", "document_title").distinct().select(
        document_id.alias("document_id"), F.col("document_title").alias("title"), F.concat(F.lit("Импортировано из "), "relative").alias("summary"),
        F.regexp_replace(tx.source_extension(F.col("relative")), r"^\.", "").alias("tag"),
    )
    numbered = rt.row_numbers(cut.drop("document_title"), ["relative"], ["at", "part_at"], "n")
    number = F.col("n").cast("string")
    section_id = F.concat(documents.slug_or(F.col("section_id"), F.concat(F.lit("section-"), number)), F.lit("-"), number)
    sections = numbered.select(document_id.alias("document_id"), section_id.alias("section_id"), F.col("n").alias("section_order"), "title", F.col("body").alias("text"))
    pairs = notes.abbreviations(sections.select("document_id", "text"), "document_id")
    named = pairs.groupBy(F.lower("canonical").alias("key")).agg(F.min("canonical").alias("name"), F.array_sort(F.collect_set("alias")).alias("aliases"))
    entities = named.select(tx.stable_id(F.lit("term"), F.col("key")).alias("entity_id"), "name", "aliases")
    return Pack(docs, sections, entities)


def build(spark: SparkSession, path: str) -> Pack:
    """The pack of the text files below a folder; an error if there are none."""
    root = path.removeprefix("file:").rstrip("/") + "/"
    files = documents.read_text_files(spark, path)
    start = F.locate(root, F.col("path"))
    relative = F.when(start > 0, F.substring(F.col("path"), start + len(root), F.length("path"))).otherwise(F.col("path"))
    pack = from_texts(files.select(relative.alias("relative"), "text"))
    if pack.documents.isEmpty():
        raise ValueError(f"no text files ({', '.join(EXTENSIONS)}) below {path}")
    return pack


def as_json(pack: Pack, pack_id: str, version: str = "1.0.0", title: str | None = None, language: str = "ru") -> dict[str, DataFrame]:
    """The tables of the relational export of a built pack, for write_pack_json and restore."""
    spark = pack.documents.sparkSession
    manifest = spark.createDataFrame([(pack_id, version, title or pack_id, language)], "id string, version string, title string, language string")
    has = [F.lit(f in ("documents", "entities")).alias(f"has_{f}") for f in ("documents", "entities", "claims", "relations", "statementRelations")]
    packs = manifest.select(F.col("id").alias("pack_id"), F.to_json(F.struct(F.lit(1).alias("schemaVersion"), "id", "version", "title", "language")).alias("manifest_json"), *has)
    one = pack.documents.withColumns({"pack_id": F.lit(pack_id), "all": F.lit(0)})
    docs = rt.row_numbers(one, ["all"], ["document_id"], "n").select(
        "pack_id", (F.col("n") - 1).alias("document_order"), "document_id", "title",
        F.to_json(F.struct(F.col("document_id").alias("id"), "title", "summary", F.lit("reference").alias("authority"), F.array("tag").alias("tags"))).alias("payload_json"), F.lit(True).alias("has_sections"),
    )
    body = F.to_json(F.struct(F.col("section_id").alias("id"), "title", "text"))
    sections = pack.sections.join(docs.select("document_id", "document_order"), "document_id").select(
        F.lit(pack_id).alias("pack_id"), "document_order", "document_id", (F.col("section_order") - 1).alias("section_order"), "section_id", "title", "text", body.alias("payload_json")
    )
    ents = rt.row_numbers(pack.entities.withColumn("all", F.lit(0)), ["all"], ["name", "entity_id"], "n")
    ents = ents.select(F.lit(pack_id).alias("pack_id"), (F.col("n") - 1).alias("row_order"), F.to_json(F.struct(F.col("entity_id").alias("id"), "name", "aliases")).alias("payload_json"))
    none = spark.createDataFrame([], "pack_id string, row_order int, payload_json string")
    return {"packs": packs, "documents": docs, "sections": sections, "entities": ents, "claims": none, "relations": none, "statement_relations": none}
