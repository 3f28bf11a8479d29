"""Accepted review decisions applied: proposals merged into a pack's tables, repaired pages as sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon import runtime as rt
from quillon.functions import text as tx
from quillon.sources import documents

ITEM = "kind string, name string, type string, aliases array<string>, text string, quote string, subject string, object string, source string, target string"


def accepted(candidates: DataFrame) -> DataFrame:
    """Accepted candidates; accepting one that is not eligible is an error, raised where it is met."""
    bad = F.raise_error(F.concat(F.lit("candidate cannot be accepted: "), F.coalesce(F.col("id"), F.lit(""))))
    rows = candidates.where("decision = 'accept'")
    return rows.withColumn("eligible", F.when(F.coalesce("eligible", F.lit(False)), F.lit(True)).otherwise(bad)).where("eligible")


def _key(c: Column) -> Column:
    return F.lower(F.trim(c))


def merged(items: DataFrame, sections: DataFrame, entities: DataFrame, claims: DataFrame, relations: DataFrame) -> dict[str, DataFrame]:
    """Proposed items of a pack put into its tables.

    items (document_id, section_id, kind entity / claim / relation, name, type, aliases, text, quote, subject, object, source,
    target); sections (document_id, section_id, text); entities (entity_id, name, type, aliases); claims (claim_id); relations
    (relation_id). A name means the entity of that name or alias, whatever its case, else a new one; claims need a quote that
    stands in their section; what exists already stays. Returns new and changed rows: entities, claims, relations, links
    (document_id, section_id, entity_id).
    """
    items = rt.written(items, "review-items")
    named = lambda kind, c: items.where(F.col("kind") == kind).select("document_id", "section_id", F.col(c).alias("name"), F.lit(None).cast("string").alias("type"), F.array().cast("array<string>").alias("aliases"))
    own = items.where("kind = 'entity'").select("document_id", "section_id", "name", "type", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    quoted = items.where("kind = 'claim'").join(sections.select("document_id", "section_id", F.col("text").alias("body")), ["document_id", "section_id"])
    quoted = rt.written(quoted.where(F.col("body").contains(F.col("quote")) & (F.trim("text") != "")).drop("body"), "review-claims")
    said = lambda c: quoted.select("document_id", "section_id", F.col(c).alias("name"), F.lit(None).cast("string").alias("type"), F.array().cast("array<string>").alias("aliases"))
    places = own.unionByName(said("subject")).unionByName(said("object")).where(F.trim("name") != "")
    every = places.unionByName(named("relation", "source")).unionByName(named("relation", "target")).where(F.trim("name") != "")
    names = every.groupBy(_key(F.col("name")).alias("key")).agg(
        F.min(F.trim("name")).alias("name"), F.min("type").alias("type"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("aliases")))).alias("aliases")  # aliases of one name
    )
    known = entities.select("entity_id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n")).groupBy(_key(F.col("n")).alias("key")).agg(F.min("entity_id").alias("found"))
    plain = F.concat(F.lit("entity."), tx.slugify(F.col("name")))
    resolved = names.join(known, "key", "left").withColumn("plain", plain)
    taken = entities.select(F.col("entity_id").alias("plain")).distinct().withColumn("taken", F.lit(True))
    twice = resolved.where("found is null").groupBy("plain").agg(F.count(F.lit(1)).alias("same"))
    resolved = resolved.join(taken, "plain", "left").join(twice, "plain", "left")
    made = F.when(F.col("taken") | (F.col("same") > 1), tx.stable_id(F.col("plain"), F.col("name"))).otherwise(F.col("plain"))
    resolved = rt.written(resolved.select("key", F.coalesce("found", made).alias("entity_id"), "name", F.coalesce("type", F.lit("term")).alias("type"), "aliases", F.col("found").isNull().alias("created")), "review-names")
    ids = resolved.select("key", "entity_id")
    of = lambda df, c: df.join(ids.select(F.col("key").alias(f"{c}_key"), F.col("entity_id").alias(f"{c}_id")), _key(F.col(c)) == F.col(f"{c}_key"), "left").drop(f"{c}_key")
    made_claims = of(of(quoted, "subject"), "object")
    claim_id = tx.stable_id(F.lit("claim"), F.col("document_id"), F.col("section_id"), F.col("text"))
    made_claims = made_claims.select(claim_id.alias("claim_id"), F.trim("text").alias("text"), F.lit("reviewed").alias("authority"), "subject_id", "object_id", "document_id", "section_id", "quote")
    made_claims = made_claims.dropDuplicates(["claim_id"]).join(claims.select("claim_id"), "claim_id", "left_anti")
    between = of(of(items.where("kind = 'relation' and type is not null"), "source"), "target").where("source_id is not null and target_id is not null")
    relation_id = tx.stable_id(F.lit("relation"), F.col("source_id"), F.col("type"), F.col("target_id"))
    predicate = F.coalesce(F.nullif(F.regexp_replace(F.lower(F.trim("type")), "[^a-z0-9_]+", "_"), F.lit("")), F.lit("related_to"))
    made_relations = between.select(relation_id.alias("relation_id"), "source_id", "target_id", predicate.alias("predicate")).dropDuplicates(["relation_id"])
    return {
        "entities": resolved.where("created or size(aliases) > 0").drop("key"), "claims": made_claims,
        "relations": made_relations.join(relations.select("relation_id"), "relation_id", "left_anti"),
        "links": places.join(ids, _key(F.col("name")) == F.col("key")).select("document_id", "section_id", "entity_id").distinct(),
    }


def accepted_pages(candidates: DataFrame, limit: int = documents.MAX_SECTION) -> DataFrame:
    """(candidate_id, page, section_id, title, body) of accepted pages' repaired texts; blank texts have none."""
    rows = candidates.where("decision = 'accept'").select(F.col("candidate_id").alias("document_id"), F.coalesce("page", F.lit(1)).alias("page"), "text")
    return documents.page_sections(rows, limit).withColumnRenamed("document_id", "candidate_id")
