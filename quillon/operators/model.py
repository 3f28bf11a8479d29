"""The knowledge model: live views, search records, merges, validation, statement conflicts, mentions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import runtime as rt
from quillon.functions import text as tx


def strings(c: str | Column) -> Column:
    """A JSON array of strings as an array; null and unreadable text as an empty one."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def live(df: DataFrame, keys: Sequence[str], order: str, texts: bool = False) -> DataFrame:
    """The last delivery that is not deleted of every key (aggregated before the shuffle, so hot keys do no harm).

    order is a unique row number. texts: rows hold long texts; then only keys and numbers are aggregated, and the rows of
    earlier deliveries, which are few, are left out of a scan that does not shuffle.
    """
    if "deleted_at" in df.columns:
        df = df.where("deleted_at is null").drop("deleted_at")
    if texts:
        slim = df.select(*keys, order)
        last = slim.groupBy(*keys).agg(F.max(order).alias("__last"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
        last = rt.written(last, "delivered-again")
        last = F.broadcast(last) if rt.fits_broadcast(last) else last
        same = [slim[k].eqNullSafe(last[k]) for k in keys]
        earlier = rt.written(slim.join(last, same).where(F.col(order) < F.col("__last")).select(slim[order]), "earlier-deliveries")
        return df.join(F.broadcast(earlier) if rt.fits_broadcast(earlier) else earlier, order, "left_anti").select(df.columns)
    rest = [c for c in df.columns if c not in (*keys, order)]
    last = df.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("r"))
    return last.select(*keys, F.col(f"r.{order}").alias(order), *[F.col(f"r.{c}").alias(c) for c in rest])


def documents(spark: SparkSession, d: str) -> DataFrame:
    cols = ["document_order", "pack_id", "document_id", "title", "summary", "authority", "effective_from", "source_json", "tags_json", "deleted_at"]
    return live(rt.table(spark, d, "lnote_documents", *cols), ["pack_id", "document_id"], "document_order")


def sections(spark: SparkSession, d: str, text: bool = True) -> DataFrame:
    """Live sections, with their texts or without."""
    cols = ["section_row", "pack_id", "document_id", "section_id", "section_order", "title", "entity_ids_json", "tags_json", "deleted_at", *(["text"] if text else [])]
    return live(rt.table(spark, d, "lnote_sections", *cols), ["pack_id", "document_id", "section_id"], "section_row", text)


def entities(spark: SparkSession, d: str) -> DataFrame:
    cols = ["entity_order", "pack_id", "entity_id", "name", "type", "aliases_json", "description"]
    return live(rt.table(spark, d, "lnote_entities", *cols), ["pack_id", "entity_id"], "entity_order")


def claims(spark: SparkSession, d: str) -> DataFrame:
    cols = ["claim_order", "pack_id", "claim_id", "text", "subject_id", "object_id", "source_document_id", "source_section_id", "source_quote", "deleted_at"]
    return live(rt.table(spark, d, "lnote_claims", *cols), ["pack_id", "claim_id"], "claim_order")


def relations(spark: SparkSession, d: str) -> DataFrame:
    cols = ["relation_order", "pack_id", "relation_id", "source_claim_id", "target_claim_id", "type", "status", "reason"]
    return live(rt.table(spark, d, "lnote_statement_relations", *cols), ["pack_id", "relation_id"], "relation_order")


def packs(spark: SparkSession, d: str) -> DataFrame:
    return rt.table(spark, d, "catalog")


def search_records(spark: SparkSession, d: str) -> DataFrame:
    """One denormalised row per live section: pack, document, names of its entities, claims, tags, authority."""
    sec, doc = sections(spark, d), documents(spark, d)
    pack = packs(spark, d).select(F.col("id").alias("pack_id"), F.col("title").alias("pack_title"), F.col("categories_json").alias("pack_tags"))
    ents = entities(spark, d).select("pack_id", "entity_id", "name", strings("aliases_json").alias("aliases"))
    refs = sec.select("section_row", "pack_id", F.posexplode(strings("entity_ids_json")).alias("at", "entity_id"))
    named = rt.skew_join(refs, ents, ["pack_id", "entity_id"], "inner").groupBy("section_row").agg(
        F.array_sort(F.collect_list(F.struct("at", "name", "aliases"))).alias("e")  # the entities of one section
    ).select(
        "section_row",
        F.array_join(F.transform("e", lambda x: x["name"]), " ").alias("entity_names"),
        F.array_join(F.flatten(F.transform("e", lambda x: F.concat(F.array(x["name"]), x["aliases"]))), " ").alias("aliases"),
    )
    said = claims(spark, d).groupBy("pack_id", F.col("source_document_id").alias("document_id"), F.col("source_section_id").alias("section_id")).agg(F.count(F.lit(1)).alias("claim_count"))
    tags = lambda c: F.array_join(strings(c), " ")
    doc = doc.select("pack_id", "document_id", F.col("title").alias("document_title"), "authority", "effective_from", F.col("tags_json").alias("document_tags"))
    return (
        rt.skew_join(sec, doc, ["pack_id", "document_id"], "inner")
        .join(pack, "pack_id", "left")
        .join(named, "section_row", "left")
        .join(said, ["pack_id", "document_id", "section_id"], "left")
        .select(
            F.concat(F.lit("section:"), "pack_id", F.lit(":"), "document_id", F.lit(":"), "section_id").alias("id"), F.lit("section").alias("kind"),
            "pack_id", "pack_title", "document_id", "document_title", "section_id", "title", F.col("text").alias("body"),
            F.coalesce("aliases", F.lit("")).alias("aliases"), F.coalesce("entity_names", F.lit("")).alias("entity_names"),
            F.concat_ws(" ", F.nullif(tags("document_tags"), F.lit("")), F.nullif(tags("tags_json"), F.lit(""))).alias("tags"),
            F.coalesce("authority", F.lit("reference")).alias("authority"), "effective_from", F.coalesce("claim_count", F.lit(0)).alias("claim_count"),
        )
    )


def merged_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities merged over packs by bare id: the first delivery's name, the packs, all aliases, the first description."""
    e = entities(spark, d).withColumn("alias", F.explode_outer(strings("aliases_json")))
    return e.groupBy("entity_id").agg(
        F.min(F.struct("entity_order", "name")).getField("name").alias("name"), F.count_distinct("pack_id").alias("pack_count"),
        F.count_distinct("alias").alias("alias_count"),
        F.min(F.when(F.col("description").isNotNull() & (F.col("description") != ""), F.struct("entity_order", "description"))).getField("description").alias("description"),
    )


def violations(spark: SparkSession, d: str) -> DataFrame:
    """Broken rules of the model per kind: duplicates, references without target, quotes that are not in their section."""
    ent, doc, sec, cla = entities(spark, d), documents(spark, d), sections(spark, d), claims(spark, d)
    raw = rt.table(spark, d, "lnote_sections", "pack_id", "document_id", "section_id")
    ids = ent.select("pack_id", "entity_id")
    refs = sec.select("pack_id", F.explode(strings("entity_ids_json")).alias("entity_id"))
    side = lambda c: cla.where(F.col(c).isNotNull()).select("pack_id", F.col(c).alias("entity_id"))
    named = lambda df, rule: df.select(F.lit(rule).alias("rule"))
    place = cla.select("pack_id", F.col("source_document_id").alias("document_id"), F.col("source_section_id").alias("section_id"), "source_quote")
    keyed = place.where("document_id is not null and section_id is not null")
    quoted = keyed.where("source_quote is not null").join(sec.select("pack_id", "document_id", "section_id", "text"), ["pack_id", "document_id", "section_id"])
    parts = [
        named(raw.groupBy("pack_id", "document_id", "section_id").count().where("count > 1"), "duplicate_section"),
        named(refs.join(ids, ["pack_id", "entity_id"], "left_anti"), "section_unknown_entity"),
        named(side("subject_id").join(ids, ["pack_id", "entity_id"], "left_anti"), "claim_unknown_subject"),
        named(side("object_id").join(ids, ["pack_id", "entity_id"], "left_anti"), "claim_unknown_object"),
        named(place.join(doc.select("pack_id", "document_id"), ["pack_id", "document_id"], "left_anti"), "claim_unknown_document"),
        named(keyed.join(sec.select("pack_id", "document_id", "section_id"), ["pack_id", "document_id", "section_id"], "left_anti"), "claim_unknown_section"),
        named(quoted.where(~F.col("text").contains(F.col("source_quote"))), "quote_not_in_section"),
        named(ent.where("name is null or trim(name) = ''"), "entity_without_name"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))


def conflict_sides(spark: SparkSession, d: str) -> DataFrame:
    """Statement relations that diverge (contradicts, supersedes, different_scope; not dismissed) with both claims resolved."""
    rel = relations(spark, d).where("type in ('contradicts', 'supersedes', 'different_scope') and coalesce(status, 'confirmed') <> 'dismissed'")
    rel = rel.select(
        "relation_order", "pack_id", "relation_id", "type", F.coalesce("status", F.lit("confirmed")).alias("status"),
        tx.qualify(F.col("pack_id"), F.col("source_claim_id")).alias("source_ref"), tx.qualify(F.col("pack_id"), F.col("target_claim_id")).alias("target_ref"),
    )
    doc = documents(spark, d).select(
        F.col("pack_id").alias("p"), F.col("document_id").alias("source_document_id"), F.col("title").alias("document_title"),
        F.coalesce("effective_from", F.get_json_object("source_json", "$.publishedAt"), F.get_json_object("source_json", "$.date")).alias("date"),
    )
    cla = rt.skew_join(claims(spark, d).withColumn("p", F.col("pack_id")), doc, ["p", "source_document_id"], "left")
    side = lambda s: cla.select(
        tx.qualify(F.col("pack_id"), F.col("claim_id")).alias(f"{s}_ref"), F.col("text").alias(f"{s}_text"),
        F.coalesce("document_title", F.col("source_document_id")).alias(f"{s}_document"), F.col("date").alias(f"{s}_date"),
    )
    found = rt.skew_join(rt.skew_join(rel, side("source"), ["source_ref"], "left"), side("target"), ["target_ref"], "left")
    return found.withColumn(
        "resolved", F.col("source_text").isNotNull() & F.col("target_text").isNotNull()
    )


# Types and states of statement relations.
RELATION_TYPES = ["supports", "contradicts", "refines", "supersedes", "equivalent", "different_scope"]
RELATION_STATES = ["proposed", "confirmed", "dismissed"]


def relation_violations(relation_rows: DataFrame, claim_rows: DataFrame) -> DataFrame:
    """(relation_order, rule) of the rules that statement relations break.

    relation_rows: (relation_order, pack_id, relation_id, source_claim_id, target_claim_id, type, status, confidence);
    claim_rows: (pack_id, claim_id). A relation names two different claims, has a type and a state of the lists and a confidence
    from 0 to 1, has an id of its own in its pack, and claims of its own pack exist. A null state or confidence is none.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    ref = {s: tx.qualify(F.col("pack_id"), F.col(f"{s}_claim_id")) for s in ("source", "target")}
    rows = relation_rows.withColumns({f"{s}_ref": c for s, c in ref.items()})
    weight = F.col("confidence").try_cast("double")
    own = F.array_compact(F.array(
        F.when(blank(F.col("relation_id")), "id_missing"), F.when(F.col("source_ref") == "", "source_missing"), F.when(F.col("target_ref") == "", "target_missing"),
        F.when((F.col("source_ref") != "") & (F.col("source_ref") == F.col("target_ref")), "same_statement"),
        F.when(~F.coalesce(F.col("type").isin(RELATION_TYPES), F.lit(False)), "type_unsupported"),
        F.when(F.col("status").isNotNull() & ~F.col("status").isin(RELATION_STATES), "status_unsupported"),
        F.when(F.col("confidence").isNotNull() & ~F.coalesce(weight.between(0, 1), F.lit(False)), "confidence_out_of_range"),
    ))
    broken = rows.select("relation_order", F.explode(own).alias("rule"))
    named = rows.where(~blank(F.col("relation_id"))).select("relation_order", "pack_id", F.trim("relation_id").alias("id"))
    first = named.groupBy("pack_id", "id").agg(F.min("relation_order").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = named.join(first, ["pack_id", "id"]).where("relation_order > first").select("relation_order", F.lit("id_repeated").alias("rule"))
    local = rows.select("relation_order", "pack_id", F.explode(F.array("source_ref", "target_ref")).alias("claim_ref")).where(F.col("claim_ref").startswith(F.concat("pack_id", F.lit("::"))))
    known = claim_rows.select(tx.qualify(F.col("pack_id"), F.col("claim_id")).alias("claim_ref")).distinct()
    missing = rt.skew_join(local, known, ["claim_ref"], "left_anti").select("relation_order", F.lit("statement_unknown").alias("rule"))
    return broken.unionByName(again).unionByName(missing)


def conflict_sections(spark: SparkSession, d: str) -> DataFrame:
    """(section_ref, counterpart): ids of search records whose claims a confirmed diverging relation connects, in both directions."""
    sides = conflict_sides(spark, d).where("resolved and status = 'confirmed'").select("source_ref", "target_ref")
    place = claims(spark, d).select(
        tx.qualify(F.col("pack_id"), F.col("claim_id")).alias("claim_ref"),
        F.concat(F.lit("section:"), "pack_id", F.lit(":"), "source_document_id", F.lit(":"), "source_section_id").alias("ref"),
    ).where("ref is not null")
    a = rt.skew_join(sides, place.select(F.col("claim_ref").alias("source_ref"), F.col("ref").alias("section_ref")), ["source_ref"], "inner")
    both = rt.skew_join(a, place.select(F.col("claim_ref").alias("target_ref"), F.col("ref").alias("counterpart")), ["target_ref"], "inner")
    both = both.select("section_ref", "counterpart").where("section_ref <> counterpart")
    return both.unionByName(both.select(F.col("counterpart").alias("section_ref"), F.col("section_ref").alias("counterpart"))).distinct()


def conflict_annotations(spark: SparkSession, d: str) -> DataFrame:
    """Where conflicts are shown in a section: after the exact quote of a claim in conflict, else at the end of the text.

    (section_row, position, exact, claims, conflicts), one row per position; positions count characters from 0.
    """
    sides = conflict_sides(spark, d).where("resolved")
    ends = sides.select("relation_order", F.explode(F.array_distinct(F.array("source_ref", "target_ref"))).alias("claim_ref"))
    cla = claims(spark, d).select(
        tx.qualify(F.col("pack_id"), F.col("claim_id")).alias("claim_ref"), "pack_id", F.col("source_document_id").alias("document_id"),
        F.col("source_section_id").alias("section_id"), F.trim(F.coalesce("source_quote", F.lit(""))).alias("quote"),
    )
    told = rt.skew_join(ends, cla, ["claim_ref"], "inner")
    body = sections(spark, d).select("section_row", "pack_id", "document_id", "section_id", F.coalesce("text", F.lit("")).alias("text"))
    placed = rt.skew_join(told, body, ["pack_id", "document_id", "section_id"], "inner")
    at = F.when(F.col("quote") != "", F.expr("locate(quote, text)")).otherwise(0)
    placed = placed.select("section_row", "claim_ref", "relation_order", (at > 0).alias("exact"), F.when(at > 0, at - 1 + F.length("quote")).otherwise(F.length("text")).alias("position"))
    return placed.groupBy("section_row", "position").agg(
        F.max("exact").alias("exact"), F.count_distinct("claim_ref").alias("claims"), F.count_distinct("relation_order").alias("conflicts")
    )


def conflicts_by_claim(spark: SparkSession, d: str) -> DataFrame:
    """Symmetric index: per claim the number of diverging relations with resolved sides."""
    c = conflict_sides(spark, d).where("resolved")
    ends = c.select(F.explode(F.array_distinct(F.array("source_ref", "target_ref"))).alias("claim_ref"), "status")
    return ends.groupBy("claim_ref").agg(F.count(F.lit(1)).alias("conflicts"), F.sum((F.col("status") == "confirmed").cast("long")).alias("confirmed"))


def selection_groups(selections: DataFrame, claim_refs: DataFrame) -> DataFrame:
    """Statement selections whose references all resolve: selections (id, group_key, claim_refs, preferred_refs), claim_refs (claim_ref).

    Selections with fewer than two references, or preferring one they do not list, come out as invalid.
    """
    each = selections.select("id", "group_key", "claim_refs", "preferred_refs", F.explode_outer(F.array_distinct("claim_refs")).alias("claim_ref"))
    known = claim_refs.select("claim_ref").distinct().withColumn("known", F.lit(1))
    state = each.join(known, "claim_ref", "left").groupBy("id", "group_key").agg(
        F.count("claim_ref").alias("refs"), F.count("known").alias("found"), F.max(F.size(F.array_except("preferred_refs", "claim_refs"))).alias("foreign")
    )
    return state.select(
        "id", "group_key", "refs",
        F.when((F.col("refs") < 2) | (F.coalesce("foreign", F.lit(0)) > 0), "invalid").when(F.col("found") < F.col("refs"), "unresolved").otherwise("resolved").alias("state"),
    )


def catalog_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Declared against counted documents, entities and claims of every pack."""
    stat = lambda k: F.get_json_object("stats_json", f"$.{k}").cast("long")
    out = packs(spark, d).select(F.col("id").alias("pack_id"), *[stat(k).alias(f"declared_{k}") for k in ("documents", "entities", "claims")])
    for name, df in (("documents", documents(spark, d)), ("entities", entities(spark, d)), ("claims", claims(spark, d))):
        out = out.join(df.groupBy("pack_id").agg(F.count(F.lit(1)).alias(f"counted_{name}")), "pack_id", "left").fillna(0, [f"counted_{name}"])
    same = F.lit(True)
    for k in ("documents", "entities", "claims"):
        same = same & F.col(f"declared_{k}").eqNullSafe(F.col(f"counted_{k}"))
    return out.withColumn("matches", same)


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """Per entity: sections that list it, and the least of their ids."""
    refs = sections(spark, d, False).select("pack_id", "document_id", "section_id", F.explode(F.array_distinct(strings("entity_ids_json"))).alias("entity_id"))
    known = rt.skew_join(refs, entities(spark, d).select("pack_id", "entity_id"), ["pack_id", "entity_id"], "left_semi")
    return known.groupBy("pack_id", "entity_id").agg(F.count(F.lit(1)).alias("section_count"), F.min(F.concat_ws("/", "document_id", "section_id")).alias("first_section"))


def detected_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities with a name or alias that stands in a claim of their pack: (claim_order, entity_id).

    An equi-join on the term's first token, then the exact test, replaces a nested loop over all pairs.
    """
    term = F.explode(F.concat(F.array("name"), strings("aliases_json"))).alias("term")
    ent = entities(spark, d).select("pack_id", "entity_id", term).select("pack_id", "entity_id", tx.normalize_text(F.col("term")).alias("name"))
    ent = ent.where("name <> ''").distinct()
    ent = ent.withColumn("token", F.get(F.regexp_extract_all("name", F.lit(tx.TOKEN), F.lit(0)), F.lit(0))).where("token is not null")
    said = claims(spark, d).select("claim_order", "pack_id", tx.normalize_text(F.col("text")).alias("body"))
    words = said.select("claim_order", "pack_id", "body", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(tx.TOKEN), F.lit(0)))).alias("token"))
    first = ent.select("pack_id", "token").distinct()
    hits = rt.skew_join(words.drop("body"), first, ["pack_id", "token"], "left_semi")
    near = hits.join(ent, ["pack_id", "token"]).join(said.select("claim_order", "body"), "claim_order")
    return near.where(F.col("body").contains(F.col("name"))).select("claim_order", "entity_id").distinct()


def installed_state(installed: DataFrame, catalog: DataFrame) -> DataFrame:
    """Installed packs against the catalog by id: (pack_id, installed_version, catalog_version, state)."""
    a = installed.select(F.col("id").alias("pack_id"), F.col("version").alias("installed_version"))
    b = catalog.select(F.col("id").alias("pack_id"), F.col("version").alias("catalog_version"))
    return a.join(b, "pack_id", "full").withColumn(
        "state",
        F.when(F.col("installed_version").isNull(), "available").when(F.col("catalog_version").isNull(), "local")
        .when(F.col("installed_version") == F.col("catalog_version"), "current").otherwise("update"),
    )


def unique_ids(df: DataFrame, scope: Sequence[str], id_col: str, order: str) -> DataFrame:
    """Ids made unique in their scope: repeats get -2, -3 … in order; a suffix that an own id already has is marked once more."""
    out = rt.row_numbers(df, [*scope, id_col], [order], "__n")
    out = out.withColumn("unique_id", F.when(F.col("__n") == 1, F.col(id_col)).otherwise(F.concat(id_col, F.lit("-"), F.col("__n").cast("string"))))
    out = rt.row_numbers(out, [*scope, "unique_id"], ["__n", order], "__m")
    return out.withColumn("unique_id", F.when(F.col("__m") == 1, F.col("unique_id")).otherwise(F.concat("unique_id", F.lit("-x"), F.col("__m").cast("string")))).drop("__n", "__m")
