"""Personal notes, labels, proposals, candidates, install records, query expansion hooks and benchmark records."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as tx

# Relations of a note to its target, and labels of relations.
NOTE_RELATIONS = ["observation", "refines", "contradicts", "supports", "supersedes"]
NOTE_LABELS = {
    "observation": "Практическое наблюдение", "refines": "Уточняет справочник", "contradicts": "Противоречит справочнику",
    "supports": "Поддерживает справочник", "supersedes": "Локально заменяет",
}
PREDICATE_LABELS = {
    "may_present_with": "может проявляться", "related_to": "связано с", "associated_with": "ассоциировано с", "diagnosed_by": "диагностируется с помощью",
    "differential_for": "учитывается в дифференциальной диагностике", "treated_with": "лечится с помощью", "routine_therapy": "обычная терапия",
    "contraindicated_with": "противопоказано вместе с", "requires_assessment_of": "требует оценки", "abbreviation_of": "расшифровывается как",
    "expands_to": "расшифровывается как", "mentioned_in": "упоминается в", "supports": "поддерживает", "refines": "уточняет",
    "contradicts": "противоречит", "supersedes": "локально заменяет",
}
NOTE = (
    "id string, title string, body string, relation string, targetDocumentId string, targetSectionId string, targetClaimId string, "
    "relatedEntityIds array<string>, createdAt string, updatedAt string"
)


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def normalized_notes(raw: DataFrame) -> DataFrame:
    """Notes (schema NOTE) trimmed and bounded; rows without title or body are dropped; a section target needs a document target."""
    text = lambda c, n: F.substring(F.trim(F.coalesce(c, F.lit(""))), 1, n)
    target = F.nullif(F.trim("targetDocumentId"), F.lit(""))
    relation = F.when(F.col("relation").isin(NOTE_RELATIONS), F.col("relation")).otherwise("observation")
    ids = F.filter(F.coalesce("relatedEntityIds", F.array().cast("array<string>")), lambda e: e.isNotNull() & (F.trim(e) != ""))
    return raw.select(
        "id", text(F.col("title"), 160).alias("title"), text(F.col("body"), 12_000).alias("body"), relation.alias("relation"), _lookup(NOTE_LABELS, relation).alias("relation_label"),
        target.alias("document_id"), F.when(target.isNotNull(), F.nullif(F.trim("targetSectionId"), F.lit(""))).alias("section_id"),
        F.nullif(F.trim("targetClaimId"), F.lit("")).alias("claim_id"), F.array_distinct(ids).alias("entity_ids"), "createdAt", F.coalesce("updatedAt", "createdAt").alias("updated_at"),
    ).where("title <> '' and body <> ''")


def imported_notes(texts: DataFrame) -> DataFrame:
    """Notes of JSON arrays (column `json`, one array per row); unreadable texts have none."""
    return normalized_notes(texts.select(F.inline(F.from_json("json", f"array<struct<{NOTE.replace(' array', ':array').replace(' string', ':string')}>>"))))


def note_records(notes: DataFrame, documents: DataFrame) -> DataFrame:
    """Search records of normalised notes; documents (document_id, title) give the titles of their targets, local or pack-qualified."""
    local = F.element_at(F.split("document_id", "::"), -1)
    titles = documents.groupBy(F.col("document_id").alias("local")).agg(F.min("title").alias("target_title"))
    tags = F.concat(F.lit("personal "), "relation", F.when(F.col("document_id").isNotNull(), " source-annotation").otherwise(""))
    rows = notes.withColumn("local", local).join(titles, "local", "left")
    return rows.select(
        F.concat(F.lit("note:"), "id").alias("id"), F.lit("note").alias("kind"), "relation", F.lit("personal").alias("authority"), "title",
        F.coalesce("target_title", "relation_label").alias("document_title"), F.lit("").alias("aliases"), F.lit("").alias("entity_names"), tags.alias("tags"), "body",
    )


def targets(notes: DataFrame) -> DataFrame:
    """Notes per target: (level, target, notes)."""
    each = F.filter(F.array(
        F.struct(F.lit("document").alias("level"), F.col("document_id").alias("target")),
        F.struct(F.lit("section").alias("level"), F.when(F.col("section_id").isNotNull(), F.concat_ws("/", "document_id", "section_id")).alias("target")),
        F.struct(F.lit("claim").alias("level"), F.col("claim_id").alias("target")),
    ), lambda t: t["target"].isNotNull())
    return notes.select(F.inline(each)).groupBy("level", "target").agg(F.count(F.lit(1)).alias("notes"))


def predicate_label(c: Column) -> Column:
    name = F.trim(F.coalesce(c, F.lit("related_to")))
    key = F.regexp_replace(F.lower(name), r"[-\s]+", "_")
    return F.coalesce(_lookup(PREDICATE_LABELS, key), F.replace(name, F.lit("_"), F.lit(" ")))


def relation_strength(c: Column) -> Column:
    """struct(percent, category) of a weight up to 1 or in percent."""
    percent = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(F.when(c <= 1, c).otherwise(c / 100) * 100 + 0.5))).cast("int")
    return F.when(c.isNotNull(), F.struct(percent.alias("percent"), F.when(percent >= 67, "сильная").when(percent >= 34, "средняя").otherwise("слабая").alias("category")))


def parsed_proposal(c: Column) -> Column:
    """Entities, claims and relations of a model's answer: the outermost JSON object, with or without a code fence."""
    body = F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)(\{.*\})", 1), F.lit(""))
    shape = "struct<entities:array<struct<name:string,type:string,aliases:array<string>>>,claims:array<struct<text:string,quote:string,subject:string,object:string>>,relations:array<struct<source:string,target:string,predicate:string>>>"
    return F.from_json(body, shape)


def proposal_candidates(sections: DataFrame) -> DataFrame:
    """Typed candidates of proposals: sections (section_ref, text, proposal); a claim needs a quote that stands in its section."""
    p = sections.withColumn("p", parsed_proposal(F.col("proposal")))
    digest = lambda kind, *c: F.substring(F.sha2(F.concat_ws("␟", "section_ref", F.lit(kind), *c), 256), 1, 16)
    ents = p.select("section_ref", F.posexplode("p.entities").alias("n", "e")).select("section_ref", F.lit("entity").alias("kind"), digest("entity", F.col("e.name"), F.col("n").cast("string")).alias("id"), (F.trim("e.name") != "").alias("eligible"))
    said = p.select("section_ref", "text", F.posexplode("p.claims").alias("n", "c")).select("section_ref", F.lit("claim").alias("kind"), digest("claim", F.col("c.text"), F.col("n").cast("string")).alias("id"), ((F.trim("c.text") != "") & (F.trim("c.quote") != "") & F.col("text").contains(F.col("c.quote"))).alias("eligible"))
    rels = p.select("section_ref", F.posexplode("p.relations").alias("n", "r")).select("section_ref", F.lit("relation").alias("kind"), digest("relation", F.col("r.source"), F.col("r.target"), F.col("n").cast("string")).alias("id"), ((F.trim("r.source") != "") & (F.trim("r.target") != "")).alias("eligible"))
    return ents.unionByName(said).unionByName(rels).withColumn("eligible", F.coalesce("eligible", F.lit(False)))


def ocr_candidate_id(*parts: str) -> Column:
    """Identity of a scanned page from pack, path, digest, page and language."""
    return F.concat(F.lit("ocr-review."), F.substring(F.sha2(F.concat_ws("␟", *[F.col(p).cast("string") for p in parts]), 256), 1, 16))


def install_records(packs: DataFrame, previous: DataFrame) -> DataFrame:
    """packs (id, version, size_bytes, sha256) with what an earlier installation had set: enabled, source, digest."""
    old = previous.select("id", F.col("enabled").alias("__e"), F.col("source").alias("__s"), F.col("sha256").alias("__h"))
    return packs.join(old, "id", "left").select("id", "version", "size_bytes", F.coalesce("__e", F.lit(True)).alias("enabled"), F.coalesce("__s", F.lit("local")).alias("source"), F.coalesce("sha256", "__h").alias("sha256"))


def expand(query: str, planners: Sequence[Callable[[str], Sequence[str]]]) -> list[str]:
    """Additions of registered query planners, in order and once each."""
    return list(dict.fromkeys(t.strip() for p in planners for t in p(query) or () if isinstance(t, str) and t.strip()))


def rule_planner(rules: Sequence[tuple[Sequence[str], Sequence[str]]]) -> Callable[[str], list[str]]:
    """Planner from (phrases, terms): a phrase fires if it stands in the query or all its long words do."""
    from quillon.operators.search import query_tokens

    def plan(query: str) -> list[str]:
        words = query_tokens(query)
        flat = " ".join(words)
        hit = lambda phrase: " ".join(query_tokens(phrase)) in flat or bool(long := [w for w in query_tokens(phrase) if len(w) > 3]) and set(long) <= set(words)
        return [t for phrases, terms in rules if any(map(hit, phrases)) for t in terms]

    return plan


def benchmark_records(spark: SparkSession, count: int = 5000, body_chars: int = 640) -> DataFrame:
    """Deterministic search records with a marker per record, made in the executors."""
    i = F.col("id").cast("string")
    marker = F.concat(F.lit("marker"), F.lpad(i, 7, "0"))
    unit = F.concat(F.lit("record "), i, F.lit(" holds measured values of sample "), (F.col("id") % 97).cast("string"), F.lit(" and "), marker, F.lit(". "))
    body = F.substring(F.repeat(unit, body_chars // 40 + 1), 1, max(120, min(8192, body_chars)))
    return spark.range(count).select(
        F.concat(F.lit("bench:"), i).alias("id"), F.lit("section").alias("kind"), F.lit(None).cast("string").alias("relation"), F.lit("reference").alias("authority"),
        F.concat(F.lit("Benchmark record "), i).alias("title"), F.concat(F.lit("Document "), (F.col("id") % 50).cast("string")).alias("document_title"),
        F.lit("").alias("aliases"), F.lit("").alias("entity_names"), F.lit("benchmark").alias("tags"), body.alias("body"),
    )


def abbreviations(rows: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """(id, alias, canonical) of 'long form (ABBR)' and 'ABBR — long form'."""
    after = r"([\p{L}][\p{L}\p{N}\s,–—-]{3,100}?)\s*\(([А-ЯA-ZЁ0-9][А-ЯA-ZЁ0-9.-]{1,11})\)"
    before = r"([А-ЯA-ZЁ0-9][А-ЯA-ZЁ0-9.-]{1,11})\s*[—–-]\s*([\p{L}][^.;\n]{3,100})"
    pair = lambda p, a, c: F.transform(F.arrays_zip(F.regexp_extract_all(text, F.lit(p), F.lit(a)).alias("a"), F.regexp_extract_all(text, F.lit(p), F.lit(c)).alias("c")), lambda x: x)
    found = rows.select(id_col, F.inline(F.concat(pair(after, 2, 1), pair(before, 1, 2))))
    clean = F.regexp_replace(tx.clean_text(F.col("c")), r"^[,:;\s]+|[,:;\s]+$", "")
    return found.select(id_col, F.trim("a").alias("alias"), clean.alias("canonical")).where((F.length("alias") >= 2) & (F.length("canonical") >= 4))


def route(c: Column) -> Column:
    """struct(type, id, section) of a resource route '#/type/id?section=…'."""
    m = lambda k: F.nullif(F.regexp_extract(c, r"^#?/?([^/?]+)/([^?]*)(?:\?(.*))?$", k), F.lit(""))
    return F.struct(m(1).alias("type"), F.url_decode(m(2)).alias("id"), F.url_decode(F.nullif(F.regexp_extract(m(3), r"(?:^|&)section=([^&]*)", 1), F.lit(""))).alias("section"))
