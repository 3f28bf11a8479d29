"""What views of resources show: labels, formats, links, spans and anchors, as expressions and joins."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon import runtime as rt
from quillon.functions import text as tx

# Labels of statement relations and selections.
STATEMENT_LABELS = {
    "supports": "Подтверждает", "contradicts": "Противоречит", "refines": "Уточняет", "supersedes": "Заменяет более раннее сведение",
    "equivalent": "Сообщает то же самое", "different_scope": "Относится к другим условиям",
}
OTHER_STATEMENT = "Связано с другим утверждением"
PREFERRED, ALTERNATIVE = "Текущее или предпочтительное", "Историческое или альтернативное"
# Office formats by extension, extensions of embedded media by type.
FORMATS = {
    "doc": "doc", "docx": "docx docm", "ppt": "ppt pps pot", "pptx": "pptx pptm ppsx ppsm", "xlsx": "xls xlsx xlsm xlsb", "odt": "odt", "ods": "ods", "odp": "odp",
    "rtf": "rtf", "epub": "epub", "csv": "csv",
}
MEDIA = {"image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "image/webp": ".webp", "image/svg+xml": ".svg", "application/pdf": ".pdf"}
ATTENTION = ["interrupted", "failed"]


def _named(table: dict[str, str], key: Column, default: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key], default)


def statement_label(kind: Column) -> Column:
    return _named(STATEMENT_LABELS, kind, F.lit(OTHER_STATEMENT))


def selection_label(preferred: Column) -> Column:
    return F.when(preferred, PREFERRED).otherwise(ALTERNATIVE)


def office_format(filename: Column) -> Column:
    """Format an office file is read as; null for others."""
    by = {e: f for f, extensions in FORMATS.items() for e in extensions.split()}
    return _named(by, F.regexp_replace(tx.source_extension(filename), r"^\.", ""), F.lit(None).cast("string"))


def media_extension(kind: Column) -> Column:
    return _named(MEDIA, F.lower(F.coalesce(kind, F.lit(""))), F.lit(".bin"))


def duration(ms: Column) -> Column:
    """Milliseconds, or seconds with one decimal below ten."""
    seconds = F.when(ms < 10_000, F.format_string("%.1f", ms / 1000)).otherwise(F.format_string("%.0f", ms / 1000))
    return F.when(ms.isNull(), "—").when(ms < 1000, F.concat(F.round(ms).cast("long").cast("string"), F.lit(" мс"))).otherwise(F.concat(seconds, F.lit(" с")))


def megabytes(mb: Column) -> Column:
    number = F.when(mb >= 10, F.format_string("%.0f", mb)).otherwise(F.format_string("%.1f", mb))
    return F.when(mb.isNull(), "—").when(mb >= 1024, F.concat(F.format_string("%.1f", mb / 1024), F.lit(" ГБ"))).otherwise(F.concat(number, F.lit(" МБ")))


def section_key(pack: Column, document: Column, section: Column) -> Column:
    """pack::document/section; empty without a document or a section."""
    ref, own = tx.qualify(pack, document), F.trim(F.coalesce(section, F.lit("")))
    return F.when((ref != "") & (own != ""), F.concat_ws("/", ref, own)).otherwise("")


def context_snippet(text: Column, quote: Column, limit: int = 520) -> Column:
    """About `limit` characters around the quote, or the beginning where it does not stand in the text."""
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    body, needle = clean(text), clean(quote)
    at = F.when(needle != "", F.position(needle, body)).otherwise(0)
    padding = F.greatest(F.lit(0), F.floor((F.lit(limit) - F.length(needle)) / 2).cast("int"))
    start = F.greatest(F.lit(0), at - 1 - padding)
    stop = F.least(F.length(body), at - 1 + F.length(needle) + padding)
    framed = F.concat(F.when(start > 0, "…").otherwise(""), body.substr(start + 1, stop - start), F.when(stop < F.length(body), "…").otherwise(""))
    return F.when(at > 0, framed).otherwise(F.substring(body, 1, limit))


def route_hash(kind: str, resource_id: Column, base: str = "search", depth: int = 1, section: Column | None = None) -> Column:
    """Link of a resource: '#/kind/id?from=…&depth=…', with its section if given."""
    head = F.concat(F.lit(f"#/{kind}/"), F.replace(F.url_encode(resource_id), F.lit("+"), F.lit("%20")), F.lit(f"?from={base}&depth={max(1, depth)}"))
    if section is None:
        return head
    return F.concat(head, F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit("&section="), F.url_encode(section))).otherwise(""))


def asset_url(url: Column, mime: Column, page: Column, anchor: Column) -> Column:
    """Address of a place in a document's file: a page of a PDF, an anchor of anything else."""
    place = F.concat(F.lit("#"), F.url_encode(anchor))
    paged = F.concat(F.regexp_extract(url, "^[^#]*", 0), F.lit("#page="), F.greatest(F.lit(1), F.coalesce(page, F.lit(1))).cast("string"), F.lit("&view=FitH"))
    named = F.concat(paged, F.coalesce(F.concat(F.lit("&nameddest="), F.url_encode(anchor)), F.lit("")))
    return F.when(F.coalesce(F.trim(url), F.lit("")) == "", None).when(mime == "application/pdf", named).otherwise(F.concat(url, F.coalesce(place, F.lit(""))))


def with_assets(sections: DataFrame, assets: DataFrame) -> DataFrame:
    """sections (section_ref, text) with references '](asset:id)' replaced by addresses: assets (section_ref, asset_id, url), few per section."""
    listed = assets.groupBy("section_ref").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("asset_id", "url")))).alias("urls"))
    folded = F.aggregate(F.map_entries("urls"), F.col("text"), lambda t, a: F.replace(t, F.concat(F.lit("](asset:"), a["key"], F.lit(")")), F.concat(F.lit("]("), a["value"], F.lit(")"))))
    return sections.join(listed, "section_ref", "left").withColumn("text", F.coalesce(folded, "text")).drop("urls")


def asset_names(paths: DataFrame) -> DataFrame:
    """(path, name): slugs of file names with their extension; where several paths want a name all but the first get a digest of the path."""
    extension = tx.source_extension(F.col("path"))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/\\]*)$", 1), r"\.[^.]+$", "")
    rows = paths.select("path", tx.slugify(stem, "document").alias("base"), extension.alias("extension")).distinct()
    numbered = rt.row_numbers(rows, ["base", "extension"], ["path"], "n")
    return numbered.select("path", F.concat("base", F.when(F.col("n") > 1, F.concat(F.lit("-"), F.substring(F.sha2("path", 256), 1, 8))).otherwise(""), "extension").alias("name"))


def corpus_bytes(records: DataFrame) -> DataFrame:
    """Two bytes for every character of the searched fields: (records, bytes)."""
    size = sum((F.coalesce(F.length(c), F.lit(0)) for c in ("title", "document_title", "body", "aliases", "entity_names", "tags")), F.lit(0))
    return records.agg(F.count(F.lit(1)).alias("records"), (F.sum(size.cast("long")) * 2).alias("bytes"))


def statements_of(claims: DataFrame) -> DataFrame:
    """(section_key, runtime_id, local_id, text): statements by the section they come from."""
    key = section_key(F.col("pack_id"), F.col("source_document_id"), F.col("source_section_id"))
    rows = claims.select(key.alias("section_key"), tx.qualify(F.col("pack_id"), F.col("claim_id")).alias("runtime_id"), F.col("claim_id").alias("local_id"), "text")
    return rows.where("section_key <> ''")


def linked_entities(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """(claim_ref, role, entity_id, name) of the known subjects and objects of claims."""
    each = F.array(F.struct(F.lit("subject").alias("role"), F.col("subject_id").alias("entity_id")), F.struct(F.lit("object").alias("role"), F.col("object_id").alias("entity_id")))
    rows = claims.select("pack_id", tx.qualify(F.col("pack_id"), F.col("claim_id")).alias("claim_ref"), F.inline(each)).where("entity_id is not null")
    return rt.skew_join(rows, entities.select("pack_id", "entity_id", "name"), ["pack_id", "entity_id"], "inner").select("claim_ref", "role", "entity_id", "name")


def relations_of(relations: DataFrame) -> DataFrame:
    """(entity_id, relation_id, predicate, other_id, direction): every relation under both of its ends."""
    ends = F.array(
        F.struct(F.col("source_id").alias("entity_id"), F.col("target_id").alias("other_id"), F.lit("out").alias("direction")),
        F.struct(F.col("target_id").alias("entity_id"), F.col("source_id").alias("other_id"), F.lit("in").alias("direction")),
    )
    rows = relations.select("relation_id", "predicate", F.inline(ends))
    return rows.where("not (direction = 'in' and entity_id = other_id)")


def notes_of(notes: DataFrame, level: str) -> DataFrame:
    """(target, note_id, title, relation): notes by the claim, section or entity they are about."""
    target = {
        "claim": F.array("claim_id"), "entity": F.col("entity_ids"),
        "section": F.array(F.when(F.col("section_id").isNotNull(), F.concat_ws("/", "document_id", "section_id"))),
    }[level]
    return notes.select(F.explode(target).alias("target"), F.col("id").alias("note_id"), "title", "relation").where("target is not null")


SPANS = "array<struct<start:int, stop:int, entity_id:string>>"


def entity_spans(texts: DataFrame) -> DataFrame:
    """texts (id, text, terms array<struct<term, entity_id>>, few per text) → (id, start, stop, entity_id) where a term stands, longest first.

    Case does not matter; places do not overlap; of entities with one term the first listed counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, terms in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                listed = sorted([t for t in terms or () if t["term"]], key=lambda t: -len(t["term"]))
                if not listed or not text:
                    continue
                owner: dict[str, str] = {}
                for t in listed:
                    owner.setdefault(t["term"].lower(), t["entity_id"])
                pattern = re.compile("|".join(re.escape(t["term"]) for t in listed), re.I)
                out += [(key, m.start(), m.end(), owner[m[0].lower()]) for m in pattern.finditer(text) if m[0].lower() in owner]
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.int32(), pa.string()], strict=True)], names=["id", "start", "stop", "entity_id"]
            )

    return texts.select(F.col("id").cast("long").alias("id"), "text", "terms").mapInArrow(run, "id long, start int, stop int, entity_id string")


def inspector_pages(documents: DataFrame) -> DataFrame:
    """(document_id, page, text) of Markdown with page marks '<!-- Page n -->'; text before the first mark is page 1, repeated pages are joined."""
    parts = F.split(F.coalesce("markdown", F.lit("")), r"(?i)(?=<!--\s*Page\s+\d+\s*-->)")
    mark = r"(?is)^<!--\s*Page\s+(\d+)\s*-->"
    rows = documents.select("document_id", F.posexplode(parts).alias("at", "part"))
    page = F.coalesce(F.nullif(F.regexp_extract("part", mark, 1), F.lit("")).cast("int"), F.lit(1))
    rows = rows.select("document_id", page.alias("page"), "at", tx.clean_text(F.regexp_replace("part", mark, "")).alias("text")).where("text <> ''")
    joined = rows.groupBy("document_id", "page").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("x"))  # the parts of one page
    return joined.select("document_id", "page", F.array_join(F.transform("x", lambda r: r["text"]), "\n\n").alias("text"))


def open_reviews(manifests: DataFrame) -> DataFrame:
    """(pack_id, review) of preparation reviews that are not completed: manifests (pack_id, reviews array<struct<kind, status>>)."""
    return manifests.select("pack_id", F.explode(F.filter("reviews", lambda r: ~r["status"].eqNullSafe("completed"))).alias("review"))


def mixed_audio(frames: DataFrame) -> DataFrame:
    """(clip_id, at, value): mean of the channels: frames (clip_id, channel, at, value)."""
    return frames.groupBy("clip_id", "at").agg(F.avg("value").alias("value"))


def resampled_audio(samples: DataFrame, source_rate: int, target_rate: int = 16_000) -> DataFrame:
    """(clip_id, at, value) at another rate by linear interpolation: samples (clip_id, at, value), at counted from 0 without gaps."""
    if source_rate <= 0 or target_rate <= 0:
        return samples.limit(0)
    if source_rate == target_rate:
        return samples.select("clip_id", "at", "value")
    ratio = source_rate / target_rate
    sizes = samples.groupBy("clip_id").agg((F.max("at") + 1).alias("n"))
    places = sizes.select("clip_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), F.round(F.col("n") / ratio)).cast("long") - 1)).alias("out"))
    left = F.floor(F.col("out") * ratio)
    ends = places.select("clip_id", "out", (F.col("out") * ratio - left).alias("part"), F.explode(F.array(F.struct(left.alias("at"), F.lit(0).alias("side")), F.struct(F.least(F.col("n") - 1, left + 1).alias("at"), F.lit(1).alias("side")))).alias("e"))
    met = ends.select("clip_id", "out", "part", F.col("e.at").alias("at"), F.col("e.side").alias("side")).join(samples, ["clip_id", "at"])
    share = F.when(F.col("side") == 0, 1 - F.col("part")).otherwise(F.col("part"))
    return met.groupBy("clip_id", "out").agg(F.sum(F.col("value") * share).alias("value")).withColumnRenamed("out", "at")
