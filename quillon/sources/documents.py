"""Files and texts as documents with bounded sections."""

from __future__ import annotations

import html
import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import text as tx

HEADING = r"^(#{1,6})\s+(.+?)\s*$"
#: The places before heading lines.
BEFORE_HEADING = r"(?md)(?=^#{1,6}[ \t\x0B\f]+[^\r\n])"
DEFAULT_TITLE = "Содержание"
MAX_SECTION = 5000


def list_files(spark: SparkSession, path: str, extensions: list[str] | None = None, exclude: str | None = None) -> DataFrame:
    """Regular files under a path as (path, length, content), without dotfiles and node_modules."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    df = df.where(~F.col("path").rlike(r"/(?:\.[^/]*|node_modules)(?:/|$)"))
    if extensions:
        df = df.where(F.lower(F.col("path")).rlike(r"\.(?:" + "|".join(map(re.escape, extensions)) + ")$"))
    if exclude:
        df = df.where(~F.col("path").contains(exclude))
    return df.select("path", "length", "content")


def likely_text(data: bytes) -> str | None:
    """Decoded content, or None for binary data: byte order marks, strict UTF-8, few control characters."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            try:
                return data[len(mark) :].decode(name)
            except UnicodeDecodeError:
                return None
    try:
        out = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    head = out[:32_768]
    if "\0" in head or sum(ord(c) < 32 and c not in "\t\n\r\f" for c in head) > 0.02 * max(1, len(head)):
        return None
    return out


def packed(paragraphs: list[str], limit: int, slice_long: str = "single") -> list[str]:
    """Paragraphs put together up to the limit. slice_long: cut an oversized text 'single' (only if one piece results), 'each', 'never'."""
    out: list[str] = []
    now = ""
    for p in paragraphs:
        if slice_long == "each" and len(p) > limit:
            if now:
                out.append(now)
            out += [p[i : i + limit] for i in range(0, len(p), limit)]
            now = ""
        elif now and len(now) + len(p) + 2 > limit:
            out.append(now)
            now = p
        else:
            now = f"{now}\n\n{p}" if now else p
    if now:
        out.append(now)
    if slice_long == "single" and len(out) == 1 and len(out[0]) > limit:
        whole = out[0]
        return [whole[i : i + limit] for i in range(0, len(whole), limit)]
    return out


def _markdown_parts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, at, level, title, line_start, body) of the text before every heading and of the heading with what follows it.

    The text is split before its headings in one pass of the JVM; only the few parts of a document meet again, to be numbered.
    """
    parts = F.split(F.coalesce(F.col(text), F.lit("")), BEFORE_HEADING)
    each = docs.select(F.col(id_col), F.posexplode(parts).alias("at", "part"))
    first = F.regexp_extract("part", r"^([^\n]*?)\r?(?:\n|$)", 1)
    titled = first.rlike(HEADING)
    above = Window.partitionBy(id_col).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return each.select(
        id_col, "at", (F.length("part") - F.length(F.replace("part", F.lit("\n"), F.lit("")))).alias("breaks"),
        F.when(titled, F.length(F.regexp_extract(first, HEADING, 1))).otherwise(0).alias("level"),
        F.when(titled, F.regexp_extract(first, HEADING, 2)).otherwise(DEFAULT_TITLE).alias("title"),
        tx.clean_text(F.when(titled, F.regexp_replace("part", r"^[^\n]*(?:\n|$)", "")).otherwise(F.col("part"))).alias("body"),
    ).withColumn("line_start", (F.coalesce(F.sum("breaks").over(above), F.lit(0)) + 1).cast("int"))


def markdown_sections(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, section_no, level, title, line_start, body): lines under their heading; text before the first heading gets a default title."""
    numbered = _markdown_parts(docs, id_col, text).where("body <> ''").withColumn("section_no", F.row_number().over(Window.partitionBy(id_col).orderBy("at")))
    return numbered.select(id_col, "section_no", "level", "title", "line_start", "body")


def markdown_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", name: str | None = None) -> DataFrame:
    """(id, document_title, base_id, title, body, at): the document's title and its sections, not yet cut to size.

    A first heading of the first level with nothing before it is the title of the document, else its file name is; what follows
    that heading stands under the default title. Texts without any section are one section.
    """
    parts = _markdown_parts(docs, id_col, text)
    above = Window.partitionBy(id_col).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum((F.col("body") != "").cast("int") + (F.col("level") > 0).cast("int")).over(above), F.lit(0))
    parts = parts.withColumn("heads", (F.col("level") == 1) & (before == 0))
    titles = parts.where("heads").select(id_col, F.col("title").alias("own_title"))
    rows = parts.where("body <> ''").withColumn("title", F.when(F.col("heads"), DEFAULT_TITLE).otherwise(F.col("title")))
    place = F.row_number().over(Window.partitionBy(id_col).orderBy("at"))
    rows = rows.withColumn("n", place).withColumn("base_id", slug_or(F.col("title"), F.concat(F.lit("section-"), F.col("n").cast("string"))))
    named = docs.select(id_col, (tx.title_from_filename(F.col(name)) if name else F.lit("Документ")).alias("file_title"))
    out = rows.join(titles, id_col, "left").join(named, id_col, "left")
    return out.select(id_col, F.coalesce("own_title", "file_title").alias("document_title"), "base_id", "title", "body", F.col("n").alias("at"))


def slug_or(c: Column, fallback: Column) -> Column:
    s = tx.slugify(c, "")
    return F.when(s == "", fallback).otherwise(s)


def plain_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", name: str | None = None) -> DataFrame:
    """As markdown_documents for plain text: a short first line is the title, the rest one section."""
    clean = tx.clean_text(F.coalesce(F.col(text), F.lit("")))
    lines = F.split(clean, "\n")
    head = F.get(lines, F.lit(0))
    titled = (head != "") & (F.length(head) <= 120) & (F.size(lines) > 1)
    rest = tx.clean_text(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "\n"))
    own = tx.title_from_filename(F.col(name)) if name else F.lit("Документ")
    rows = docs.select(
        id_col, F.when(titled, F.trim(F.regexp_replace(head, r"^#+\s*", ""))).otherwise(own).alias("document_title"), F.lit("content").alias("base_id"),
        F.lit(DEFAULT_TITLE).alias("title"), F.when(titled & (rest != ""), rest).otherwise(clean).alias("body"), F.lit(1).alias("at"),
    )
    return rows.where("body <> ''")


def json_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", name: str | None = None) -> DataFrame:
    """As markdown_documents for JSON: one line 'path: value' per leaf; unreadable texts have no section."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, titles, bodies = [], [], []
            for key, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    tree = json.loads(source or "")
                except ValueError:
                    continue
                keys.append(key)
                titles.append(tree["title"] if isinstance(tree, dict) and isinstance(tree.get("title"), str) and tree["title"] else None)
                bodies.append("\n".join(f"{p}: {json.dumps(v, ensure_ascii=False)}" for p, v in leaves(tree)) or "{}")
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(titles, pa.string()), pa.array(bodies, pa.string())], names=["k", "own", "body"])

    read = docs.select(F.col(id_col).cast("string").alias("k"), text).mapInArrow(run, "k string, own string, body string")
    named = docs.select(F.col(id_col), F.col(id_col).cast("string").alias("k"), (tx.title_from_filename(F.col(name)) if name else F.lit("Документ")).alias("file_title"))
    return named.join(read, "k").select(id_col, F.coalesce("own", "file_title").alias("document_title"), F.lit("data").alias("base_id"), F.lit("Данные").alias("title"), "body", F.lit(1).alias("at"))


def leaves(value: object, path: str = "$") -> Iterator[tuple[str, object]]:
    """(path, value) of every leaf, keys in their order."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from leaves(v, f"{path}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from leaves(v, f"{path}[{i}]")
    else:
        yield path, value


def sized(rows: DataFrame, limit: int = MAX_SECTION, slice_long: str = "single") -> DataFrame:
    """Sections (…, base_id, title, body) cut to the limit at blank lines: parts get '-part-n' and '· часть n', short ones stay.

    Only sections beyond the limit leave the JVM. slice_long: see packed.
    """

    @F.pandas_udf("array<string>")
    def cut(bodies: pd.Series) -> pd.Series:
        return bodies.map(lambda b: None if b is None else packed([p for p in re.split(r"\n{2,}", b) if p], limit, slice_long))

    long = F.length("body") > limit
    parts = F.coalesce(cut(F.when(long, F.col("body"))), F.array("body"))
    each = rows.withColumn("long", long).select("*", F.posexplode(parts).alias("part_at", "part")).drop("body")
    number = (F.col("part_at") + 1).cast("string")
    return each.withColumns({
        "section_id": F.when(F.col("long"), F.concat("base_id", F.lit("-part-"), number)).otherwise(F.col("base_id")),
        "title": F.when(F.col("long"), F.concat("title", F.lit(" · часть "), number)).otherwise(F.col("title")),
    }).withColumnRenamed("part", "body").drop("long", "base_id")


def docx_document(content: bytes, limit: int = MAX_SECTION) -> tuple[str | None, list[dict]]:
    """(title, sections) of a word-processing document; a section keeps the numbers of its first and last paragraph.

    A paragraph of the style Title is the title, headings begin sections, paragraphs are packed to the limit and never cut.
    """
    title, heading, group, out = None, DEFAULT_TITLE, [], []

    def flush() -> None:
        sections = len({s["group"] for s in out})
        part, size, parts = [], 0, []
        for number, text in group:
            if part and size + len(text) + 2 > limit:
                parts.append(part)
                part, size = [], 0
            size += len(text) + (2 if part else 0)
            part.append((number, text))
        parts += [part] if part else []
        for k, p in enumerate(parts, 1):
            out.append({
                "group": sections, "base": heading, "title": heading if k == 1 else f"{heading} · часть {k}", "part": k,
                "body": "\n\n".join(t for _, t in p), "first": p[0][0], "last": p[-1][0],
            })
        group.clear()

    for number, (style, text) in enumerate(docx_paragraphs(content), 1):
        text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", text)).strip()
        if not text:
            continue
        if title is None and re.fullmatch("title|заголовок", style, re.I):
            title = text
        elif re.search("(?:heading|заголовок)", style, re.I):
            flush()
            heading = text
        else:
            group.append((number, text))
    flush()
    return title, out


def docx_sections(files: DataFrame) -> DataFrame:
    """(path, document_title, section_id, title, body, paragraph_start, paragraph_end) of files (path, content)."""
    shape = "path string, document_title string, base string, n int, part int, title string, body string, paragraph_start int, paragraph_end int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    title, sections = docx_document(content)
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError):
                    continue
                rows += [(path, title, s["base"], s["group"] + 1, s["part"], s["title"], s["body"], s["first"], s["last"]) for s in sections]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(9)]
            types = [pa.string()] * 3 + [pa.int32()] * 2 + [pa.string()] * 2 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in shape.split(", ")])

    rows = files.select("path", "content").mapInArrow(run, shape)
    base = slug_or(F.col("base"), F.concat(F.lit("section-"), F.col("n").cast("string")))
    return rows.select(
        "path", F.coalesce("document_title", tx.title_from_filename(F.col("path"))).alias("document_title"),
        F.concat(base, F.when(F.col("part") > 1, F.concat(F.lit("-part-"), F.col("part").cast("string"))).otherwise("")).alias("section_id"),
        "title", "body", "paragraph_start", "paragraph_end",
    )


def page_sections(pages: DataFrame, limit: int = MAX_SECTION) -> DataFrame:
    """(document_id, page, section_id, title, body) of page texts (document_id, page, text), cut to the limit, also within paragraphs."""
    number = F.col("page").cast("string")
    rows = pages.select("document_id", "page", F.concat(F.lit("page-"), number).alias("base_id"), F.concat(F.lit("Страница "), number).alias("title"), tx.clean_text(F.coalesce("text", F.lit(""))).alias("body"))
    out = sized(rows.where("body <> ''"), limit, "each")
    # the first part keeps the page's own id and title
    plain = F.col("part_at") == 0
    return out.select(
        "document_id", "page", F.when(plain, F.concat(F.lit("page-"), number)).otherwise(F.col("section_id")).alias("section_id"),
        F.when(plain, F.concat(F.lit("Страница "), number)).otherwise(F.col("title")).alias("title"), "body",
    )


def plain_title(text: Column, limit: int = 120) -> Column:
    """The first line as title if it is short and not alone."""
    lines = F.split(tx.clean_text(text), "\n")
    return F.when((F.size(lines) > 1) & (F.length(F.get(lines, F.lit(0))) <= limit), F.get(lines, F.lit(0)))


def flatten_json(value: object, path: str = "$") -> Iterator[tuple[str, str]]:
    """(path, value) of every leaf, keys in their order."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from flatten_json(v, f"{path}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from flatten_json(v, f"{path}[{i}]")
    else:
        yield path, value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def json_leaves(rows: DataFrame, id_col: str, column: str) -> DataFrame:
    """(id, leaf_no, path, value) of JSON texts; null and unreadable texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    tree = json.loads(text) if text is not None else None
                except ValueError:
                    continue
                if text is not None:
                    out += [(key, n, p, v) for n, (p, v) in enumerate(flatten_json(tree), 1)]
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.string(), pa.string()], strict=True)], names=["id", "leaf_no", "path", "value"]
            )

    return rows.select(F.col(id_col).cast("long").alias("id"), column).mapInArrow(run, "id long, leaf_no int, path string, value string")


def docx_paragraphs(content: bytes) -> list[tuple[str, str]]:
    """(style, text) of the paragraphs of a word-processing document."""
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in root.iter(f"{ns}p"):
        style = p.find(f"{ns}pPr/{ns}pStyle")
        text = "".join("\t" if e.tag == f"{ns}tab" else "\n" if e.tag == f"{ns}br" else e.text or "" for e in p.iter() if e.tag in (f"{ns}t", f"{ns}tab", f"{ns}br"))
        out.append((style.get(f"{ns}val") if style is not None else "", text))
    return out


def pdf_pages(text: Column) -> Column:
    """Array of page texts split at form feeds, without an empty last page."""
    pages = F.split(text, "\f")
    return F.when(F.trim(F.element_at(pages, -1)) == "", F.slice(pages, 1, F.greatest(F.size(pages) - 1, F.lit(0)))).otherwise(pages)


def tesseract_words(tsv: DataFrame, threshold: float = 80.0) -> DataFrame:
    """Per page of recogniser rows (page_num, conf, text): words, mean and least confidence, words below the threshold."""
    words = tsv.where("conf >= 0 and trim(text) <> ''")
    return words.groupBy("page_num").agg(
        F.count(F.lit(1)).alias("words"), F.round(F.avg("conf"), 6).alias("mean_confidence"), F.min("conf").alias("least_confidence"),
        F.sum((F.col("conf") < threshold).cast("long")).alias("low_confidence"),
    )


def reconstructed_lines(tsv: DataFrame) -> DataFrame:
    """Text of every line of recogniser rows, words by number and left edge."""
    line = tsv.where("trim(text) <> ''").groupBy("page_num", "block_num", "par_num", "line_num").agg(F.array_sort(F.collect_list(F.struct("word_num", "left", "text"))).alias("w"))
    return line.withColumn("line", F.array_join(F.transform("w", lambda x: x["text"]), " ")).drop("w")


def decode_entities(s: str | None) -> str | None:
    return None if s is None else html.unescape(s)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, kind, mime, text) of files whose content is text; others with null text and their digest."""
    files = list_files(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [likely_text(b) if b is not None else None for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(texts, pa.string())], names=["path", "sha256", "text"])

    read = files.select("path", "content", F.sha2("content", 256).alias("sha256")).mapInArrow(run, "path string, sha256 string, text string")
    return read.select("path", tx.title_from_filename(F.col("path")).alias("title"), tx.source_kind(F.col("path")).alias("kind"), tx.mime_type(F.col("path")).alias("mime"), "sha256", "text")
