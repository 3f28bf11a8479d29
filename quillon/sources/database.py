"""Tables as documents: one section per row, with identity, title, text, tags and provenance."""

from __future__ import annotations

import hashlib
import sqlite3
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import runtime as rt
from quillon.functions import text as tx

MAX_ROWS, MAX_CELL = 50_000, 100_000


@dataclass(frozen=True)
class Mapping:
    """How a table becomes sections; columns default to the key, the order to the key, the text to all columns."""

    name: str
    id_columns: Sequence[str]
    title_column: str | None = None
    text_columns: Sequence[str] = ()
    tag_columns: Sequence[str] = ()
    order_columns: Sequence[str] = ()
    document_title: str | None = None
    kind: str = "table"
    extra_tags: Sequence[str] = field(default_factory=tuple)

    def checked(self, df: DataFrame) -> Mapping:
        known = set(df.columns)
        for c in (*self.id_columns, *self.text_columns, *self.tag_columns, *self.order_columns, *([self.title_column] if self.title_column else [])):
            if c not in known:
                raise ValueError(f"table {self.name} has no column {c}")
        return self


def row_text(columns: Sequence[str]) -> Column:
    """'column: value' blocks; values of several lines begin on their own line."""
    def block(c: str) -> Column:
        v = tx.format_cell(F.col(c), MAX_CELL)
        return F.concat(F.lit(f"{c}:"), F.when(v.contains("\n"), "\n").otherwise(" "), v)

    return F.coalesce(F.nullif(F.concat_ws("\n\n", *map(block, columns)), F.lit("")), F.lit("(пустая строка)"))


def row_title(m: Mapping, number: Column) -> Column:
    own = F.trim(F.col(m.title_column).cast("string")) if m.title_column else F.lit(None).cast("string")
    by_id = F.concat_ws(" · ", F.lit(m.document_title or m.name), *[F.col(c).cast("string") for c in m.id_columns]) if m.id_columns else None
    fallback = by_id if by_id is not None else F.concat_ws(" · ", F.lit(m.document_title or m.name), number.cast("string"))
    return F.coalesce(F.nullif(F.substring(own, 1, 180), F.lit("")), fallback)


def row_tags(m: Mapping, source: str = "sqlite") -> Column:
    parts = [F.array(F.lit(source), F.lit(m.kind), F.lit(m.name), *map(F.lit, m.extra_tags))]
    parts += [F.split(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[,;|]") for c in m.tag_columns]
    return F.array_distinct(F.filter(F.transform(F.flatten(F.array(*parts)), lambda t: F.trim(t)), lambda t: t != ""))


def _section_id(m: Mapping, identity: Column) -> Column:
    digest = F.substring(F.sha2(F.concat_ws("␟", F.lit(f"row.{m.name}"), identity), 256), 1, 12)
    return F.concat(F.lit(f"row.{m.name}."), digest)


def row_sections(df: DataFrame, m: Mapping, source: str = "sqlite") -> DataFrame:
    """(section_id, title, body, tags, identity_json) of every row, ids unique.

    With key columns this is a projection. A table without any, and rows that repeat the key of an earlier one, get the
    number of the row in the order of the order columns, else of all columns, into their identity; equal rows are
    numbered one after the other.
    """
    m.checked(df)
    cells = df.columns
    keyed = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in m.id_columns])) if m.id_columns else F.lit("{}")
    rows = df.withColumn("__id", keyed)
    repeated = None
    if m.id_columns:
        counted = rows.groupBy("__id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__id")
        repeated = None if counted.isEmpty() else rt.written(counted, "repeated-keys")
    if m.id_columns and repeated is None:
        rows = rows.withColumns({"__row": F.lit(None).cast("long"), "__again": F.lit(False)})
    else:
        order = [c for c in (*m.order_columns, *cells) if dict(df.dtypes)[c] != "binary"]
        rows = rt.row_numbers(rows.withColumn("__all", F.lit(0)), ["__all"], list(dict.fromkeys(order)), "__row").drop("__all")
        if repeated is None:
            rows = rows.withColumn("__again", F.lit(True))
        else:
            first = rt.skew_join(rows.select("__id", "__row"), repeated, ["__id"], "left_semi").groupBy("__id").agg(F.min("__row").alias("__first"))
            rows = rt.skew_join(rows, first, ["__id"], "left").withColumn("__again", F.coalesce(F.col("__row") > F.col("__first"), F.lit(False)))
    number = F.col("__row").cast("string")
    own = F.when(F.col("__id") == "{}", F.lit("{")).otherwise(F.concat(F.expr("substring(__id, 1, length(__id) - 1)"), F.lit(",")))
    identity = F.when(F.col("__again"), F.concat(own, F.lit('"row":"'), number, F.lit('"}'))).otherwise(F.col("__id"))
    return rows.select(
        _section_id(m, identity).alias("section_id"), row_title(m, number).alias("title"),
        row_text(m.text_columns or cells).alias("body"), F.array_join(row_tags(m, source), ",").alias("tags"), identity.alias("identity_json"),
    )


def limited(df: DataFrame, order: Sequence[str], rows: int = MAX_ROWS) -> tuple[DataFrame, bool]:
    """The first rows in order and whether there were more: the row limit of an import is a feature of it."""
    first = df.orderBy(*order).limit(rows + 1)
    more = first.count() > rows
    return first.limit(rows), more


def sqlite_tables(path: str) -> list[tuple[str, str]]:
    """(name, kind) of the user tables and views of a database file, ordered by kind and name."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        return con.execute(
            "SELECT name, type FROM sqlite_schema WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' AND name NOT LIKE 'lnote_%' ORDER BY type, name"
        ).fetchall()


def sqlite_columns(path: str, table: str) -> list[tuple[str, str, bool, int]]:
    """(name, type, nullable, key position) of the visible columns."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        quoted = table.replace('"', '""')
        return [(r[1], r[2], not r[3], r[5]) for r in con.execute(f'PRAGMA table_xinfo("{quoted}")') if r[6] != 1]


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def read_sqlite(spark: SparkSession, path: str, table: str, rows_per_task: int = MAX_ROWS) -> DataFrame:
    """All rows of a table or view of a database file, cells as strings, blobs as length and digest.

    The file lies where all executors can read it. Tables are read by ranges of their row numbers, many at once; what has no
    row numbers (a view) by one task, which streams it.
    """
    names = [c[0] for c in sqlite_columns(path, table)]
    chosen = ", ".join(map(_quoted, names))
    ranges: list[tuple[int | None, int | None]] = [(None, None)]
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        try:
            low, high, count = con.execute(f"SELECT min(rowid), max(rowid), count(*) FROM {_quoted(table)}").fetchone()
            numbered = isinstance(low, int) and isinstance(high, int) and ("rowid" not in {n.lower() for n in names})
        except sqlite3.OperationalError:
            numbered, count = False, 0
        if numbered:
            step = max(1, -(-(high - low + 1) * rows_per_task // max(count, 1)))
            ranges = [(a, a + step) for a in range(low, high + 1, step)]

    def cells(values: tuple) -> list[str | None]:
        return [None if v is None else f"<BLOB {len(v)} bytes sha256:{hashlib.sha256(v).hexdigest()}>" if isinstance(v, bytes) else str(v) for v in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
                    where = "" if low is None else f" WHERE rowid >= {low} AND rowid < {high}"
                    cursor = con.execute(f"SELECT {chosen} FROM {_quoted(table)}{where}")
                    while some := cursor.fetchmany(2_000):
                        columns = zip(*map(cells, some), strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=names)

    parts = spark.createDataFrame(ranges, "low long, high long").repartition(max(1, len(ranges)), "low")
    return parts.mapInArrow(run, ", ".join(f"`{n}` string" for n in names))


def import_sqlite(spark: SparkSession, path: str, m: Mapping, rows: int = MAX_ROWS) -> tuple[DataFrame, list[str]]:
    """(sections, warnings) of a table: the first `rows` rows in the order of its key; more rows are said in a warning."""
    keys = [c[0] for c in sorted(sqlite_columns(path, m.name), key=lambda c: c[3]) if c[3]]
    m = m if m.id_columns else replace(m, id_columns=keys)
    df = read_sqlite(spark, path, m.name)
    types = {c[0]: c[1].upper() for c in sqlite_columns(path, m.name)}
    number = lambda c: F.col(c).cast("double") if any(t in types.get(c, "") for t in ("INT", "REAL", "NUM", "DOUB", "FLOA")) else F.col(c)
    order = list(m.order_columns or m.id_columns or df.columns)
    first, more = limited(df, [number(c) for c in order], rows)
    return row_sections(first, m), [f"{m.name}: only the first {rows} rows were imported"] if more else []


def import_directory(spark: SparkSession, path: str, mappings: Sequence[Mapping] = (), rows: int = MAX_ROWS) -> tuple[DataFrame, DataFrame, list[str]]:
    """(documents, sections, warnings) of all tables and views of a database file, or of those with a mapping."""
    known = {m.name: m for m in mappings}
    docs, sections, warnings = [], None, []
    for name, kind in sqlite_tables(path):
        if known and name not in known:
            continue
        m = known.get(name) or Mapping(name, [], kind=kind)
        got, said = import_sqlite(spark, path, m, rows)
        got = got.withColumn("document_id", F.lit(f"table.{name}"))
        sections = got if sections is None else sections.unionByName(got)
        docs.append((f"table.{name}", m.document_title or name, kind))
        warnings += said
    empty = "section_id string, title string, body string, tags string, identity_json string, document_id string"
    return spark.createDataFrame(docs, "document_id string, title string, kind string"), sections if sections is not None else spark.createDataFrame([], empty), warnings
