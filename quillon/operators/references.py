"""References to records that do not exist, kept as incremental state.

The state is a log in the shared folder, which every batch appends to: delivered
parents and removals of parents by key, references with the outcome of their
probe, versions of references that a later probe replaced, and running counts.

A step looks up the new references among the parents of their keys; parents that
arrive or are removed touch their keys only, and just the references of touched
keys are probed again: waiting orphans get resolved, removed parents reopen theirs.

Outcomes: ``resolved`` (a live parent was there when the reference came),
``late`` (the first live parent came afterwards: the reference was an orphan on
arrival and no longer waits), ``deleted`` (parents came, all were removed),
``missing`` (none ever came). All but ``resolved`` are orphans on arrival;
``deleted`` and ``missing`` wait.

Defined cases: a null reference is no reference; a reference whose other key
parts are null (no pack, no document) can match nothing and is ``missing``; a
null arrival of a reference makes every parent late, a parent with a null arrival
never counts as there. Empty tables give empty results. Repeated rows count each
for themselves; ids are compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import runtime as rt

KEYS = ["target", "k1", "k2", "k3"]


@dataclass(frozen=True)
class Reference:
    """One referring field: where it stands and which key of which target it names."""

    table: str
    field: str
    row_id: str
    target: str
    key: Sequence[Column]


def claim_pack(ref: str) -> Column:
    """The pack before '::', else the row's own pack."""
    at = F.instr(F.col(ref), "::")
    return F.when(at > 0, F.substring(F.col(ref), F.lit(1), at - 1)).otherwise(F.col("pack_id"))


def claim_local(ref: str) -> Column:
    at = F.instr(F.col(ref), "::")
    return F.when(at > 0, F.substring(F.col(ref), at + 2, F.length(ref))).otherwise(F.col(ref))


def knowledge_references() -> list[Reference]:
    """The four referring fields of claims and statement relations."""
    pack, doc, none = F.col("pack_id"), F.col("source_document_id"), F.lit("")
    out = [
        Reference("lnote_claims", "source_document_id", "claim_order", "documents", (pack, doc, none)),
        Reference("lnote_claims", "source_section_id", "claim_order", "sections", (pack, doc, F.col("source_section_id"))),
    ]
    for field in ("source_claim_id", "target_claim_id"):
        key = (claim_pack(field), claim_local(field), none)
        out.append(Reference("lnote_statement_relations", field, "relation_order", "claims", key))
    return out


def references_of(df: DataFrame, specs: Sequence[Reference]) -> DataFrame:
    """(table_name, row_order, field_name, target, k1, k2, k3, arrived_at) of the non-null references, in one scan."""
    each = [
        F.struct(
            F.lit(s.table).alias("table_name"), F.col(s.row_id).cast("long").alias("row_order"),
            F.lit(s.field).alias("field_name"), F.lit(s.target).alias("target"),
            *[k.alias(f"k{i + 1}") for i, k in enumerate(s.key)],
            F.col("ingested_at").alias("arrived_at"), F.col(s.field).isNotNull().alias("given"),
        )
        for s in specs
    ]
    return df.select(F.inline(F.array(*each))).where("given").drop("given")


def parents_of(df: DataFrame, target: str, row_id: str, *key: Column) -> DataFrame:
    """(target, k1, k2, k3, parent_row, arrived_at, removed_at) of the delivered target rows."""
    removed = F.col("deleted_at") if "deleted_at" in df.columns else F.lit(None).cast("timestamp")
    named = [k.alias(f"k{i + 1}") for i, k in enumerate(key)]
    return df.select(
        F.lit(target).alias("target"), *named, F.col(row_id).cast("long").alias("parent_row"),
        F.col("ingested_at").alias("arrived_at"), removed.alias("removed_at"),
    )


def outcome(arrived: Column, first_live: Column, removed_rows: Column) -> Column:
    return (
        F.when(first_live.isNotNull() & arrived.isNotNull() & (first_live <= arrived), "resolved")
        .when(first_live.isNotNull(), "late")
        .when(F.coalesce(removed_rows, F.lit(0)) > 0, "deleted")
        .otherwise("missing")
    )


STATES = {
    "parents": "target string, k1 string, k2 string, k3 string, parent_row long, arrived_at timestamp, removed_at timestamp, bucket int, seq int",
    "removals": "target string, k1 string, k2 string, k3 string, parent_row long, bucket int, seq int",
    "references": "table_name string, row_order long, field_name string, target string, k1 string, k2 string, k3 string, arrived_at timestamp, status string, bucket int, seq int",
    "replaced": "table_name string, row_order long, field_name string, old_seq int, old_status string, target string, k1 string, k2 string, k3 string, "
    "arrived_at timestamp, status string, bucket int, seq int",
    "snapshots": "table_name string, field_name string, seen long, waiting long, resolved_late long, snapshot string, seq int",
}
#: Folders by key hash that a state has, and log entries after which they are merged into one.
BUCKETS, COMPACT_AFTER = 8, 24
#: Keys, and their bytes, that a batch may have for its keys to be broadcast to the state.
SMALL_BATCH, SMALL_BATCH_BYTES = 150_000, 12 << 20
REFERENCE = ["table_name", "row_order", "field_name"]


class OrphanTracker:
    """Keyed pending-orphan state in a folder: a log of batches, each split into buckets by key.

    ``step`` appends what a batch brings and what it changes, and nothing else: it
    looks up the batch's references among the parents of the buckets they fall into,
    and probes again only the orphans whose parents the batch brings, and the
    references whose parents it removes. A reference whose outcome changes is
    written anew and its former version noted in ``replaced``. A batch counts once
    its marker is written; a batch id that counts already is skipped, one that
    failed half-way is overwritten, and a tracker opened on the same path goes on
    where the last one ended. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS, compact_after: int = COMPACT_AFTER):
        self.spark, self.compact_after = spark, compact_after
        self.path = path or rt.new_path(spark, "orphans")
        marks = [m.split("~", 2) for m in rt.names_in(spark, f"{self.path}/commits")]
        self.log = [(int(seq), kind) for seq, kind, _ in marks]
        self.batches = {batch for _, kind, batch in marks if kind == "step"}
        size = rt.names_in(spark, f"{self.path}/buckets")
        self.buckets = int(size[0]) if size else buckets
        if not size:
            rt.touch(spark, f"{self.path}/buckets/{buckets}")

    def _at(self, name: str, seq: int) -> str:
        return f"{self.path}/{name}/seq={seq}"

    def _read(self, name: str, seqs: Sequence[int] | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """Committed log entries of a table (or the named ones), of the named buckets."""
        if seqs is None:
            base = max((s for s, kind in self.log if kind == "base"), default=0)
            seqs = [s for s, _ in self.log if s >= base]
        paths = [self._at(name, s) for s in seqs if rt.path_exists(self.spark, self._at(name, s))]
        if not paths:
            return self.spark.createDataFrame([], STATES[name])
        out = self.spark.read.schema(STATES[name]).option("basePath", f"{self.path}/{name}").parquet(*paths)
        return out if buckets is None or len(buckets) == self.buckets else out.where(F.col("bucket").isin(list(buckets)))

    def _write(self, name: str, df: DataFrame, seq: int) -> DataFrame:
        columns = [c.split()[0] for c in STATES[name].split(", ")]
        df = df.select([c for c in columns if c != "seq"])
        writer = df.hint("rebalance", "bucket").write.partitionBy("bucket") if "bucket" in columns else df.coalesce(1).write
        writer.mode("overwrite").option("compression", "zstd").parquet(self._at(name, seq))
        return self._read(name, [seq])

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*KEYS), F.lit(self.buckets)).cast("int"))

    def _touched(self, name: str, seq: int) -> set[int]:
        return {int(n.split("=")[1]) for n in rt.names_in(self.spark, self._at(name, seq)) if n.startswith("bucket=")}

    def _index(self, buckets: Sequence[int], seqs: Sequence[int], only: DataFrame | None) -> DataFrame:
        """Per key the earliest arrival among live parents and the number of removed ones. Partial aggregation comes before the shuffle."""
        parents, gone = self._read("parents", seqs, buckets), self._read("removals", seqs, buckets)
        if only is not None:
            parents, gone = parents.join(F.broadcast(only), KEYS, "left_semi"), gone.join(F.broadcast(only), KEYS, "left_semi")
        live = F.col("removed_at").isNull()
        if any(rt.path_exists(self.spark, self._at("removals", s)) for s in seqs):
            gone = gone.select("target", "parent_row").distinct().withColumn("gone", F.lit(True))
            gone = F.broadcast(gone) if rt.fits_broadcast(gone) else gone
            parents, live = parents.join(gone, ["target", "parent_row"], "left"), live & F.col("gone").isNull()
        return parents.groupBy(*KEYS).agg(F.min(F.when(live, F.col("arrived_at"))).alias("first_live_at"), F.sum(F.when(live, 0).otherwise(1)).alias("removed_rows"))

    def _probe(self, refs: DataFrame, index: DataFrame, plain: bool) -> DataFrame:
        """refs with the outcome of a look into the index; plain: refs hold no hot key, or the index is broadcast."""
        found = refs.join(index, KEYS, "left") if plain else rt.skew_join(refs, index, KEYS, "left")
        return found.select(*refs.columns, outcome(F.col("arrived_at"), F.col("first_live_at"), F.col("removed_rows")).alias("status"))

    def step(self, parents: DataFrame, refs: DataFrame, removals: DataFrame | None = None, label: str = "", batch_id: str | int | None = None) -> bool:
        """Take one batch: arrived parents, arrived references, and removals of rows that came in earlier batches.

        removals holds (target, k1, k2, k3, parent_row, …). Returns False, and does nothing, for a batch id taken before.
        """
        seq = max((s for s, _ in self.log), default=0) + 1
        batch = quote(str(seq if batch_id is None else batch_id), safe="")
        if batch in self.batches:
            return False
        for name in STATES:
            rt.drop_path(self.spark, self._at(name, seq))  # of an attempt that failed
        before = [s for s, _ in self.log if s >= max((x for x, kind in self.log if kind == "base"), default=0)]
        seqs = [*before, seq]
        refs = self._bucketed(refs)
        jobs: list[Callable[[], object]] = [lambda: self._write("parents", self._bucketed(parents), seq)]
        if before:
            jobs.append(lambda: refs.agg(F.count(F.lit(1)).alias("n"), F.collect_set("bucket").alias("b")).first())
            if removals is not None:
                jobs.append(lambda: self._write("removals", self._bucketed(removals), seq))
        with ThreadPoolExecutor(len(jobs)) as pool:  # independent of each other
            new_parents, *rest = [f.result() for f in [pool.submit(inheritable_thread_target(self.spark)(job)) for job in jobs]]
        buckets, only, changed, small = None, None, None, False
        if before:
            changed_buckets = self._touched("parents", seq) | self._touched("removals", seq)
            buckets = sorted(changed_buckets | set(rest[0]["b"]))
            key = lambda df, gone: df.select(*KEYS, F.lit(gone).alias("gone"))
            keys = key(new_parents, False)
            if len(rest) > 1:
                keys = keys.unionByName(key(rest[1], True))
            small = rest[0]["n"] <= SMALL_BATCH
            if small:  # of a small batch also the keys it looks up, so that no others are aggregated
                keys = keys.unionByName(key(refs, None))
            keys = rt.written(keys.groupBy(*KEYS).agg(F.max("gone").alias("gone")), "batch-keys")
            few = rt.fits_broadcast(keys, SMALL_BATCH, SMALL_BATCH_BYTES)
            only = keys.select(KEYS) if small and few else None
        index = self._index(buckets, seqs, only)
        if before:
            index = rt.written(index, "batch-index")
            old, touched = self.references(sorted(changed_buckets)), keys.where("gone is not null")
            met = old.join(F.broadcast(touched), KEYS) if few else rt.skew_join(old, touched, KEYS, "inner")
            met = met.where("status <> 'resolved' or gone").withColumnRenamed("seq", "old_seq").withColumnRenamed("status", "old_status").drop("gone")
            near = F.broadcast(index.join(F.broadcast(touched.select(KEYS)), KEYS, "left_semi")) if few else index
            changed = self._write("replaced", self._probe(met, near, few).where("status <> old_status"), seq)
        probed = self._probe(refs, index, small)
        if changed is not None:
            probed = probed.unionByName(changed.select(probed.columns))
        now = self._write("references", probed, seq)
        waits = lambda c: F.col(c).isin("missing", "deleted").cast("long")
        late = lambda c: (F.col(c) == "late").cast("long")
        sums = now.select("table_name", "field_name", F.lit(1).alias("seen"), waits("status").alias("waiting"), late("status").alias("resolved_late"))
        if changed is not None:
            sums = sums.unionByName(changed.select("table_name", "field_name", F.lit(-1).alias("seen"), (-waits("old_status")).alias("waiting"), (-late("old_status")).alias("resolved_late")))
            sums = sums.unionByName(self._read("snapshots", before[-1:]).select(sums.columns))
        names = ["seen", "waiting", "resolved_late"]
        self._write("snapshots", sums.groupBy("table_name", "field_name").agg(*[F.sum(n).alias(n) for n in names]).withColumn("snapshot", F.lit(label)), seq)
        self._commit(seq, "step", batch)
        if before:
            rt.forget(keys, index)
        if len(before) + 1 > self.compact_after:
            self.compact()
        return True

    def _commit(self, seq: int, kind: str, batch: str) -> None:
        rt.touch(self.spark, f"{self.path}/commits/{seq:09d}~{kind}~{batch}")
        self.log.append((seq, kind))
        if kind == "step":
            self.batches.add(batch)

    def references(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """Every reference with its present outcome."""
        rows, old = self._read("references", buckets=buckets), self._read("replaced", buckets=buckets)
        if not any(rt.path_exists(self.spark, self._at("replaced", s)) for s, _ in self.log):
            return rows
        old = old.select(*REFERENCE, F.col("old_seq").alias("seq")).distinct()
        return rows.join(F.broadcast(old) if rt.fits_broadcast(old) else old, [*REFERENCE, "seq"], "left_anti")

    def snapshots(self) -> DataFrame:
        """Counts at the end of every batch: references seen, waiting orphans, orphans resolved late."""
        return self._read("snapshots", [s for s, kind in self.log if kind == "step"]).select("table_name", "field_name", "seen", "waiting", "resolved_late", "snapshot")

    def compact(self) -> None:
        """Merge the log into one entry; the entries it replaces are removed once it counts."""
        old = [s for s, _ in self.log]
        seq = max(old) + 1
        for name in STATES:
            rt.drop_path(self.spark, self._at(name, seq))
        gone = self._read("removals").select("target", "parent_row").distinct().withColumn("gone", F.lit(True))
        parents = self._read("parents").drop("seq").join(F.broadcast(gone) if rt.fits_broadcast(gone) else gone, ["target", "parent_row"], "left")
        # a removal keeps no time of its own; that the row is removed is all the outcome needs
        removed = F.coalesce("removed_at", F.when(F.col("gone"), F.coalesce("arrived_at", F.lit("1970-01-01").cast("timestamp"))))
        self._write("parents", parents.withColumn("removed_at", removed), seq)
        self._write("references", self.references(), seq)
        self._write("snapshots", self._read("snapshots", [max(s for s, kind in self.log if kind == "step")]), seq)
        self._commit(seq, "base", "")
        for s in old:
            for name in ("parents", "removals", "references", "replaced"):
                rt.drop_path(self.spark, self._at(name, s))


def knowledge_feed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(parents, references) of the knowledge tables."""
    claims = rt.table(spark, sf_dir, "lnote_claims", "claim_order", "pack_id", "claim_id", "source_document_id", "source_section_id", "ingested_at", "deleted_at")
    sections = rt.table(spark, sf_dir, "lnote_sections", "section_row", "pack_id", "document_id", "section_id", "ingested_at", "deleted_at")
    documents = rt.table(spark, sf_dir, "lnote_documents", "document_order", "pack_id", "document_id", "ingested_at", "deleted_at")
    relations = rt.table(spark, sf_dir, "lnote_statement_relations", "relation_order", "pack_id", "source_claim_id", "target_claim_id", "ingested_at")
    pack, none = F.col("pack_id"), F.lit("")
    parents = (
        parents_of(documents, "documents", "document_order", pack, F.col("document_id"), none)
        .unionByName(parents_of(sections, "sections", "section_row", pack, F.col("document_id"), F.col("section_id")))
        .unionByName(parents_of(claims, "claims", "claim_order", pack, F.col("claim_id"), none))
    )
    specs = knowledge_references()
    refs = references_of(claims, specs[:2]).unionByName(references_of(relations, specs[2:]))
    return parents, refs


def quarters(*feeds: DataFrame) -> list[str]:
    """First days of the quarters in which anything arrived but the earliest: the cuts between quarterly batches."""
    days = feeds[0].select("arrived_at")
    for f in feeds[1:]:
        days = days.unionByName(f.select("arrived_at"))
    starts = days.where("arrived_at is not null").select(F.date_format(F.date_trunc("quarter", "arrived_at"), "yyyy-MM-dd").alias("q")).distinct().collect()
    return sorted(r["q"] for r in starts)[1:]


def track(spark: SparkSession, parents: DataFrame, refs: DataFrame, cuts: Sequence[str], path: str | None = None) -> OrphanTracker:
    """Replay a feed in the batches that the cuts of arrival time make, each row in the batch of its arrival.

    A row removed within its own batch arrives removed; one removed in a later
    batch is live until then. Rows without an arrival time come in the first batch.
    """
    tracker = OrphanTracker(spark, path)
    number = lambda c: sum(((F.col(c) >= F.lit(x).cast("timestamp")).cast("int") for x in cuts), F.lit(0))
    batch, gone_in = F.coalesce(number("arrived_at"), F.lit(0)), number("removed_at")
    removed_later = F.coalesce(F.col("gone_in") > F.col("batch"), F.lit(False))
    fed = parents.withColumn("batch", batch).withColumn("gone_in", gone_in)
    told, gone = refs.withColumn("batch", batch), fed.where(removed_later)
    if len(cuts) > 1:  # each batch reads its own part instead of all rows
        fed, told, gone = rt.written(fed, "feed-parents", ["batch"]), rt.written(told, "feed-references", ["batch"]), rt.written(gone, "feed-removals", ["gone_in"])
    for n in range(len(cuts) + 1):
        arrived = fed.where(F.col("batch") == n).withColumn("removed_at", F.when(~removed_later, F.col("removed_at"))).drop("batch", "gone_in")
        removals = gone.where(F.col("gone_in") == n).drop("batch", "gone_in") if n else None
        label = f"before {cuts[n]}" if n < len(cuts) else "all"
        tracker.step(arrived, told.where(F.col("batch") == n).drop("batch"), removals, label, label)
    return tracker


def replayed(spark: SparkSession, sf_dir: str) -> OrphanTracker:
    """The knowledge tables taken in two batches, cut at the middle one of their quarters."""
    feed = knowledge_feed(spark, sf_dir)
    starts = quarters(*feed)
    return track(spark, *feed, starts[len(starts) // 2 :][:1])


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references: (table_name, row_order, field_name)."""
    return replayed(spark, sf_dir).references().where("status <> 'resolved'").select(REFERENCE).distinct()


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References and orphans per table, field and month of arrival."""
    n = lambda s: F.sum((F.col("status") == s).cast("long"))
    return replayed(spark, sf_dir).references().groupBy("table_name", "field_name", F.date_format("arrived_at", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("reference_count"),
        F.sum((F.col("status") != "resolved").cast("long")).alias("orphan_count"),
        n("late").alias("late_count"), n("deleted").alias("deleted_count"), n("missing").alias("missing_count"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waiting orphans at the end of every quarter in which anything arrived."""
    feed = knowledge_feed(spark, sf_dir)
    return track(spark, *feed, quarters(*feed)).snapshots()
