import random
from datetime import datetime, timedelta

import pytest

from quillon import runtime as rt
from quillon.operators import references

T0 = datetime(2024, 6, 1)
DOC = "document_order long, pack_id string, document_id string, ingested_at timestamp, deleted_at timestamp, target string"
SEC = "section_row long, pack_id string, document_id string, section_id string, ingested_at timestamp, deleted_at timestamp"
CLAIM = "claim_order long, pack_id string, claim_id string, source_document_id string, source_section_id string, ingested_at timestamp, deleted_at timestamp, status string"
REL = "relation_order long, pack_id string, source_claim_id string, target_claim_id string, ingested_at timestamp"


def feed(seed, n=60):
    r = random.Random(seed)
    at = lambda: r.choice([None] + [T0 + timedelta(days=r.randint(0, 600)) for _ in range(9)])
    gone = lambda: r.choice([None, None, None, T0 + timedelta(days=r.randint(0, 700))])
    pick = lambda *v: r.choice(v)
    docs = [(i, pick("p", "q", None), pick("a", "b", "A", ""), at(), gone(), "x") for i in range(n // 6)]
    secs = [(i, pick("p", "q"), pick("a", "b", None), pick("s", "t", "é"), at(), gone()) for i in range(n // 3)]
    claims = [(i, pick("p", "q", None), pick("c1", "c2", "c3"), pick("a", "b", "zz", None), pick("s", "t", "u", None), at(), gone(), "y") for i in range(n)]
    rels = [(i, pick("p", "q"), pick("c1", "p::c2", "r::c1", "", None), pick("c3", "q::c9", "::c1"), at()) for i in range(n)]
    return docs, secs, claims, rels


def brute(docs, secs, claims, rels):
    live = lambda rows, key, want, at: any(
        key(x) == want and x[-1] is None and x[-2] is not None and at is not None and x[-2] <= at for x in rows
    )
    d = [(x[1], x[2], x[3], x[4]) for x in docs]
    s = [(x[1], x[2], x[3], x[4], x[5]) for x in secs]
    c = [(x[1], x[2], x[5], x[6]) for x in claims]
    out = set()
    for o, p, _, doc, sec, at, _, _ in claims:
        if doc is not None and (p is None or not live(d, lambda x: x[:2], (p, doc), at)):
            out.add(("lnote_claims", o, "source_document_id"))
        if sec is not None and (None in (p, doc) or not live(s, lambda x: x[:3], (p, doc, sec), at)):
            out.add(("lnote_claims", o, "source_section_id"))
    for o, p, src, tgt, at in rels:
        for f, ref in (("source_claim_id", src), ("target_claim_id", tgt)):
            if ref is None:
                continue
            key = tuple(ref.split("::", 1)) if "::" in ref else (p, ref)
            if not live(c, lambda x: x[:2], key, at):
                out.add(("lnote_statement_relations", o, f))
    return out


def write_all(save, docs, secs, claims, rels):
    save("lnote_documents", docs, DOC)
    save("lnote_sections", secs, SEC)
    save("lnote_claims", claims, CLAIM)
    return save("lnote_statement_relations", rels, REL)


@pytest.mark.parametrize("seed", [1, 2])
def test_found_equals_brute_force_whatever_the_batches(spark, save, seed, monkeypatch):
    if seed == 1:
        monkeypatch.setattr(rt.skew_join, "__defaults__", ("left", 4, 5))
    tables = feed(seed)
    where = write_all(save, *tables)
    want = brute(*tables)
    got = {tuple(r) for r in references.found(spark, where).collect()}
    assert got == want
    parents, refs = references.knowledge_feed(spark, where)
    many = references.track(spark, parents, refs, ("2024-09-01", "2025-06-01"))
    assert {(r[0], r[1], r[2]) for r in many.references().where("status <> 'resolved'").select("table_name", "row_order", "field_name").collect()} == want
    waiting = many.references().where("status in ('missing', 'deleted')").count()
    assert sum(r["waiting"] for r in many.snapshots().where("snapshot = 'all'").collect()) == waiting
    if seed == 1:
        return
    before = sorted(map(str, many.references().drop("seq").collect()))
    many.compact()
    assert sorted(map(str, many.references().drop("seq").collect())) == before
    assert many.snapshots().count() == references.OrphanTracker(spark, many.path).snapshots().count() > 4


def test_arrival_resolves_and_removal_reopens(spark):
    parent = "target string, k1 string, k2 string, k3 string, parent_row long, arrived_at timestamp, removed_at timestamp"
    ref = "table_name string, row_order long, field_name string, target string, k1 string, k2 string, k3 string, arrived_at timestamp"
    t = references.OrphanTracker(spark)
    none = spark.createDataFrame([], parent)
    t.step(none, spark.createDataFrame([("c", 1, "f", "d", "p", "a", "", T0)], ref), label="1")
    assert t.references().first()["status"] == "missing"
    t.step(spark.createDataFrame([("d", "p", "a", "", 1, T0 + timedelta(1), None)], parent), spark.createDataFrame([], ref), label="2")
    assert t.references().first()["status"] == "late"
    gone = spark.createDataFrame([("d", "p", "a", "", 1, T0 + timedelta(1), T0 + timedelta(2))], parent)
    t.step(none, spark.createDataFrame([], ref), gone, "3")
    assert t.references().first()["status"] == "deleted"


def test_state_outlives_its_process_and_takes_a_batch_once(spark):
    parent = "target string, k1 string, k2 string, k3 string, parent_row long, arrived_at timestamp, removed_at timestamp"
    ref = "table_name string, row_order long, field_name string, target string, k1 string, k2 string, k3 string, arrived_at timestamp"
    first = references.OrphanTracker(spark)
    refs = spark.createDataFrame([("c", i, "f", "d", "p", f"k{i % 50}", "", T0) for i in range(200)], ref)
    parents = spark.createDataFrame([("d", "p", f"k{i}", "", i, T0, None) for i in range(25)], parent)
    assert first.step(parents, refs, label="one", batch_id=7)
    assert not first.step(parents, refs, label="one", batch_id=7)
    again = references.OrphanTracker(spark, first.path)
    assert not again.step(parents, refs, label="one", batch_id=7)
    one = spark.createDataFrame([("d", "p", "k30", "", 99, T0 + timedelta(1), None)], parent)
    assert again.step(one, refs.limit(0), label="two", batch_id=8)
    # a batch of one parent writes its own key and the four references it resolves
    assert again._read("references", [2]).count() == again._read("replaced", [2]).count() == 4
    assert again._read("parents", [2]).count() == 1
    by = {r["status"]: r["count"] for r in references.OrphanTracker(spark, first.path).references().groupBy("status").count().collect()}
    assert by == {"resolved": 100, "late": 4, "missing": 96}
    assert [(r["seen"], r["waiting"], r["resolved_late"]) for r in again.snapshots().orderBy("snapshot").collect()] == [(200, 100, 0), (200, 96, 4)]


def test_empty_tables(spark, save):
    where = write_all(save, [], [], [], [])
    assert references.found(spark, where).count() == 0
    assert references.counts(spark, where).count() == 0
