import json
import math
import random
import sqlite3
import uuid
import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from quillon import runtime as rt
from quillon.functions import chronology
from quillon.operators import compare, evidence, graph, model, notes, reviews, search, tasks, views
from quillon.plans import knowledge_queries
from quillon.sources import database, documents, interchange, packs, staging
from quillon.streaming import queue

RECORD = "id string, kind string, relation string, authority string, title string, document_title string, aliases string, entity_names string, tags string, body string"


def records(spark, n=300):
    rows = [
        ("r1", "section", None, "reference", "Dosing of Amoxil", "Guide", "Amoxil amoxicillin", "Amoxil", "dose", "Give 500 mg of amoxil twice daily"),
        ("r2", "section", None, "proposed", "Storage", "Guide", "", "", "", "Keep amoxil dry"),
        ("n1", "note", "supersedes", "personal", "My amoxil note", "Note", "", "", "personal", "amoxil 250 mg"),
    ]
    rows += [(f"x{i}", "section", None, "reference", f"Topic {i}", "Other", "", "", "", f"unrelated text number {i} marker{i:04d}") for i in range(n)]
    return spark.createDataFrame(rows, RECORD)


def test_ranking(spark):
    rec = records(spark)
    postings = search.token_scores(rec)
    got = [(r["id"], r["relevance"]) for r in search.search_postings(rec, postings, "amoxil", 10).orderBy("rank").collect()]
    assert {i for i, _ in got} == {"r1", "r2", "n1"} and got[0] == ("r1", 100)
    df = 3
    n1 = 5.5 * 1 / max(1, math.log2(2 + df)) * 2.6
    score = {r["id"]: r["score"] for r in search.search_postings(rec, postings, "amoxil", 10).collect()}
    assert score["n1"] == pytest.approx(n1, abs=1e-5)
    assert search.search_postings(rec, postings, "amoxli", 10).count() == 3  # corrected
    assert search.search_postings(rec, postings, "zzzzzz", 10).count() == 0
    index = search.SearchIndex.build(rec, rt.new_path(spark, "index"))
    assert index.bm25("amoxil").orderBy("rank").first()["id"] == "r1" and index.bm25("").count() == 0
    assert sorted(map(str, index.search("amoxil dosing", 10).collect())) == sorted(map(str, search.search_postings(rec, postings, "amoxil dosing", 10).collect()))
    assert search.search_fallback(rec, "amoxil").orderBy("rank").first()["id"] in ("r1", "n1")
    assert [r["token"] for r in search.suggest(search.vocabulary(postings), "amox", 5).collect()] == ["amoxil", "amoxicillin"]
    fixed = search.corrections(search.vocabulary(postings), ["amoxli"]).collect()
    assert fixed[0]["token"] == "amoxil" and fixed[0]["distance"] == 1
    assert search.search_postings(rec, postings, "marker0150", 10).count() == 1
    assert search.search_postings(rec.limit(0), postings.limit(0), "amoxil").count() == 0


def test_whole_postings_of_a_frequent_token(spark):
    got = search.ranked_postings(search.token_scores(records(spark)).select("token", "id", "score")).collect()
    lists = {}
    for r in got:
        lists.setdefault(r["token"], []).append((r["rank"], r["id"], r["score"], r["df"]))
    whole = sorted(lists["unrelated"])
    assert [x[0] for x in whole] == list(range(1, 301)) and {x[3] for x in whole} == {300}
    assert [x[1] for x in whole] == sorted(f"x{i}" for i in range(300))
    assert [x[1] for x in sorted(lists["amoxil"])] == ["r1", "n1", "r2"] and len(got) == search.token_scores(records(spark)).count()


def test_index_is_built_once_per_state(spark):
    built, state = [], uuid.uuid4().hex
    make = lambda: built.append(1) or records(spark)
    one = search.SearchIndex.opened(spark, f"a-{state}", make)
    two = search.SearchIndex.opened(spark, f"a-{state}", make)
    search.SearchIndex.opened(spark, f"b-{state}", make)
    assert one.path == two.path and len(built) == 2
    wide = records(spark).withColumn("title", F.regexp_replace("title", "Amoxil", "Ａｍｏｘｉｌ"))  # full-width letters
    assert "r1" in [r["id"] for r in search.search_postings(wide, search.token_scores(wide), "dosing amoxil", 10, fuzzy=False).collect()]


def claim(ref, text, subject=None, obj=None):
    return (ref, text, None, subject, obj)


CLAIM = "claim_ref string, text string, quote string, subject string, object string"


def test_discrepancies_equal_all_pairs(spark):
    rows = [
        claim("a1", "Adults receive amoxil 500 mg twice daily", "amoxil"), claim("a2", "Adults receive amoxil 250 mg twice daily", "amoxil"),
        claim("a3", "Children do not receive amoxil", "amoxil"), claim("a4", "Storage cabinet stays dry and cool always"), claim("a5", "Storage cabinet stays not dry and cool"),
        claim("a6", "Something else entirely"), claim("a7", None), claim("a8", "", "amoxil", "x"),
    ]
    res = compare.resources(spark.createDataFrame(rows, CLAIM))
    got = {(r["left_ref"], r["right_ref"]): r for r in compare.detect(res, res.limit(0)).collect()}
    every = spark.createDataFrame([(a[0], b[0]) for a in rows for b in rows if a[0] < b[0]], "left_ref string, right_ref string")
    brute = {(r["left_ref"], r["right_ref"]): r for r in compare.signals(compare.paired(every, res)).collect()}
    assert set(got) == set(brute) and ("a1", "a2") in got and ("a4", "a5") in got
    assert got["a1", "a2"]["signals"] == "numeric_difference" and got["a1", "a2"]["suggested_type"] == "contradicts"
    assert len(got["a1", "a2"]["candidate_id"]) == 16
    known = spark.createDataFrame([("a2", "a1")], "left_ref string, right_ref string")
    assert ("a1", "a2") not in {(r["left_ref"], r["right_ref"]) for r in compare.detect(res, res.limit(0), known).collect()}


def test_registered_discrepancies_equal_all_pairs(spark, monkeypatch, tmp_path):
    """The query finds what all pairs of live claims give, but for those already related, with hot subjects and tokens salted."""
    r = random.Random(4)
    words = "the cabinet label record scale syrup tablet vaccine protocol reviewer".split()
    rows = []
    for i in range(120):
        said = ["the", *r.sample(words[1:], r.randint(2, 7)), *r.choice([[], ["250 mg"], ["500 mg"], ["not"], ["2 hours"], ["children"], ["adults"]])]
        rows.append((i, f"p{i % 3}", f"c{i}", " ".join(said), r.choice([None, "s1", "s1", f"s{i}"]), r.choice([None, "o1", "o2"])))
    schema = "claim_order long, pack_id string, claim_id string, text string, subject_id string, object_id string"
    empty = "cast(null as string) as {0}".format
    data = spark.createDataFrame(rows, schema).selectExpr("*", "'reference' as authority", *map(empty, ("source_document_id", "source_section_id", "source_quote", "payload_json")), "timestamp'2025-01-01' as ingested_at", "if(claim_order % 10 = 7, timestamp'2025-02-01', null) as deleted_at")
    data.write.parquet(f"{tmp_path}/lnote_claims.parquet")
    related = [(i, f"p{i % 3}", f"r{i}", f"c{i}", f"p{(i + 1) % 3}::c{i + 1}") for i in range(0, 118, 2)]
    spark.createDataFrame(related, "relation_order long, pack_id string, relation_id string, source_claim_id string, target_claim_id string").selectExpr(
        "*", "'contradicts' as type", "'confirmed' as status", *map(empty, ("reason",))).write.parquet(f"{tmp_path}/lnote_statement_relations.parquet")
    doc = "document_order long, pack_id string, document_id string, title string, summary string, authority string, effective_from string, source_json string, tags_json string, deleted_at timestamp"
    spark.createDataFrame([], doc).write.parquet(f"{tmp_path}/lnote_documents.parquet")
    ent = "entity_order long, pack_id string, entity_id string, name string, type string, aliases_json string, description string"
    spark.createDataFrame([], ent).write.parquet(f"{tmp_path}/lnote_entities.parquet")
    monkeypatch.setattr(compare, "HOT_CLAIMS", 5)
    got = knowledge_queries.queries()["compare_discrepancies"](spark, str(tmp_path)).collect()
    live = [f"{p}::{c}" for i, p, c, *_ in rows if i % 10 != 7]
    known = {frozenset((f"{p}::{s}", t)) for _, p, _, s, t in related}
    every = spark.createDataFrame([(a, b) for a in live for b in live if a < b and frozenset((a, b)) not in known], "left_ref string, right_ref string")
    res = compare.resources(knowledge_queries._claim_texts(spark, str(tmp_path)))
    want = compare.signals(compare.paired(every, res)).collect()
    assert len(want) > 300 and sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert {s for x in got for s in x["signals"].split(",")} == {"numeric_difference", "negation_difference", "scope_difference", "object_difference"}


def test_blocks_give_all_pairs_once(spark, monkeypatch):
    """Long claims, dates of documents, small blocks and frequent tokens change nothing; sorting does not compare the claims anew."""
    r = random.Random(6)
    words = [f"word{i}" for i in range(24)]
    long = " ".join(f"rare{i}" for i in range(400))
    rows = [(f"c{i}", " ".join(["often", *r.sample(words, r.randint(2, 12)), r.choice(["", "250 mg", "2 hours", "not", "children", "adults"])]), None, r.choice(["", "s1", f"s{i}"]), r.choice([None, "o1", "o2"]), r.choice([None, "2020-01-01", "2024-05-01"])) for i in range(90)]
    rows += [("long1", f"{long} 5 mg", None, None, None, None), ("long2", f"{long} 7 mg", None, None, None, "2021-01-01"), ("short", "rare1 rare2 rare3 9 mg", None, None, None, None)]
    side = F.when(F.col("date").isNotNull(), F.struct(*[(F.col("date") if f == "published_at" else F.lit(None).cast("string")).alias(f) for f in (x.split(":")[0].strip() for x in chronology.SIDE[7:-1].split(","))]))
    res = compare.resources(spark.createDataFrame(rows, CLAIM + ", date string").withColumn("side", side.cast(chronology.SIDE)).drop("date")).localCheckpoint()
    monkeypatch.setattr(compare, "HOT_CLAIMS", 40)
    found = compare.detect(res, res.limit(0))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    every = spark.createDataFrame([(a[0], b[0]) for a in rows for b in rows if a[0] < b[0]], "left_ref string, right_ref string")
    want = compare.signals(compare.paired(every, res)).collect()
    got = found.collect()
    assert len(want) > 200 and sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert [(-x["confidence"], x["candidate_id"]) for x in got] == sorted((-x["confidence"], x["candidate_id"]) for x in got)
    assert {("long1", "long2"), ("long1", "short")} <= {(x["left_ref"], x["right_ref"]) for x in got}
    assert {"later_issue_date", "earlier_issue_date"} <= {s for x in got for s in x["signals"].split(",")}


def test_masks_never_hide_a_pair(spark):
    """What masks tell of shared tokens is never too little, also where ranks share bits, and rejects most unlike pairs."""
    r = random.Random(5)
    rows = [(sorted(r.sample(range(1, 600), r.randint(3, 40))), sorted(r.sample(range(1, 600), r.randint(3, 40)))) for _ in range(300)] + [([1, 129, 257], [257, 385, 513]), ([2, 130], [2, 130])]
    masked = spark.createDataFrame(rows, "a array<long>, b array<long>").select(*[F.struct(F.col(c).alias("tokens"), *[m.alias(f"m{i}") for i, m in enumerate(compare.token_masks(F.col(c)))]).alias(s) for c, s in (("a", "x"), ("b", "y"))])
    got = masked.select(compare.most_shared("x", "y").alias("most"), F.size(F.array_intersect("x.tokens", "y.tokens")).alias("shared"), F.size("x.tokens").alias("n")).collect()
    assert len(got) == 302 and all(x["shared"] <= x["most"] <= x["n"] for x in got)
    few = [x for x in got if x["n"] <= 15 and x["shared"] == 0]
    assert few and sum(x["most"] < 6 for x in few) > 0.7 * len(few)


def test_discrepancies_between_targets_and_references(spark):
    rows = [claim(f"{k}{i}", f"Adults receive amoxil {i} mg twice daily") for k in "amz" for i in (100, 200)]
    res = compare.resources(spark.createDataFrame(rows, CLAIM))
    side = lambda k: res.where(F.col("claim_ref").startswith(k))
    pairs = lambda df: sorted((r["left_ref"], r["right_ref"]) for r in df.collect())
    across = [("m100", "a200"), ("m100", "z200"), ("m200", "a100"), ("m200", "z100")]
    assert pairs(compare.detect(side("m"), res.where("claim_ref not like 'm%'"), internal=False)) == across
    assert pairs(compare.detect(side("m"), res.where("claim_ref not like 'm%'"))) == sorted([*across, ("m100", "m200")])


def test_reviews(spark):
    old = spark.createDataFrame([("1", "a", "b", "refines", "proposed"), ("2", "a", "c", "supports", "confirmed")], "id string, source_ref string, target_ref string, type string, status string")
    review = spark.createDataFrame([("1", "a", "b", "contradicts", None, "accept"), ("3", "x", "y", "supersedes", "refines", "accept"), ("4", "x", "z", "refines", None, "dismiss")], "id string, source_ref string, target_ref string, suggested_type string, selected_type string, decision string")
    out = {r["id"]: r["type"] for r in compare.apply_review(old, review).collect()}
    assert out == {"1": "contradicts", "2": "supports", "3": "refines"}
    choices = spark.createDataFrame([("g", 1, ["a", "b"], "a"), ("g", 2, ["b", "a"], "b"), ("g", 3, ["a", "c"], None)], "group_key string, ord int, refs array<string>, preferred string")
    r = compare.merge_preferences(choices).first()
    assert r["claim_refs"] == ["a", "b", "c"] and r["preferred_refs"] == ["b"]
    sel = spark.createDataFrame([("s", "g", ["p::a", "p::b"], ["p::a"]), ("t", "h", ["p::a"], []), ("u", "i", ["p::a", "p::zz"], []), ("v", "j", ["p::a", "p::b"], ["p::q"])], "id string, group_key string, claim_refs array<string>, preferred_refs array<string>")
    refs = spark.createDataFrame([("p::a",), ("p::b",)], "claim_ref string")
    assert {x["id"]: x["state"] for x in model.selection_groups(sel, refs).collect()} == {"s": "resolved", "t": "invalid", "u": "unresolved", "v": "invalid"}
    ents = spark.createDataFrame([("e1", "Amoxil", ["AMX"])], "entity_id string, name string, aliases array<string>")
    found = {r["name"]: (r["entity_id"], r["created"]) for r in compare.resolve_names(spark.createDataFrame([("amx",), ("New",)], "name string"), ents).collect()}
    assert found["amx"] == ("e1", False) and found["New"][1]


def test_evidence(spark):
    st = spark.createDataFrame([(1, 1, "The daily dose is 500 mg [S1]."), (1, 2, "The daily dose is 900 mg [S1]."), (1, 3, "The dose is not given daily [S1]."), (1, 4, "No citation stands here for dose."), (1, 5, "Insufficient data:")], "answer_id long, statement_no int, statement string")
    fr = spark.createDataFrame([(1, "S1", "Adults: the daily dose is 500 mg."), (1, "S1", "Other.")], "answer_id long, source_id string, fragment string")
    out = {r["statement_no"]: r for r in evidence.verify(st, fr).collect()}
    assert out[1]["supported"] and not out[2]["supported"] and not out[3]["supported"] and out[4]["reason"] == "missing-citation" and 5 not in out
    packed = evidence.packed_prompt(spark.createDataFrame([(1, i, f"[S{i}] ", "text " * 400) for i in range(1, 9)], "answer_id long, ord int, heading string, body string"))
    blocks = [r["block"] for r in packed.orderBy("ord").collect()]
    assert all(len(b) <= 1300 + 5 for b in blocks) and len("\n\n".join(blocks)) <= 5600
    src = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "answer_id long, ord int, section_ref string")
    con = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "z")], "section_ref string, counterpart string")
    rows = [(r["source_no"], r["section_ref"], r["supplemental"]) for r in evidence.discrepancy_expansion(src, con).orderBy("source_no").collect()]
    assert rows == [(1, "a", False), (2, "x", True), (3, "b", False), (4, "y", True)]


def test_graph_categories(spark):
    raw = spark.createDataFrame([("n", 2, [("a", 1.0), ("b", 1.0)]), ("n", 2, [("a", 2.0)]), ("n", 1, [("c", 9.0)])], "id string, priority int, categories array<struct<id:string,weight:double>>")
    got = {r["category"]: r["weight"] for r in graph.category_weights(raw).collect()}
    assert got == {"a": 0.75, "b": 0.25}
    e = spark.createDataFrame([("contains", "a", "b"), ("mentions", "b", "c")], "type string, source string, target string")
    assert {(r["neighbour"], r["direction"]) for r in graph.ego_network(e, "b").collect()} == {("a", "in"), ("c", "out")}


def test_tasks_and_store(spark):
    ev = spark.createDataFrame([(1, "k", "enqueue", None), (2, "k", "start", None), (3, "k", "progress", 0.5), (4, "k", "enqueue", None), (5, "k", "progress", 0.2), (6, "k", "complete", None), (7, "k", "fail", None), (8, "k", "enqueue", None)], "event_id long, task_key string, action string, progress double")
    state = (0, "", 0.0, -1)
    seen = []
    for r in ev.orderBy("event_id").collect():
        state = queue.step(state, r["action"], r["progress"], r["event_id"])
        seen.append(state[:3])
    assert seen == [(1, "queued", 0.0), (1, "active", 0.0), (1, "active", 0.5), (1, "active", 0.5), (1, "active", 0.5), (1, "completed", 1.0), (1, "completed", 1.0), (2, "queued", 0.0)]
    values = spark.createDataFrame([(4,), (1,), (3,), (2,)], "v int").withColumn("k", F.lit(1))
    r = tasks.timing_summary(values, ["k"], "v").first()
    assert (r["p50"], r["p95"]) == (2, 4)
    store = tasks.KeyedStore(spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int"))
    store.put(spark.createDataFrame([("b", 5), ("c", 6)], "id string, v int"))
    assert {r["id"]: r["v"] for r in store.all().collect()} == {"a": 1, "b": 5, "c": 6}
    store.delete(spark.createDataFrame([("a",)], "id string"))
    assert store.one("b").first()["v"] == 5 and store.all().count() == 2
    store.clear()
    assert store.all().count() == 0


def test_task_stream_equals_the_fold(spark, tmp_path):
    rows = [(i, f"k{i % 3}", a, p) for i, (a, p) in enumerate([("enqueue", None)] * 3 + [("start", None)] * 3 + [("progress", 0.4)] * 3 + [("complete", None), ("fail", None), ("cancel", None)] + [("enqueue", None)] * 2)]
    schema = "event_id long, task_key string, action string, progress double"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = queue.task_states(stream).writeStream.outputMode("update").format("memory").queryName("task_states").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {r["task_key"]: (r["generation"], r["status"]) for r in spark.table("task_states").orderBy("event_id").collect()}
    want = {}
    for i, k, a, p in rows:
        want[k] = queue.step(want.get(k, (0, "", 0.0, -1)), a, p, i)
    assert got == {k: v[:2] for k, v in want.items()}


def test_sources(spark, tmp_path):
    docs = spark.createDataFrame([(1, "# Title\n\nintro\n## Part A\r\ntext a\n\n\n\nmore\n### Empty\n## B\nlast"), (2, ""), (3, None), (4, "no heading")], "doc_id long, text string")
    got = [(r["doc_id"], r["section_no"], r["title"], r["body"]) for r in documents.markdown_sections(docs).orderBy("doc_id", "section_no").collect()]
    assert got == [(1, 1, "Title", "intro"), (1, 2, "Part A", "text a\n\nmore"), (1, 3, "B", "last"), (4, 1, "Содержание", "no heading")]
    assert list(documents.flatten_json({"a": [1, {"b": "x"}], "c": None})) == [("$.a[0]", "1"), ("$.a[1].b", "x"), ("$.c", "null")]
    assert documents.packed(["a" * 30, "b" * 30, "c" * 30], 62) == ["a" * 30 + "\n\n" + "b" * 30, "c" * 30]
    assert [len(x) for x in documents.packed(["a" * 100], 40)] == [40, 40, 20] and documents.packed(["a" * 100], 40, "never") == ["a" * 100]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a-b.md").write_text("# Hi")
    (tmp_path / "in" / "bin.dat").write_bytes(b"\0\1\2")
    (tmp_path / "in" / ".hidden").write_text("x")
    rows = {r["title"]: r for r in documents.read_text_files(spark, str(tmp_path / "in")).collect()}
    assert rows["a b"]["text"] == "# Hi" and rows["bin"]["text"] is None and len(rows) == 2
    buf = BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p></w:body></w:document>')
    assert documents.docx_paragraphs(buf.getvalue()) == [("Heading1", "Head"), ("", "a\tb")]


def test_database_and_staging(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE articles (id INTEGER PRIMARY KEY, title TEXT, body TEXT, category TEXT, attachment BLOB)")
        con.executemany("INSERT INTO articles VALUES (?,?,?,?,?)", [(2, "Two", "b\nc", "x,y", b"abc"), (1, None, None, None, None)])
    assert database.sqlite_tables(path) == [("articles", "table")]
    df = database.read_sqlite(spark, path, "articles")
    m = database.Mapping("articles", ["id"], title_column="title", tag_columns=["category"])
    rows = {r["identity_json"]: r for r in database.row_sections(df, m).collect()}
    two = rows['{"id":"2"}']
    assert two["title"] == "Two" and "attachment: <BLOB 3 bytes sha256:" in two["body"] and "body:\nb\nc" in two["body"] and two["tags"] == "sqlite,table,articles,x,y"
    assert rows['{"id":"1"}']["title"] == "articles · 1" and "(null)" in rows['{"id":"1"}']["body"]
    with pytest.raises(ValueError):
        database.row_sections(df, database.Mapping("articles", ["nope"]))
    first, more = database.limited(df, ["id"], 1)
    assert more and first.count() == 1
    (tmp_path / "a.csv").write_text("id,title\n1,x\n2,y\n")
    (tmp_path / "b.json").write_text('{"k": 1}\n{"k": 2}\n')
    config = {"schemaVersion": 1, "sources": [{"type": "csv", "path": "a.csv", "table": "a"}, {"type": "json", "path": "b.json", "table": "b"}, {"type": "sqlite", "path": "x.db", "tables": [{"source": "articles", "target": "articles"}]}]}
    targets = staging.plan(config, str(tmp_path))
    meta = staging.stage(spark, targets, str(tmp_path / "out"), "2025-01-01T00:00:00Z")
    assert {r["target_table"] for r in meta.collect()} == {"a", "b", "articles"}
    assert spark.read.parquet(str(tmp_path / "out" / "a")).count() == 2
    assert staging.missing_targets(meta, spark.createDataFrame([("a",), ("zz",)], "target_table string")).count() == 1
    for bad in ({"type": "csv", "path": "a.csv", "table": "lnote_x"}, {"type": "csv", "path": "http://x/a", "table": "a"}, {"type": "csv", "path": "a", "table": "a", "options": {"sql": "x"}}, {"type": "odbc", "path": "a", "table": "a"}):
        with pytest.raises(staging.ConfigError):
            staging.plan({"schemaVersion": 1, "sources": [bad]})
    broken = staging.plan({"schemaVersion": 1, "sources": [{"type": "csv", "path": "a.csv", "table": "a"}, {"type": "csv", "path": "gone.csv", "table": "g"}]}, str(tmp_path))
    with pytest.raises(Exception):  # noqa: B017
        staging.stage(spark, broken, str(tmp_path / "out2"), "t")
    assert not (tmp_path / "out2").exists()


def test_export_and_restore_keep_every_field(spark, tmp_path):
    packs = [
        {"id": "p", "version": "1.0.0", "odd": {"a": [1, "1", None]}, "documents": [{"id": "d2", "x": 1, "sections": [{"id": "s1", "title": "x", "text": "T", "k": [True]}, {"id": "s0"}]}, {"id": "d1", "sections": []}, {}], "entities": [{"id": "e", "name": "E"}], "claims": []},
        {"id": "q", "documents": [], "claims": [{"id": "c", "text": "t", "source": {"quote": "«q» \\ \"z\""}}], "relations": [], "statementRelations": [{"id": "r"}]},
        {}, {"documents": [{"id": "only", "sections": [{"text": "a\nb"}]}]},
    ]
    df = spark.createDataFrame([(f"k{i}", json.dumps(p)) for i, p in enumerate(packs)], "pack_id string, json string")
    tables = interchange.export(df)
    back = {r["pack_id"]: json.loads(r["json"]) for r in interchange.restore(tables).collect()}
    assert back == {f"k{i}": p for i, p in enumerate(packs)}
    interchange.write(tables, str(tmp_path / "t"))
    again = interchange.read(spark, str(tmp_path / "t"))
    assert interchange.fingerprint(again["sections"]).first() == interchange.fingerprint(tables["sections"]).first()
    interchange.write_pack_json(again, str(tmp_path / "json"))
    text = "".join(open(f, encoding="utf-8").read() for f in sorted(map(str, (tmp_path / "json").glob("part-*"))))
    decoder, at, got = json.JSONDecoder(strict=False), 0, []
    text = text.replace("\n", "")
    while at < len(text):
        one, at = decoder.raw_decode(text, at)
        got.append(one)
    assert got == packs


def test_packs_as_lines_of_any_size(spark, tmp_path, monkeypatch):
    """Lines of packs become the tables that whole packs become, and the round trip of the query gathers no pack in a row."""
    whole = [
        {"id": "k0", "x": [1], "documents": [{"id": "d", "title": "T[", "sections": [{"id": "s", "text": ",a\n]}"}, {"id": "t", "n": {"b": 1, "a": 2}}]}, {"id": "e"}, {"id": "f", "sections": []}], "entities": [], "claims": [{"id": "c", "text": "{"}, "]", [1]]},
        {"documents": [], "relations": [{"id": "r"}]}, {},
    ]
    tables = interchange.export(spark.createDataFrame([(f"k{i}", json.dumps(p)) for i, p in enumerate(whole)], "pack_id string, json string"))
    lines = interchange.pack_lines(tables)
    again = interchange.export_lines(lines)
    assert set(again) == set(tables)
    for name, df in tables.items():
        assert again[name].columns == df.columns and sorted(map(str, again[name].collect())) == sorted(map(str, df.collect())), name
    own = {r["pack_id"]: r["digest"] for r in interchange.pack_digests(lines).collect()}
    assert len(set(own.values())) == 3
    for change in (lines.where("line not like '%\"t\"%'"), lines.withColumn("line", F.expr("if(part = 3 and place = 1, ltrim(',', line), line)")), lines.withColumn("inner", F.expr("if(part = 1 and place = 0 and inner in (0, 1), 1 - inner, inner)"))):
        changed = {r["pack_id"]: r["digest"] for r in interchange.pack_digests(change).collect()}
        assert {k for k in own if own[k] != changed[k]} <= {"k0"} and changed != own, change

    frame = lambda name, rows, schema, extra="": spark.createDataFrame(rows, schema).selectExpr("*", *extra.split("; ")).write.parquet(f"{tmp_path}/{name}.parquet")
    frame("catalog", [("p",), ("q",), ("r",)], "id string", "'1' version; 'T' title; 1L bytes")
    null, kept = "cast(null as string) {0}".format, "cast(null as timestamp) deleted_at"
    frame("lnote_documents", [(1, "p", "d1"), (2, "p", "d0"), (3, "q", "d1"), (4, "p", "d1"), (5, "gone", "d1")], "document_order long, pack_id string, document_id string", "; ".join(["document_id title", *map(null, ("summary", "authority", "effective_from", "source_json", "tags_json")), kept]))
    frame("lnote_sections", [(i, "p", f"d{i % 3}", f"s{i // 4}") for i in range(40)], "section_row long, pack_id string, document_id string, section_id string", "; ".join(["1 section_order", "section_id title", "repeat(',]}', 3) text", *map(null, ("entity_ids_json", "tags_json")), kept]))
    frame("lnote_entities", [(1, "p", "e"), (2, "gone", "e")], "entity_order long, pack_id string, entity_id string", "; ".join(map(null, ("name", "type", "aliases_json", "description"))))
    frame("lnote_claims", [(i, "p", f"c{i % 30}") for i in range(50)], "claim_order long, pack_id string, claim_id string", "; ".join([*map(null, ("text", "subject_id", "object_id", "source_document_id", "source_section_id", "source_quote")), kept]))

    def gathered(*_):
        raise AssertionError("a whole pack in a row")

    monkeypatch.setattr(interchange, "restore", gathered)
    monkeypatch.setattr(interchange, "export", gathered)
    got = {r["pack_id"]: tuple(r)[1:] for r in knowledge_queries.interchange_round(spark, str(tmp_path)).collect()}
    live = len({(f"d{i % 3}", f"s{i // 4}") for i in range(40) if i % 3 < 2})
    assert got == {"p": (True, 2, live, 1, 30), "q": (True, 1, 0, 0, 0), "r": (True, 0, 0, 0, 0)}
    text = [json.loads("".join(r["line"] for r in knowledge_queries._packs_lines(spark, str(tmp_path)).where(f"pack_id = '{k}'").orderBy("part", "place", "inner").collect())) for k in "pqr"]
    assert [d["id"] for d in text[0]["documents"]] == ["d0", "d1"] and [len(text[0][f]) for f in ("entities", "claims")] == [1, 30] and text[2] == {"id": "r", "version": "1", "title": "T", "bytes": 1}


def test_pack_of_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# Guide\n\nIntro text.\n\n## Part one\n\n" + "\n\n".join("word " * 300 for _ in range(9)) + "\n")
    (tmp_path / "sub" / "b.txt").write_text("Short title\n\nMagnetic resonance imaging (MRI) is used.")
    (tmp_path / "c.json").write_text('{"title": "Data", "n": [1, "x"]}')
    (tmp_path / "d.bin").write_bytes(b"\0\1")
    (tmp_path / ".hidden.md").write_text("# no")
    (tmp_path / "bad.json").write_text("{")
    pack = packs.build(spark, str(tmp_path))
    docs = {r["document_id"]: r["title"] for r in pack.documents.collect()}
    assert docs == {"doc.a-md": "Guide", "doc.sub-b-txt": "Short title", "doc.c-json": "Data"}
    sections = pack.sections.orderBy("document_id", "section_order").collect()
    own = [r for r in sections if r["document_id"] == "doc.a-md"]
    assert [r["title"] for r in own] == ["Содержание", "Part one · часть 1", "Part one · часть 2", "Part one · часть 3"]
    assert own[1]["section_id"] == "part-one-part-1-2" and all(len(r["text"]) <= 5000 for r in sections)
    assert [r["text"] for r in sections if r["document_id"] == "doc.c-json"] == ['$.title: "Data"\n$.n[0]: 1\n$.n[1]: "x"']
    assert [(r["name"], r["aliases"]) for r in pack.entities.collect()] == [("Magnetic resonance imaging", ["MRI"])]
    whole = json.loads(interchange.restore(packs.as_json(pack, "kb.test")).first()["json"])
    assert whole["id"] == "kb.test" and [len(d["sections"]) for d in whole["documents"]] == [4, 1, 1] and whole["schemaVersion"] == 1
    with pytest.raises(ValueError):
        packs.build(spark, _empty(tmp_path))


def _empty(tmp_path):
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.bin").write_bytes(b"\0")
    return str(tmp_path / "empty")


def test_sections_of_documents_and_pages(spark):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    para = lambda t, style=None: f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    buf = BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{para('The title', 'Title')}{para('Dose', 'Heading1')}{para('one &amp; two')}{para('')}{para('x' * 4000)}{para('y' * 3000)}{para('Next', 'Heading2')}{para('last')}</w:body></w:document>")
    rows = documents.docx_sections(spark.createDataFrame([("/a/f.docx", bytearray(buf.getvalue())), ("/a/broken.docx", bytearray(b"zz"))], "path string, content binary")).collect()
    got = [(r["section_id"], r["title"], r["paragraph_start"], r["paragraph_end"], r["document_title"]) for r in rows]
    assert got == [("dose", "Dose", 3, 5, "The title"), ("dose-part-2", "Dose · часть 2", 6, 6, "The title"), ("next", "Next", 8, 8, "The title")]
    pages = spark.createDataFrame([("d", 1, "short"), ("d", 2, "z" * 6000 + "\n\nend"), ("d", 3, " "), ("d", 4, None)], "document_id string, page int, text string")
    out = documents.page_sections(pages).orderBy("page", "section_id").collect()
    assert [(r["section_id"], len(r["body"])) for r in out] == [("page-1", 5), ("page-2", 5000), ("page-2-part-2", 1000), ("page-2-part-3", 3)]


def test_whole_tables_are_staged_and_rows_without_key_are_told_apart(spark, tmp_path):
    path = str(tmp_path / "big.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE big (a TEXT, b INTEGER)")
        con.executemany("INSERT INTO big VALUES (?, ?)", ((f"v{i % 7}", i % 3) for i in range(60_001)))
        con.execute("DELETE FROM big WHERE rowid % 1000 = 5")
        con.execute("CREATE VIEW small AS SELECT a FROM big WHERE b = 1 LIMIT 10")
        con.execute("CREATE TABLE keyed (id INTEGER PRIMARY KEY, t TEXT)")
        con.executemany("INSERT INTO keyed VALUES (?, ?)", ((i, "x") for i in (10, 2, 1)))
    kept = 60_001 - 60
    assert database.read_sqlite(spark, path, "big", 5_000).count() == kept and database.read_sqlite(spark, path, "small").count() == 10
    config = {"schemaVersion": 1, "sources": [{"type": "sqlite", "path": "big.db", "tables": [{"source": "big", "target": "big"}]}]}
    staging.stage(spark, staging.plan(config, str(tmp_path)), str(tmp_path / "staged"), "t")
    assert spark.read.parquet(str(tmp_path / "staged" / "big")).count() == kept
    part = database.read_sqlite(spark, path, "big").limit(50)
    ids = [r["section_id"] for r in database.row_sections(part, database.Mapping("big", [])).collect()]
    assert len(set(ids)) == 50
    double = spark.createDataFrame([("1", "x"), ("1", "x"), ("2", "y"), (None, "z"), (None, "z")], "id string, t string")
    out = database.row_sections(double, database.Mapping("t", ["id"])).collect()
    assert len({r["section_id"] for r in out}) == 5 and sum("row" in r["identity_json"] for r in out) == 2
    first, said = database.import_sqlite(spark, path, database.Mapping("keyed", []), 2)
    assert sorted(r["title"] for r in first.collect()) == ["keyed · 1", "keyed · 2"] and len(said) == 1
    docs, sections, said = database.import_directory(spark, path, [database.Mapping("keyed", []), database.Mapping("small", [], kind="view")])
    assert {r["title"] for r in docs.collect()} == {"keyed", "small"} and sections.count() == 13 and not said


def test_staging_options(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "1.csv").write_text("id,title\n1,x\n")
    (tmp_path / "c" / "2.csv").write_text("title,note,id\ny,n,2\n")
    got = staging.read_file(spark, "csv", str(tmp_path / "c"), {"union_by_name": True, "all_varchar": True})
    assert sorted((r["id"], r["title"], r["note"]) for r in got.collect()) == [("1", "x", None), ("2", "y", "n")]
    (tmp_path / "h" / "p=1").mkdir(parents=True)
    spark.range(3).write.parquet(str(tmp_path / "h" / "p=1" / "f.parquet"))
    assert "p" not in staging.read_file(spark, "parquet", str(tmp_path / "h"), {"hive_partitioning": False}).columns
    with pytest.raises(staging.ConfigError):
        staging.read_file(spark, "json", str(tmp_path), {"maximum_object_size": 5})


def test_chronology_of_statements(spark):
    claim = "claim_ref string, text string, quote string, subject string, object string, side " + chronology.SIDE
    side = lambda **k: tuple(k.get(f) for f in "ref doc pub vf vu series ident alg pred rel".split())
    rows = [
        ("p::a", "Dose is 5 mg", "", "Amox", "", side(ref="p::1", doc="1", pub="2025", series="s", ident="2.0.0", alg="semver", pred="2", rel="Replaces")),
        ("p::b", "Dose is 9 mg", "", "Amox", "", side(ref="p::2", doc="2", pub="2024-05", series="s", ident="2.0.0-rc.1", alg="semver")),
        ("p::c", "Dose is 7 mg", "", "Amox", "", side(ref="p::3", doc="3", vf="2020", vu="2021-06")),
        ("p::d", "Dose is 8 mg", "", "Amox", "", side(ref="p::4", doc="4", vf="2022-01", vu="2023", pred="3", rel="amends")),
        ("p::e", "Dose is 6 mg", "", "Amox", "", None),
    ]
    res = compare.resources(spark.createDataFrame(rows, claim))
    got = {(r["left_ref"], r["right_ref"]): r for r in compare.detect(res, res.limit(0)).collect()}
    ab, cd, ae = got["p::a", "p::b"], got["p::c", "p::d"], got["p::a", "p::e"]
    assert ab["suggested_type"] == "supersedes" and ab["signals"] == "numeric_difference,same_edition_series,later_issue_date,later_edition,explicit_replacement"
    assert cd["suggested_type"] == "different_scope" and "validity_intervals_do_not_overlap,explicit_amendment" in cd["signals"]
    assert ae["suggested_type"] == "contradicts" and ae["signals"] == "numeric_difference"


def test_evidence_of_a_question(spark):
    body = "id string, title string, document_title string, body string"
    recs = spark.createDataFrame([(f"section:p:d:{i}", f"T{i}", "D", f"Body {i}. More text here.") for i in range(6)], body)
    results = spark.createDataFrame([(1, r, f"section:p:d:{i}", k) for r, (i, k) in enumerate([(0, "section"), (9, "note"), (1, "section"), (2, "section"), (3, "section"), (4, "section")], 1)], "answer_id long, rank int, id string, kind string")
    said = spark.createDataFrame([("p::c1", "section:p:d:0", "Claim one.", "more text here"), ("p::c2", "section:p:d:4", "Other.", None)], "claim_ref string, section_ref string, text string, quote string")
    conflicts = spark.createDataFrame([("section:p:d:1", "section:p:d:5"), ("section:p:d:5", "section:p:d:1")], "section_ref string, counterpart string")
    raw = [("n1", "about it", "b", "contradicts", None, None, "c1", None, "t", None), ("n2", "Dosing of amox", "x", "observation", None, None, None, None, "t", None), ("n3", "else", "y", "supersedes", None, None, None, None, "t", None)]
    own = notes.normalized_notes(spark.createDataFrame(raw, notes.NOTE))
    got = evidence.collected(evidence.base_sources(results), recs, said, own, conflicts, "dosing", "compact")
    sources = got["sources"].orderBy("source_no").collect()
    assert [(r["source_id"], r["section_ref"][-1], r["supplemental"], r["claims"]) for r in sources] == [("S1", "0", False, 1), ("S2", "1", False, 0), ("S3", "5", True, 0), ("S4", "2", False, 0), ("S5", "3", False, 0)]
    assert {r["id"] for r in got["notes"].collect()} == {"n1", "n2"} and {r["id"] for r in got["conflicts"].collect()} == {"n1"}
    first = {r["fragment"] for r in evidence.fragments(got["sources"], got["claims"]).where("source_id = 'S1'").collect()}
    assert first == {"T0", "Body 0.", "More text here.", "more text here", "D", "Claim one."}


def test_views_and_reviews(spark):
    spans = spark.createDataFrame([(1, "Amox and amoxicillin, AMOX.", [("Amox", "e1"), ("amoxicillin", "e2"), ("amox", "e3")]), (2, "none", []), (3, None, [("x", "e")])], "id long, text string, terms array<struct<term:string, entity_id:string>>")
    got = [tuple(r) for r in views.entity_spans(spans).orderBy("start").collect()]
    assert got == [(1, 0, 4, "e1"), (1, 9, 20, "e2"), (1, 22, 26, "e1")]
    pages = views.inspector_pages(spark.createDataFrame([("d", "first\n<!-- Page 2 -->\nsecond\n<!-- page 3 -->\n\n<!-- Page 2 -->more"), ("e", None)], "document_id string, markdown string"))
    assert sorted(map(tuple, pages.collect())) == [("d", 1, "first"), ("d", 2, "second\n\nmore")]
    names = {r["path"]: r["name"] for r in views.asset_names(spark.createDataFrame([("a/Übersicht 1.PDF",), ("b/Übersicht 1.pdf",), ("c",)], "path string")).collect()}
    assert names["a/Übersicht 1.PDF"].endswith("bersicht-1.pdf") and len(set(names.values())) == 3 and names["c"] == "c"
    shown = views.with_assets(spark.createDataFrame([("s", "![x](asset:1) [y](asset:2)"), ("t", "z")], "section_ref string, text string"), spark.createDataFrame([("s", "1", "/u/1.png")], "section_ref string, asset_id string, url string"))
    assert {r["section_ref"]: r["text"] for r in shown.collect()} == {"s": "![x](/u/1.png) [y](asset:2)", "t": "z"}
    line = spark.createDataFrame([("c", i, float(i)) for i in range(32)], "clip_id string, at long, value double")
    half = views.resampled_audio(line, 32_000).orderBy("at").collect()
    assert len(half) == 16 and [r["value"] for r in half[:3]] == [0.0, 2.0, 4.0]
    assert views.resampled_audio(line, 0).count() == 0 and len(views.resampled_audio(line, 8_000).collect()) == 64
    assert views.mixed_audio(spark.createDataFrame([("c", 0, 0, 1.0), ("c", 1, 0, 0.0)], "clip_id string, channel int, at int, value double")).first()["value"] == 0.5

    item = lambda **k: ("d", "s", *[k.get(f) for f in "kind name type aliases text quote subject object source target".split()])
    items = spark.createDataFrame([
        item(kind="entity", name="Amox", type="drug", aliases=["AMX"]), item(kind="entity", name=" known ", aliases=["K"]), item(kind="claim", text="Amox helps", quote="Amox helps", subject="amox", object="Fever"),
        item(kind="claim", text="No quote", quote="not there", subject="Ghost"), item(kind="relation", type="Treats With", source="Amox", target="Fever"), item(kind="relation", type=None, source="Amox", target="Fever"),
    ], "document_id string, section_id string, " + reviews.ITEM)
    sections = spark.createDataFrame([("d", "s", "We saw that Amox helps.")], "document_id string, section_id string, text string")
    entities = spark.createDataFrame([("e.known", "Known", "term", ["kn"]), ("entity.fever", "Other", "term", [])], "entity_id string, name string, type string, aliases array<string>")
    none = spark.createDataFrame([], "claim_id string"), spark.createDataFrame([], "relation_id string")
    out = reviews.merged(items, sections, entities, *none)
    made = {r["name"]: r for r in out["entities"].collect()}
    assert made["Amox"]["entity_id"] == "entity.amox" and made["Amox"]["type"] == "drug" and made["known"]["entity_id"] == "e.known" and not made["known"]["created"]
    fever = made["Fever"]["entity_id"]
    assert fever.startswith("entity-fever.") and fever != "entity.fever" and "Ghost" not in made
    claim, relation = out["claims"].collect(), out["relations"].collect()
    assert [(r["subject_id"], r["object_id"], r["authority"]) for r in claim] == [("entity.amox", fever, "reviewed")]
    assert [(r["source_id"], r["target_id"], r["predicate"]) for r in relation] == [("entity.amox", fever, "treats_with")]
    assert {r["entity_id"] for r in out["links"].collect()} == {"entity.amox", "e.known", fever}
    again = reviews.merged(items, sections, entities, out["claims"].select("claim_id"), out["relations"].select("relation_id"))
    assert again["claims"].count() == again["relations"].count() == 0
    bad = spark.createDataFrame([("c1", "accept", False), ("c2", "pending", True)], "id string, decision string, eligible boolean")
    with pytest.raises(Exception, match="cannot be accepted"):
        reviews.accepted(bad).collect()


def test_keyed_store_removes_what_it_replaces(spark):
    store = tasks.KeyedStore(spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int"))
    old = store.rows.__dict__["_written_at"]
    store.put(spark.createDataFrame([("b", 3), ("c", 1), ("c", 4)], "id string, v int"))
    assert sorted(map(tuple, store.all().collect())) == [("a", 1), ("b", 3), ("c", 4)] and not rt.path_exists(spark, old)
    store.delete(spark.createDataFrame([("a",), ("a",)], "id string"))
    assert sorted(r["id"] for r in store.all().collect()) == ["b", "c"] and store.one("c").first()["v"] == 4
    store.clear()
    assert store.all().count() == 0


def test_relation_rules(spark):
    rows = [(1, "p", "r1", "a", "b", "supports", "confirmed", "0.5"), (2, "p", "r1", "a", "p::a", "odd", "strange", "2"), (3, "p", None, "", None, "refines", None, None), (4, "p", "r4", "zz", "q::a", "refines", None, "x")]
    rel = spark.createDataFrame(rows, "relation_order long, pack_id string, relation_id string, source_claim_id string, target_claim_id string, type string, status string, confidence string")
    got = {(r["relation_order"], r["rule"]) for r in model.relation_violations(rel, spark.createDataFrame([("p", "a"), ("p", "b")], "pack_id string, claim_id string")).collect()}
    assert got == {(2, "same_statement"), (2, "type_unsupported"), (2, "status_unsupported"), (2, "confidence_out_of_range"), (2, "id_repeated"), (3, "id_missing"), (3, "source_missing"), (3, "target_missing"), (4, "confidence_out_of_range"), (4, "statement_unknown")}
