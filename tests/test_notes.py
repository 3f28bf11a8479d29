import json

from pyspark.sql import functions as F

from quillon.operators import notes, search


def test_notes(spark):
    rows = [
        {"id": "1", "title": " T ", "body": "b", "relation": "odd", "targetDocumentId": "p::d", "targetSectionId": "s", "relatedEntityIds": ["e", "e", ""], "createdAt": "x"},
        {"id": "2", "title": "", "body": "b"}, {"id": "3", "title": "x" * 200, "body": "y", "relation": "refines", "targetSectionId": "s", "targetClaimId": "c"},
    ]
    df = notes.imported_notes(spark.createDataFrame([(json.dumps(rows),), ("no json",), (None,)], "json string"))
    got = {r["id"]: r for r in df.collect()}
    assert set(got) == {"1", "3"} and got["1"]["title"] == "T" and got["1"]["relation"] == "observation" and got["1"]["entity_ids"] == ["e"]
    assert got["3"]["section_id"] is None and len(got["3"]["title"]) == 160
    rec = {r["id"]: r for r in notes.note_records(df, spark.createDataFrame([("d", "Doc")], "document_id string, title string")).collect()}
    assert rec["note:1"]["document_title"] == "Doc" and rec["note:1"]["tags"] == "personal observation source-annotation"
    assert {(r["level"], r["target"]): r["notes"] for r in notes.targets(df).collect()} == {("document", "p::d"): 1, ("section", "p::d/s"): 1, ("claim", "c"): 1}


def test_labels_and_strength(spark):
    df = spark.createDataFrame([("treated-with", 0.5), ("some_thing", 80.0), (None, None)], "p string, w double")
    got = [(r["l"], r["s"] and tuple(r["s"])) for r in df.select(notes.predicate_label(F.col("p")).alias("l"), notes.relation_strength(F.col("w")).alias("s")).collect()]
    assert got == [("лечится с помощью", (50, "средняя")), ("some thing", (80, "сильная")), ("связано с", None)]


def test_proposals(spark):
    answer = 'Here:\n```json\n{"entities": [{"name": "A"}], "claims": [{"text": "t", "quote": "exact"}, {"text": "t", "quote": "other"}]}\n```'
    df = notes.proposal_candidates(spark.createDataFrame([("s1", "an exact text", answer), ("s2", "x", "none"), ("s3", None, None)], "section_ref string, text string, proposal string"))
    assert sorted((r["kind"], r["eligible"]) for r in df.collect()) == [("claim", False), ("claim", True), ("entity", True)]
    assert len({r["id"] for r in df.collect()}) == 3


def test_planners_routes_abbreviations(spark):
    plan = notes.rule_planner([(["wheezing infant"], ["bronchiolitis"])])
    assert notes.expand("an infant that is wheezing", [plan, lambda q: ["bronchiolitis", " "]]) == ["bronchiolitis"] and notes.expand("other", [plan]) == []
    r = spark.createDataFrame([("#/document/p%3A%3Ad?section=s1",)], "h string").select(notes.route(F.col("h")).alias("r")).first()["r"]
    assert tuple(r) == ("document", "p::d", "s1")
    found = notes.abbreviations(spark.createDataFrame([(1, "острый респираторный синдром (ОРС) и др."), (2, None)], "id int, text string"), "id").collect()
    assert [(x["alias"], x["canonical"]) for x in found] == [("ОРС", "острый респираторный синдром")]


def test_benchmark_records_are_searchable(spark):
    rec = notes.benchmark_records(spark, 400)
    postings = search.token_scores(rec)
    assert search.search_postings(rec, postings, "marker0000200", 10, fuzzy=False).count() == 1
    assert rec.select(F.max(F.length("body"))).first()[0] == 640
    packs = spark.createDataFrame([("p", "2", 10, None)], "id string, version string, size_bytes long, sha256 string")
    old = spark.createDataFrame([("p", False, "web", "h")], "id string, enabled boolean, source string, sha256 string")
    assert tuple(notes.install_records(packs, old).first()) == ("p", "2", 10, False, "web", "h")
