from datetime import datetime, timezone

import pytest

from quillon.operators import instants


def utc(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp())


BERLIN = ("Europe/Berlin", "de-DE")
CASES = [
    ("2024-03-05T10:20:30Z", BERLIN, "second", [(utc(2024, 3, 5, 10, 20, 30), 0, utc(2024, 3, 5, 10, 20, 31), 0)]),
    ("2024-03-05T10:20+01:00", BERLIN, "minute", [(utc(2024, 3, 5, 9, 20), 0, utc(2024, 3, 5, 9, 21), 0)]),
    ("2024-03-05 10:20:30,5+0100", BERLIN, "fraction", [(utc(2024, 3, 5, 9, 20, 30), 500000000, utc(2024, 3, 5, 9, 20, 30), 600000000)]),
    ("2024-03-05 10:20:30.999999999-05", BERLIN, "fraction", [(utc(2024, 3, 5, 15, 20, 30), 999999999, utc(2024, 3, 5, 15, 20, 31), 0)]),
    ("2024-03-05", BERLIN, "day", [(utc(2024, 3, 4, 23), 0, utc(2024, 3, 5, 23), 0)]),
    ("2024-03", BERLIN, "month", [(utc(2024, 2, 29, 23), 0, utc(2024, 3, 31, 22), 0)]),
    ("2024", BERLIN, "year", [(utc(2023, 12, 31, 23), 0, utc(2024, 12, 31, 23), 0)]),
    ("2024-W10-2", BERLIN, "day", [(utc(2024, 3, 4, 23), 0, utc(2024, 3, 5, 23), 0)]),
    ("2024-065", BERLIN, "day", [(utc(2024, 3, 4, 23), 0, utc(2024, 3, 5, 23), 0)]),
    ("20240305T102030Z", BERLIN, "second", [(utc(2024, 3, 5, 10, 20, 30), 0, utc(2024, 3, 5, 10, 20, 31), 0)]),
    ("1709634030", BERLIN, "second", [(1709634030, 0, 1709634031, 0)]),
    ("1709634030123", BERLIN, "fraction", [(1709634030, 123000000, 1709634030, 124000000)]),
    ("1709634030123456", BERLIN, "fraction", [(1709634030, 123456000, 1709634030, 123457000)]),
    ("05.03.2024, 11:20", BERLIN, "minute", [(utc(2024, 3, 5, 10, 20), 0, utc(2024, 3, 5, 10, 21), 0)]),
    ("05.03.24", BERLIN, "day", [(utc(2024, 3, 4, 23), 0, utc(2024, 3, 5, 23), 0)]),
    ("03/05/2024 8:20 PM", ("America/New_York", "en-US"), "minute", [(utc(2024, 3, 6, 1, 20), 0, utc(2024, 3, 6, 1, 21), 0)]),
    ("03/05/2024", ("Europe/London", "en-GB"), "day", [(utc(2024, 5, 2, 23), 0, utc(2024, 5, 3, 23), 0)]),
    ("Tue, 05 Mar 2024 10:20:30 +0100", BERLIN, "second", [(utc(2024, 3, 5, 9, 20, 30), 0, utc(2024, 3, 5, 9, 20, 31), 0)]),
    ("5 марта 2024 г.", ("Europe/Moscow", "ru-RU"), "day", [(utc(2024, 3, 4, 21), 0, utc(2024, 3, 5, 21), 0)]),
    ("5 de marzo de 2024", ("Europe/Madrid", "es-ES"), "day", [(utc(2024, 3, 4, 23), 0, utc(2024, 3, 5, 23), 0)]),
    ("Mar 5, 2024 8:20 PM EST", BERLIN, "minute", [(utc(2024, 3, 6, 1, 20), 0, utc(2024, 3, 6, 1, 21), 0)]),
    ("2024-03-05 10:20:30 Asia/Kolkata", BERLIN, "second", [(utc(2024, 3, 5, 4, 50, 30), 0, utc(2024, 3, 5, 4, 50, 31), 0)]),
    ("2024-03-05T10:20:30+01:00[Europe/Berlin]", BERLIN, "second", [(utc(2024, 3, 5, 9, 20, 30), 0, utc(2024, 3, 5, 9, 20, 31), 0)]),
    ("2024-10-27 02:30:00", BERLIN, "second", [(utc(2024, 10, 27, 0, 30), 0, utc(2024, 10, 27, 0, 30, 1), 0), (utc(2024, 10, 27, 1, 30), 0, utc(2024, 10, 27, 1, 30, 1), 0)]),
]


@pytest.mark.parametrize("raw,zone,unit,want", CASES)
def test_notations(raw, zone, unit, want):
    got = instants.parse(raw, *zone)
    assert got is not None
    assert got[0] == unit
    assert [(a[0], a[1], b[0], b[1]) for a, b in got[1]] == want


@pytest.mark.parametrize("raw", ["", "  ", "n.d.", "—", "TBD", "0000-00-00", "2023-02-30", "2021-06-15T25:10:00Z", "31.04.2022", "2024-03-31 02:30:00", "2024-13", "0000000000", "12:30"])
def test_unreadable(raw):
    assert instants.parse(raw, *BERLIN) is None


def test_no_zone_known():
    assert instants.parse("2024-03-05 10:00", None, "de-DE") is None
    assert instants.parse("2024-03-05 10:00Z", None, "de-DE") is not None


DOC = "document_order long, pack_id string, effective_from string, source_json string, zone string"
PACK = "id string, time_zone string, locale string"


def test_found_and_dictionary(spark, save):
    rows = [
        (1, "p", "2024-03-05", '{"date": 1709634030, "publishedAt": "2024-03-06"}', "x"),
        (2, "p", "2024-10-27 02:30:00", '{"date": "2024-10-27T01:30:00Z", "publishedAt": null}', "x"),
        (3, "p", None, None, "x"),
        (4, "p", "n.d.", '{"date": "2024"}', "x"),
        (5, "gone", "2024-03-05", '{"date": "2020-01-01"}', "x"),
        (6, "p", "2024", "not json", None),
    ]
    save("lnote_documents", rows, DOC)
    where = save("catalog", [("p", "Europe/Berlin", "de-DE")], PACK)
    assert {tuple(r) for r in instants.found(spark, where).collect()} == {(1, "date", "publishedAt"), (1, "effective_from", "publishedAt")}
    out = instants.normalised(spark, where).collect()
    assert len(out) == 10
    assert sum(r["readable"] for r in out) == 7
    d = instants.InstantDictionary(spark)
    values = instants.document_values(spark, where)
    d.update(values.where("document_order = 1"))
    d.update(values)
    distinct = values.select("raw", "zone", "locale").distinct().count()
    assert d.read().count() == distinct
    again = instants.InstantDictionary(spark, d.path)  # opened anew, as by a later session
    parts = again._parts()
    assert instants.resolve(values, again).count() == values.count()
    assert again._parts() == parts and again.read().count() == distinct


def test_empty(spark, save):
    save("lnote_documents", [], DOC)
    where = save("catalog", [], PACK)
    assert instants.found(spark, where).count() == 0
    assert instants.normalised(spark, where).count() == 0
