import random

import pytest

from quillon.llm import split

SEC = "section_row long, pack_id string, document_id string, section_id string, title string, text string, extra string"


def rebuilt(text, pieces):
    out, done = "", 0
    for a, b, _ in pieces:
        assert a <= done <= b or not out
        out += text[max(a, done) : b]
        done = b
    return out


def samples():
    r = random.Random(3)
    words = ["dose", "Tropfen", "проба", "мочи", "x" * 30, "é́", "👨‍👩‍👧"]
    yield " ".join(r.choice(words) for _ in range(4000))
    yield ". ".join(" ".join(r.choice(words) for _ in range(9)) for _ in range(500))
    yield "\r\n\r\n".join(" ".join(r.choice(words) for _ in range(60)) + "." for _ in range(80))
    yield "a" * 23_456
    yield "👨‍👩‍👧" * 4000
    yield "e" + "́" * 12_000
    yield "word, " * 5000
    yield "b" * 5001


@pytest.mark.parametrize("text", list(samples()))
def test_pieces_cover_the_text_within_the_limits(text):
    pieces = split.cut(text)
    assert len(pieces) >= -(-len(text) // split.LIMIT)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for a, b, _ in pieces:
        assert 0 < b - a <= split.LIMIT
    for (_, b, kind), (c, _, _) in zip(pieces, pieces[1:], strict=False):
        assert 0 <= b - c <= split.OVERLAP
        assert not (text[b - 1] == "\r" and text[b] == "\n")
        if kind == "paragraph":
            assert text[:b].rstrip(" \t").endswith("\n")
    assert rebuilt(text, pieces) == text


def test_short_texts_stay_whole():
    assert split.cut("") == [(0, 0, "end")]
    assert split.cut("a" * 5000) == [(0, 5000, "end")]


def test_balanced_and_at_paragraphs():
    text = "\n\n".join("Satz. " * 40 for _ in range(60))
    pieces = split.cut(text)
    sizes = [b - a for a, b, _ in pieces]
    assert max(sizes) < 1.5 * min(sizes)
    assert {k for _, _, k in pieces[:-1]} == {"paragraph"}


def test_piece_ids_are_unique_and_rows_are_whole(spark, save):
    long = "Ein Satz. " * 900
    rows = [
        (1, "p", "d", "s", "t", long, "x"), (2, "p", "d", "s", "t", long, "x"), (3, "p", "d", "s-part-1", "t", "short", "x"),
        (4, "p", "d", "u", None, None, None), (5, "p", "d", "v", "t", "", None), (6, "q", "d", "s", "t", long + "z", "x"),
    ]
    where = save("lnote_sections", rows, SEC)
    assert sorted(r[0] for r in split.found(spark, where).collect()) == [1, 2, 6]
    out = split.pieces(spark, where).collect()
    ids = [(r["pack_id"], r["document_id"], r["piece_section_id"]) for r in out] + [("p", "d", x) for x in ("s", "s-part-1", "u", "v")]
    assert len(ids) == len(set(ids))
    text = {r[0]: r[5] for r in rows}
    for row in (1, 2, 6):
        own = sorted((r["start"], r["stop"], r["piece_text"]) for r in out if r["section_row"] == row)
        assert all(text[row][a:b] == t for a, b, t in own)
        assert own[-1][1] == len(text[row])


def test_ids_of_nulls_and_lookalike_ids(spark, save):
    long = "Ein Satz. " * 900
    rows = [
        (5, "p", "d", "s", "t", long, "x"), (6, "p", "d", "s", "t", long, "x"), (7, "p", "d", "s-row6", "t", long, "x"), (8, "p", "d", "s-row6-2-part-9", "t", "x", "x"),
        (9, None, "d", "s", "t", long, "x"), (10, None, None, None, "t", long, "x"), (11, None, None, None, "t", long, "x"), (12, "p", "d", "s-row7", "t", long, "x"),
    ]
    out = split.pieces(spark, save("lnote_sections", rows, SEC)).collect()
    ids = [(r["pack_id"], r["document_id"], r["piece_section_id"]) for r in out]
    assert len(ids) == len(set(ids)) and all(i[2] for i in ids)
    assert {r["section_row"] for r in out} == {5, 6, 7, 9, 10, 11, 12}
    assert ("p", "d", "s-row6-2-part-1") not in ids and ("p", "d", "s-part-1") in ids


def test_empty_table(spark, save):
    where = save("lnote_sections", [], SEC)
    assert split.found(spark, where).count() == 0
    assert split.pieces(spark, where).count() == 0
