import itertools
import random

from quillon import runtime as rt
from quillon.llm import neardup

SEC = "section_row long, title string, text string, rep long, words int, id string"


def shingles(title, text):
    w = neardup._words(title, text)
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def corpus():
    r = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(40):
        text = [r.choice(words) for _ in range(r.choice([3, 8, 40, 150]))]
        for _ in range(4):
            t = list(text)
            for _ in range(r.choice([0, 1, 2, 6, 20])):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append((len(rows), f"T{base}", " ".join(t), 1, 2, "x"))
    hot = "one two three four five six seven"
    rows += [(1000 + i, "Hot", hot if i % 2 else hot.upper(), 1, 2, "x") for i in range(60)]
    rows += [(2000, None, None, None, None, None), (2001, "a", "", 0, 0, ""), (2002, "", "a b", 0, 0, ""), (2003, "", "a b", 0, 0, ""), (2004, None, "Ünï cödé tèxt", 0, 0, ""), (2005, "ünï", "CÖDÉ — tèxt!", 0, 0, "")]
    return rows


def brute(rows):
    sets = {r[0]: shingles(r[1], r[2]) for r in rows}
    out = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if both and 5 * both >= 3 * either:
            out.add((a, b))
    return out


def components(pairs):
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    return {x: find(x) for x in label}


def test_found_and_groups_equal_brute_force(spark, save):
    rows = corpus()
    where = save("lnote_sections", rows, SEC)
    want = brute(rows)
    got = [tuple(r) for r in neardup.found(spark, where).collect()]
    assert len(got) == len(set(got))
    assert not set(got) - want
    assert len(want - set(got)) <= 0.01 * len(want)
    groups = {r["section_row"]: r["group_row"] for r in neardup.grouped(spark, where).collect()}
    assert len(groups) == len(rows)
    for row, label in components(got).items():
        assert groups[row] == label


def test_boilerplate_with_small_blocks_and_the_exact_mode(spark, save, monkeypatch):
    """A band that many texts share is joined on whole table keys and in blocks; the exact mode loses nothing."""
    monkeypatch.setattr(rt.pairs_within, "__defaults__", (6,))
    monkeypatch.setattr(rt, "PAIR_BLOCK", 6)
    r = random.Random(5)
    boiler = [f"b{i}" for i in range(60)]
    rows = [(i, "Notice", " ".join(boiler + [f"x{r.randrange(10**6)}" for _ in range(r.choice([2, 12, 30, 34, 38]))]), 1, 2, "x") for i in range(80)]
    rows += [(100 + i, "Copy", " ".join(boiler), 1, 2, "x") for i in range(15)]
    want = brute(rows)
    got = {tuple(p) for p in neardup.found(spark, save("lnote_sections", rows, SEC)).collect()}
    assert not got - want and len(want - got) <= 0.03 * len(want) and len(want) > 1000
    exact = neardup.NearDuplicates(spark.createDataFrame(rows, SEC).select("section_row", "title", "text"), exact=True)
    assert {tuple(p) for p in exact.row_pairs().collect()} == want


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    out = neardup.components(chain).collect()
    assert {r["label"] for r in out} == {0} and len(out) == 301


def test_empty(spark, save):
    where = save("lnote_sections", [], SEC)
    assert neardup.found(spark, where).count() == 0
    assert neardup.grouped(spark, where).count() == 0


def test_expected_recall_at_the_threshold():
    """Share of pairs at a similarity that bands, lanes and screen let through, by drawing which minhashes agree."""
    import numpy as np

    def recall(similarity):
        agree = np.random.default_rng(1).random((200_000, neardup.HASHES)) < similarity
        cut = neardup.FIRST * neardup.FIRST_ROWS
        band = agree[:, :cut].reshape(-1, neardup.FIRST, neardup.FIRST_ROWS).all(2).any(1)
        lanes = agree[:, cut:].reshape(-1, neardup.SECOND, neardup.SECOND_ROWS).all(2).sum(1)
        return (band & (lanes > 0) & (agree.sum(1) >= neardup.SCREEN)).mean()

    print([round(float(recall(s)), 3) for s in (0.6, 0.62, 0.65, 0.7)])
    assert recall(0.6) > 0.965 and recall(0.65) > 0.99
