import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import mixing, packing, tokens

DOC = "doc_id long, source string, text string, tokens string, container_id string"


@pytest.mark.parametrize("seed", range(4))
def test_pack_fits_and_is_tight(seed):
    r = np.random.default_rng(seed)
    capacity = [512, 2048, 100, 512][seed]
    sizes = np.minimum(r.lognormal(5, 1, 4000).astype(int), capacity)
    place = packing.pack(sizes, capacity)
    used = np.bincount(place, weights=sizes)
    assert (place >= 0).all() and used.max() <= capacity
    least = -(-sizes.sum() // capacity)
    assert len(used) <= 1.06 * least + 2


@pytest.mark.parametrize("seed", range(4))
def test_never_more_containers_than_best_fit(seed):
    r = np.random.default_rng(seed)
    capacity = [512, 2048, 4096, 700][seed]
    sizes = r.integers(1, capacity, 2000) if seed % 2 else np.minimum(r.lognormal(5.5, 1, 3000).astype(int) + 1, capacity - 1)
    order = np.argsort(-sizes, kind="stable")
    plain = packing.best_fit(order.tolist(), sizes, capacity, np.full(len(sizes), -1), [])
    scheme = np.full(len(sizes), -1)
    count = packing.grouped_fit(order, sizes, capacity, packing.GROUPS, scheme)
    assert np.bincount(scheme, weights=sizes).max() <= capacity and len(np.unique(scheme)) == count
    assert len(np.unique(packing.pack(sizes, capacity))) == min(plain, count)
    assert count <= 1.02 * plain + 1


def test_configurations_solve_the_program():
    """Three sizes whose best configurations are known: 6+4 and 5+5, none emptier."""
    got = packing.configurations(np.array([6, 5, 4]), np.array([30, 40, 30]), 10)
    assert sum(n for _, n in got) == 50 and sum(n * plan for plan, n in got).tolist() == [30, 40, 30]


def test_pack_edges():
    assert list(packing.pack(np.array([], int), 10)) == []
    assert list(packing.pack(np.array([0, 0]), 10)) == [0, 0]
    assert len(set(packing.pack(np.array([10, 10, 10]), 10))) == 3
    assert len(set(packing.pack(np.array([6, 6, 4, 4]), 10))) == 2


def tables(save, docs):
    save("containers", [("s", 16), ("l", 200), ("bad", None)], "container_type string, capacity_tokens int")
    save("mix_targets", [("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.2, 3), ("none", 0.0, None)], "source string, target_share double, max_repeats int")
    return save("documents", docs, DOC)


def documents():
    r = random.Random(5)
    words = "one two three four проба мочи dose".split()
    docs = [(i, r.choice("aabc"), " ".join(r.choice(words) for _ in range(r.choice([1, 5, 30, 200]))), "x", "y") for i in range(300)]
    return [*docs, (900, "a", None, None, None), (901, None, "", None, None), (902, "zz", "word " * 3000, None, None)]


def test_assignments_hold_every_token_once(spark, save):
    docs = documents()
    where = tables(save, docs)
    rows = packing.assignments(spark, where).collect()
    for kind, capacity in (("s", 16), ("l", 200)):
        own = [r for r in rows if r["container_type"] == kind]
        per = {}
        for r in own:
            per[r["container_id"]] = per.get(r["container_id"], 0) + r["tokens"]
        assert max(per.values()) <= capacity
        for i, _, text, _, _ in docs:
            size = tokens.count_tokens(text)
            pieces = sorted((r["token_start"], r["tokens"]) for r in own if r["doc_id"] == i)
            assert sum(n for _, n in pieces) == size
            assert len(pieces) == max(1, -(-size // capacity))
            at = 0
            for start, n in pieces:
                assert start == at
                at += n
    assert {r["container_type"] for r in packing.summary(spark, where).collect()} == {"s", "l"}


def test_inclusion_is_unequal_and_kept(spark):
    """Over many seeds a document is drawn as often as its chance says, and larger ones more often."""
    r = random.Random(2)
    sizes = [r.choice([1, 3, 10, 40, 200]) for _ in range(400)]
    sized = spark.createDataFrame([("a", i, n) for i, n in enumerate(sizes)], "source string, doc_id long, tokens long").cache()
    share = mixing.Share("a", 1.0, 1, sum(sizes), 0, 0.3, 0.3 * sum(sizes))
    theta = mixing.inclusion(sized, spark.createDataFrame([("a", share.due)], "source string, due double")).first()["theta"]
    chance = [min(1.0, theta * n) for n in sizes]
    assert sum(c * n for c, n in zip(chance, sizes, strict=True)) == pytest.approx(share.due, rel=0.02)
    runs, drawn = 12, np.zeros(400)
    for seed in range(runs):
        rows = mixing.select(sized, [share], seed).collect()
        assert abs(sum(x["tokens"] for x in rows) - share.due) <= max(sizes)
        drawn[[x["doc_id"] for x in rows]] += 1
    for n in (10, 40, 200):
        own = [i for i, m in enumerate(sizes) if m == n]
        want = min(1.0, theta * n)
        assert abs(drawn[own].mean() / runs - want) < 4 * (want * (1 - want) / (runs * len(own))) ** 0.5 + 0.03


def test_mixture_meets_shares_and_caps(spark, save):
    docs = documents()
    where = tables(save, docs)
    rows = mixing.mixture(spark, where).collect()
    assert {r["source"] for r in rows} == {"a", "b", "c"}
    caps = {"a": 2, "b": 1, "c": 3}
    assert all(1 <= r["copies"] <= caps[r["source"]] for r in rows)
    report = {r["source"]: r for r in mixing.report(spark, where).collect()}
    total = sum(r["tokens"] * r["copies"] for r in rows)
    biggest = max(tokens.count_tokens(t) for _, s, t, _, _ in docs if s in caps)
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(report[s]["actual_share"] - share) <= biggest / total
        assert report[s]["used_tokens"] == sum(r["tokens"] * r["copies"] for r in rows if r["source"] == s)
    assert report["none"]["used_tokens"] == 0


def test_pareto_cut_equals_sorting(spark, save):
    docs = [(i, "a", "word " * (i % 7 + 1), None, None) for i in range(500)] + [(1000 + i, "b", "word", None, None) for i in range(20)]
    where = tables(save, docs)
    sized, shares = mixing.sized_sources(spark, where)
    x = next(s for s in shares if s.source == "a")
    got = {r["doc_id"] for r in mixing.select(sized, shares).where("source = 'a'").collect() if r["copies"] > x.whole}
    if 0 < x.fraction < 1:
        theta = mixing.inclusion(sized, spark.createDataFrame([("a", float(x.due))], "source string, due double")).first()["theta"]
        key = mixing.rank(mixing.uniform(mixing.SEED, "doc_id"), F.least(F.lit(1.0), F.lit(theta) * F.col("tokens")))
        u = {r["doc_id"]: (r["u"], r["tokens"]) for r in sized.where("source = 'a' and tokens > 0").withColumn("u", key).collect()}
        done, want = 0, set()
        for i in sorted(u, key=lambda i: (u[i][0], i)):
            if done + u[i][1] / 2 > x.due:
                break
            want.add(i)
            done += u[i][1]
        assert len(got ^ want) <= 2


def test_no_documents(spark, save):
    where = tables(save, [])
    assert packing.assignments(spark, where).count() == 0
    assert mixing.mixture(spark, where).count() == 0
    assert mixing.report(spark, where).count() == 4
