import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import neardup
from quillon.llm.neardup import below, similar_sets
from quillon.llm.neighbours import nearest


def word_sets(n, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    out = []
    for i in range(n):
        if out and i % 3:
            base = list(rng.choice(out))
            for _ in range(rng.randint(0, 9)):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            out.append(base)
        else:
            out.append(rng.sample(vocabulary, rng.randint(15, 60)))
    return [" ".join(x) for x in out]


def brute(texts, threshold, least):
    sets = [(i, set(re.findall("[a-z0-9_]+", t.lower()))) for i, t in enumerate(texts)]
    sets = [(i, s) for i, s in sets if len(s) >= least]
    return {(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if len(x & y) >= threshold * len(x | y)}


def pairs_of(members, links):
    classes = {}
    for r in members.collect():
        classes.setdefault(r["class"], []).append(r.id)
    found = {tuple(sorted(p)) for ids in classes.values() for p in itertools.combinations(ids, 2)}
    for r in links.collect():
        found |= {tuple(sorted(p)) for p in itertools.product(classes[r.class_a], classes[r.class_b])}
    return found


@pytest.mark.parametrize("threshold", [0.7, 0.8])
def test_all_alike_pairs_come_out(spark, threshold):
    texts = word_sets(500)
    texts += texts[:20] + [t.upper() for t in texts[20:30]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string").selectExpr("id", "content", "1 _k", "2 class")
    got = pairs_of(*similar_sets(df, "id", "content", threshold))
    want = brute(texts, threshold, 20)
    assert got - want == set()
    assert len(want - got) <= 0.001 * len(want)


@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_the_exact_way_misses_nothing(spark, monkeypatch, threshold):
    monkeypatch.setattr(neardup, "SPLIT", 16)  # lists and classes are split
    texts = word_sets(400, seed=8)
    df = spark.createDataFrame(list(enumerate(texts + texts[:40])), "id long, content string")
    want = brute(texts + texts[:40], threshold, 20)
    assert pairs_of(*similar_sets(df, "id", "content", threshold, exact=True)) == want
    members, links = similar_sets(df, "id", "content", threshold, exact=True, asked=F.col("id") % 5 == 0)
    owner = {r.id: r["class"] for r in members.collect()}
    asked = {owner[i] for i in range(0, len(owner), 5) if i in owner}
    got = {(r.class_a, r.class_b) for r in links.collect()}
    assert got == {tuple(sorted((owner[a], owner[b]))) for a, b in want if owner[a] != owner[b] and {owner[a], owner[b]} & asked}


def test_hot_group_nulls_and_empty(spark):
    text = " ".join(f"x{i}" for i in range(40))
    rows = [(i, text) for i in range(60)] + [(100, None), (101, ""), (102, "a b c"), (None, text), (0, text), (103, "x0 " * 200_000)]
    df = spark.createDataFrame(rows, "id long, content string")
    members, links = similar_sets(df, "id", "content")
    assert members.count() == 60 and members.select("class").distinct().count() == 1 and links.count() == 0
    assert similar_sets(df.limit(0), "id", "content")[0].count() == 0


def test_binomial_bound():
    assert below(32, 0.7, 1e-4) == 12
    assert below(10, 1.0, 1e-4) == 10


def vectors(n, dim=16, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    x = centres[rng.integers(0, 12, n)] + 0.25 * rng.standard_normal((n, dim))
    return [(f"v{i:04d}", [float(a) for a in row]) for i, row in enumerate(x)]


def test_recall_against_brute_force(spark):
    rows = vectors(4000)
    got = {}
    for r in nearest(spark.createDataFrame(rows, "k string, vector array<float>").selectExpr("k", "vector", "1 _v"), "k", k=5, width=16).collect():
        got.setdefault(r.item_id, set()).add(r.neighbour_id)
    x = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cos = x @ x.T
    np.fill_diagonal(cos, -2)
    hits = 0
    for i in range(0, len(rows), 20):
        best = {rows[j][0] for j in np.argsort(-cos[i])[:5]}
        assert len(got[rows[i][0]]) == 5
        hits += len(best & got[rows[i][0]])
    assert hits / (5 * len(rows) / 20) >= 0.9


def test_recall_with_many_more_cells_than_probes(spark):
    """4,000 vectors without clusters in 80 cells: most neighbours lie in another cell than the item."""
    x = np.random.default_rng(9).standard_normal((4000, 8))
    df = spark.createDataFrame([(f"v{i:04d}", [float(a) for a in row]) for i, row in enumerate(x)], "k string, vector array<float>")
    got = {(r.item_id, r.neighbour_id) for r in nearest(df, "k", k=5, width=8, cell=50).collect()}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cos = x @ x.T
    np.fill_diagonal(cos, -2)
    hits = [(f"v{i:04d}", f"v{j:04d}") in got for i in range(0, 4000, 10) for j in np.argsort(-cos[i])[:5]]
    assert len(got) == 20_000 and sum(hits) / len(hits) >= 0.99


def test_vectors_that_cannot_be_used(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0]), ("a", [1.0, 0.0]), ("a", None), ("d", None), ("e", [0.0, 0.0]), ("f", [nan, 1.0]), ("g", [1.0]), ("h", [inf, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "k string, vector array<float>")
    got = {(r.item_id, r.neighbour_id) for r in nearest(df, "k", k=1, width=2).collect()}
    assert got == {("a", "b"), ("b", "a"), ("c", "b")}
    assert nearest(df.limit(0), "k", width=2).count() == 0
    assert nearest(df.where("k = 'c'"), "k", width=2).count() == 0


def test_many_equal_vectors(spark):
    rows = [(f"e{i:03d}", [1.0, 2.0, 3.0]) for i in range(200)] + [("z", [-1.0, 0.0, 0.5])]
    got = {}
    for r in nearest(spark.createDataFrame(rows, "k string, vector array<float>"), "k", k=5, width=3).collect():
        got.setdefault(r.item_id, []).append(r.neighbour_id)
    assert len(got) == 201 and all(len(set(v)) == 5 and k not in v for k, v in got.items())
    assert sorted(got["e150"]) == ["e000", "e001", "e002", "e003", "e004"]
