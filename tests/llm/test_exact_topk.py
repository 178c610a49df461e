"""Exact top-k against brute force: random, clustered, repeated and broken vectors; elimination must not change a row."""

import math
import random

import pytest
from pyspark.sql import functions as F

from siltstone.llm import topk


def brute(rows, every, k):
    kept = []
    for uid, (vec_id, v) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((uid, vec_id, [math.floor(256 * x) for x in v]))
    out = []
    for uid, vec_id, q in kept:
        if vec_id is None or vec_id % every:
            continue
        found = sorted((-sum(a * b for a, b in zip(q, x)), i is None, i or 0, i) for u, i, x in kept if u != uid)[:k]  # noqa: B905  the shorter one counts
        out += [(vec_id, rank, i, -s) for rank, (s, _, _, i) in enumerate(found, 1)]
    return sorted(out, key=repr)


def rows_of(kind):
    rng = random.Random(kind)
    if kind == "clusters":
        centres = [[rng.gauss(0, 3) for _ in range(8)] for _ in range(12)]
        rows = [(i, [c + rng.gauss(0, 0.02) for c in centres[min(rng.randrange(18), 11)]]) for i in range(400)]
    elif kind == "random":
        rows = [(i, [rng.gauss(0, 0.13) for _ in range(16)]) for i in range(300)]
    else:  # one vector in a third of all rows, ties, repeated ids, broken and uneven vectors
        rows = [(i, [0.5, -0.25, 1.0]) for i in range(100)] + [(i % 7, [rng.choice([0.0, 0.25, -1.0]) for _ in range(3)]) for i in range(120)]
        rows += [(300, None), (301, [None, 1.0, 1.0]), (302, [math.nan, 1.0, 1.0]), (303, [math.inf, 0.0, 0.0]), (None, [2.0, 2.0, 2.0]), (None, [2.0, 2.0, 2.0]), (304, []), (305, [1.0]), (306, [0.0, 0.0, 0.0]), (310, [1e4, -1e4, 3.0])]
        rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("kind", ["clusters", "random", "broken"])
def test_same_as_brute_force(spark, kind):
    rows = rows_of(kind)
    frame = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<double>, score double").repartition(3)
    found = topk.search(frame, F.col("vec_id") % 5 == 0, k=4, pivots=10, sample=100, query_block=16)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, 5, 4)


def test_bounds_spare_most_products_where_vectors_have_structure(spark, monkeypatch):
    """Far from all candidates of clustered vectors are evaluated, in the order of their bounds."""
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.normal(0, 300, (20, 8))
    x = np.floor(np.repeat(centres, 50, 0) + rng.normal(0, 3, (1000, 8))).astype(np.int64)
    pivots = x[topk.choose_pivots(x, 32)]
    far = topk.distances(x, pivots)
    square = (x * x).sum(axis=1).astype(float)
    seen = []
    for i in range(0, 1000, 50):
        bound = np.abs(far - far[i]).max(axis=1)
        bounds = (square[i] + square - bound * bound) / 2 + topk._slack(float(square.max()))
        best, order = topk.Best(5, None), np.arange(1000)
        scores = x @ x[i]
        assert (bounds >= scores).all()
        monkeypatch.setattr(topk, "STRIDE", 5)
        taken = []
        monkeypatch.setattr(topk.Best, "take", lambda self, s, o, ids, f=topk.Best.take, taken=taken: (taken.append(len(s)), f(self, s, o, ids)))
        topk._evaluate(best, x[i].astype(float), bounds, x.astype(float), order, order.astype(object), order != i)
        monkeypatch.undo()
        seen.append(sum(taken))
        expected = sorted((-int(s), j) for j, s in enumerate(scores) if j != i)[:5]
        assert [(-s, j) for s, j in expected] == list(zip(best.score.tolist(), best.ids.tolist(), strict=True))
    assert sum(seen) < 0.5 * 1000 * len(seen)


def test_empty_and_few(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(none, F.col("vec_id") % 5 == 0).collect() == []
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert list(map(tuple, topk.search(two, F.col("vec_id") % 5 == 0).collect())) == [(0, 1, 1, 256 * 512)]
