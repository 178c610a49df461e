import random

import pytest
from pyspark.sql import functions as F

from siltstone.llm import common, substring


@pytest.mark.parametrize("least", [50, 51])
@pytest.mark.parametrize("once", [False, True])
def test_salted_lookup_is_one_left_join(spark, monkeypatch, least, once):
    monkeypatch.setattr(common, "HOT_ROWS", least)
    left = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 1), ("cold", 1), (None, 2), (None, 3), ("none", 3)], "k string, i int")
    right = spark.createDataFrame([("hot", "H", 50), ("cold", "C", 2), (None, "N", 60)], "k string, v string, n long")
    got = common.salted_lookup(left, right, "k", "n", F.xxhash64("i"), once)
    want = left.join(right, "k", "left").select("k", "i", "v")
    assert sorted(map(repr, map(tuple, got.select("k", "i", "v").collect()))) == sorted(map(repr, map(tuple, (want.distinct() if once else want).collect())))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 1


def test_hot_seeds_are_told_without_a_join_of_all_occurrences(spark, monkeypatch):
    """A passage that stands in every text: its seeds are hot, yet no row is joined to learn that, and the passages are the same."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) + " " + passage) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, substring.repeated_passages(docs).collect()))
    plans, written = [], common._stored_at

    def watched(df, path):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return written(df, path)

    monkeypatch.setattr(common, "_stored_at", watched)
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    assert sorted(map(tuple, substring.repeated_passages(docs).collect())) == want and len({r[0] for r in want}) == 40
    assert any("Union" in p and "explode" in p for p in plans) and not any("_hot" in p for p in plans)
