import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from siltstone.llm import common, simhash


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ")
    words = [w for w in __import__("re").findall("[^\x20\x09-\x0d]+", words)]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, distance=3):
    fps = [slow_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((((d is None, d or 0), f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def test_near_duplicates_against_brute_force(docs, texts):
    got = simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted((((r[0] is None, r[0] or 0), r[1], r[2]) for r in got), key=repr) == slow_components([(t[0], t[1]) for t in texts])


def test_deduplicate_keeps_one_of_each_group(docs, texts):
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    want = {(c if c is not None else -1) for _, _, c in slow_components([(t[0], t[1]) for t in texts])}
    got = [r["doc_id"] if r["doc_id"] is not None else -1 for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_empty(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.deduplicate(no_docs).count() == 0


@pytest.mark.parametrize("limit", [0, 3, 1000])
def test_links_whatever_the_list_limit(spark, limit):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = set(base)
    for b in base:
        for _ in range(12):
            fps.add(b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 5))))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    got = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), limit)
    assert {tuple(r) for r in got.collect()} == want and want


def test_position_sets():
    from itertools import combinations

    assert len(set(simhash.BLOCKS)) == 28 and len(simhash.SYSTEM) == 14
    for gone in combinations(range(8), 3):
        assert sum(not set(b) & set(gone) for b in simhash.BLOCKS) == simhash.LEAST_LISTS
        assert sum(not set(b) & set(gone) for b in simhash.SYSTEM) == 1


@pytest.mark.parametrize("limit", [0, 1000])
def test_pairs_below_the_minimum_are_never_verified(spark, limit):
    """Candidates share five positional bytes at least; all pairs in reach are among them."""
    rng = random.Random(3)
    fps = set()
    for _ in range(8):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(12):  # the same bytes but for three or four positions
            x = base
            for p in rng.sample(range(8), rng.choice([3, 4])):
                x ^= (1 << rng.randrange(8)) << (8 * p)
            fps.add(x)
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    shared = lambda a, b: sum((a >> 8 * p & 255) == (b >> 8 * p & 255) for p in range(8))
    got = {tuple(r) for r in simhash.candidates(spark.createDataFrame([(s,) for s in signed], "fp long"), limit).collect()}
    five = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if shared(a, b) >= 5}
    near = {(a, b) for a, b in five if bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    assert got <= five and near <= got and near and (limit == 0 or got == five)
    assert any(shared(a, b) == 4 for i, a in enumerate(signed) for b in signed[i + 1 :])


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in common.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_skew_lookup_is_a_left_join(spark):
    left = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 1), (None, 2), ("none", 3)], "k string, i int")
    right = spark.createDataFrame([("hot", "H", 50), ("cold", "C", 1)], "k string, v string, n long")
    got = common.skew_lookup(left, right, "k", "n", __import__("pyspark.sql.functions", fromlist=["x"]).xxhash64("i"))
    assert sorted(map(repr, (tuple(r) for r in got.select("k", "i", "v").collect()))) == sorted(map(repr, [("hot", i, "H") for i in range(50)] + [("cold", 1, "C"), (None, 2, None), ("none", 3, None)]))


@pytest.mark.parametrize("least, joins", [(50, 3), (51, 1)])
def test_skew_lookup_looks_for_hot_keys_only_if_there_are_any(spark, monkeypatch, least, joins):
    monkeypatch.setattr(common, "HOT_ROWS", least)
    left = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 1), (None, 2), (None, 3), ("none", 3)], "k string, i int")
    right = spark.createDataFrame([("hot", "H", 50), ("cold", "C", 1)], "k string, v string, n long")
    got = common.skew_lookup(left, right, "k", "n", F.xxhash64("i"))
    assert sorted(map(repr, map(tuple, got.select("k", "i", "v").collect()))) == sorted(map(repr, map(tuple, left.join(right, "k", "left").select("k", "i", "v").collect())))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == joins


def test_fingerprint_of_a_long_text():
    text = " ".join(np.random.default_rng(0).choice(["a", "b", "c"], 200_000)).encode()
    assert simhash.fingerprint(text) == slow_fingerprint(text.decode()[: len(text)])
