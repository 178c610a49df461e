"""Exact passages whose fragments stand in many other texts: no partner may hide another, whatever the fragments."""

import itertools
import random

import pytest

from siltstone.llm import substring


def words_of(rng, n):
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(n)]


def hidden(passage, piece, copies=6, pairs=12):
    """Pairs of texts with one passage, and texts with shifted pieces of it, some copies of each."""
    rng = random.Random(passage * 100 + piece)
    rows, ids, pieces = [], itertools.count(), []
    for _ in range(pairs):
        shared = words_of(rng, passage)
        rows += [(next(ids), " ".join(words_of(rng, 30) + shared + words_of(rng, 30))) for _ in range(2)]
        pieces += [(1000 + len(pieces) + i, " ".join(words_of(rng, 30) + shared[at : at + piece] + words_of(rng, 30))) for i, (at, _) in enumerate(itertools.product(range(0, passage - piece + 1, 5), range(copies)))]
    return rows, pieces


@pytest.mark.parametrize(("passage", "piece"), [(60, 40), (60, 45), (80, 45), (50, 45)])
def test_pieces_hide_no_passage(spark, passage, piece):
    rows, pieces = hidden(passage, piece)
    found = substring.repeated_passages(spark.createDataFrame(rows + pieces, "doc_id long, text string").repartition(4))
    spans = {}
    for r in found.collect():
        spans.setdefault(r["doc_id"], []).append((r["start"], r["end"], r["partner_id"]))
    assert {i for i, _ in rows} <= spans.keys()
    for i, _ in rows:  # the passage begins after 30 words
        assert any(a <= 32 and b >= 28 + passage and p == i ^ 1 for a, b, p in spans[i])
    # A piece is no passage; its text may be named only where an alignment carried it to min_words.
    assert sum(i >= 1000 for i in spans) <= 0.02 * len(pieces)


def test_every_text_with_a_shared_run_is_found(spark):
    """Brute force over all pairs: texts that share 50 consecutive words, made of overlapping stretches of a few sources."""
    rng = random.Random(12)
    sources = [words_of(rng, 120) for _ in range(4)]
    texts = []
    for _ in range(160):
        parts = []
        for _ in range(rng.randint(1, 3)):
            source, n = rng.choice(sources), rng.randint(20, 58)
            at = rng.randrange(120 - n)
            parts += words_of(rng, rng.randint(5, 15)) + source[at : at + n]
        texts.append(parts + words_of(rng, 5))
    runs = [{tuple(t[i : i + 50]) for i in range(len(t) - 49)} for t in texts]
    wanted = {i for i, a in enumerate(runs) if any(i != j and a & b for j, b in enumerate(runs))}
    found = substring.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4))
    assert wanted and wanted <= {r["doc_id"] for r in found.collect()}
