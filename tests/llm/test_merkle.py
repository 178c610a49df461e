"""Merkle manifests against a plain recursive tree, over several blocks and groups; tampering is found."""

import hashlib

import pytest
from pyspark.sql import functions as F

from siltstone.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def paths(nodes):
    """Root, and for each node the (left, digest) siblings up to it; None for a run of one."""
    out, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            other = place ^ 1
            out[i].append((other < place, nodes[other]) if other < len(nodes) else None)
            at[i] = place // 2
        nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], out


def brute(rows, changed):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        ordered = sorted(by[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = ordered, *paths([leaf(r) for r in ordered])
    root, top = paths([trees[lang][1] for lang in langs])
    out = []
    for lang, above in zip(langs, top, strict=True):
        ordered, subroot, inner = trees[lang]
        for r, path in zip(ordered, inner, strict=True):
            folded = leaf(changed(r))
            for s in path + above:
                folded = h(folded) if s is None else h(s[1], folded) if s[0] else h(folded, s[1])
            out.append((r[0], leaf(r), subroot, root, h(*[s[1] for s in path + above if s]), folded, folded == root))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, _group string, leaf int").repartition(5)


ROWS = [(i, f"s{i % 3}", None if i % 11 == 0 else ["en", "é", "z", ""][min(i % 6, 3)] if i != 5 else "alone", None if i % 9 == 0 else i, None if i % 13 == 0 else f"text {i} é") for i in range(700)]
ROWS += [(None, None, None, None, None)] * 3 + [(7, "a", "en", 1, "x"), (7, "b", "en", 1, "y")] + [(8, "s", "en", 1, "same")] * 4


@pytest.mark.parametrize("bits", [2, 8])
@pytest.mark.parametrize("broadcast", [0, 100])
def test_same_as_a_plain_tree(spark, monkeypatch, bits, broadcast):
    monkeypatch.setattr(merkle, "BITS", bits)
    monkeypatch.setattr(merkle, "BLOCK", 1 << bits)
    monkeypatch.setattr(merkle, "BROADCAST_GROUPS", broadcast)
    found = merkle.manifest(table(spark, ROWS), COLUMNS, changed={"n_chars": F.when(F.col("doc_id") % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    changed = lambda r: (*r[:3], r[3] + 1, r[4]) if r[0] is not None and r[0] % 7 == 0 and r[3] is not None else r
    wanted = brute(ROWS, changed)
    assert sorted(map(tuple, found.collect()), key=repr) == wanted
    assert any(not w[-1] for w in wanted)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_small_tables(spark, n):
    rows = [(i, "s", f"l{i}", 1, "t") for i in range(n)]
    assert sorted(map(tuple, merkle.manifest(table(spark, rows), COLUMNS).collect()), key=repr) == brute(rows, lambda r: r)


def test_no_rows(spark):
    assert merkle.manifest(table(spark, ROWS).where("false"), COLUMNS).collect() == []
