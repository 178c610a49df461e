"""Token alignment against whole texts tokenized at once, and counts against a dictionary."""

import hashlib
import os
import random
from collections import Counter

import pytest

from siltstone.llm import align
from siltstone.llm.queries import ALIGNED, tokenizer_path

ALPHABET = ["a", "b", "é", " ", "  ", "\n", "\n\n", "\t", "\xa0", "▁", "中", "文", "🙂", "1", "23", "'s", "don't", "<s>", "<0x41>", "<|endoftext|>", "\x1c", "́", "ﬁ", "...", "Hello", "the", "\r\n", "　", "\x00", "\x85"]


@pytest.fixture(scope="module")
def tokenizers():
    return align.Tokenizers(*map(tokenizer_path, ALIGNED))


def plain(tokenizers, text):
    """Ids of the whole text and the groups, by sets of offsets; None where the bytes differ."""
    if not text:
        return None
    raw = (" " + text).encode()
    a, b = tokenizers.a.encode(" " + text, add_special_tokens=False).ids, tokenizers.b.encode(text)
    if b"".join(tokenizers.a_bytes[i] for i in a) != raw or b"".join(tokenizers.b_bytes[i] for i in b) != raw:
        return None

    def ends(ids, of):
        at = 0
        for i in ids:
            at += len(of[i])
            yield at

    in_a, in_b = list(ends(a, tokenizers.a_bytes)), list(ends(b, tokenizers.b_bytes))
    out, last = [], 0
    for end in sorted(set(in_a) & set(in_b)):
        out.append(([i for i, e in zip(a, in_a, strict=True) if last < e <= end], [i for i, e in zip(b, in_b, strict=True) if last < e <= end]))
        last = end
    return out


def brute(tokenizers, texts):
    cut = [plain(tokenizers, t) for t in texts]
    links = [Counter((i, j) for a, b in c or [] for i in a for j in b) for c in cut]
    counts = Counter(pair for found in links for pair in found)
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(best.get(i, 0), n)
    for c, found in zip(cut, links, strict=True):
        if c is None:
            yield 0, 0, 0, 0, 0, 0, ""
            continue
        shown = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in c)
        n_best = sum(n for (i, j), n in found.items() if counts[i, j] == best[i])
        yield sum(len(a) for a, _ in c), sum(len(b) for _, b in c), len(c), sum(found.values()), n_best, sum(n * counts[p] for p, n in found.items()), hashlib.sha256(shown.encode()).hexdigest()


def texts_of(seed, n=250):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def test_whole_table_against_brute_force(spark, tokenizers, texts):
    rows = [(t[0], t[1]) for t in texts] + [(1000 + i, t) for i, t in enumerate(texts_of(4))] + [(2000, "ab" * 400), (2001, "\n"), (2002, " "), (2003, "\n\nx")]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n_a int, keys int").repartition(3)
    found = align.align(frame, *map(tokenizer_path, ALIGNED))
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    wanted = [(i, *x) for (i, _), x in zip(rows, brute(tokenizers, [t for _, t in rows]), strict=True)]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(wanted, key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_chunks_are_the_whole_text(tokenizers, seed):
    """Cutting texts into chunks, and forgetting them, changes nothing."""
    aligner = align.Aligner(tokenizers, memory=40)
    for text in texts_of(seed):
        cut = plain(tokenizers, text)
        got = aligner.links([text])[0]
        shown = None if cut is None else ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in cut)
        assert got[4] == ("" if shown is None else hashlib.sha256(shown.encode()).hexdigest())


def test_large_groups_count_equal_ids_first(tokenizers, monkeypatch):
    text = "x" * 300 + " " + "ábc中" * 30
    whole = align.Aligner(tokenizers).links([text])
    monkeypatch.setattr(align, "LARGE", 1)
    assert align.Aligner(tokenizers).links([text]) == whole


def test_folding_and_shards(spark, tokenizers):
    texts = texts_of(9, 60) * 3
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    links = align.linked(frame, *map(tokenizer_path, ALIGNED))
    counts = align.link_counts(links, 50257, fold=200)
    import numpy as np

    seen = Counter(int(k) for r in links.select("keys").collect() for k in np.frombuffer(bytes(r["keys"]), np.int64))
    keys = np.array(sorted(seen), dtype=np.int64)
    assert counts.reader().look_up(keys).tolist() == [seen[int(k)] for k in keys]
    assert sum(s[2] for s in counts.shards) == len(seen)


def test_no_documents(spark, no_docs):
    assert align.align(no_docs, *map(tokenizer_path, ALIGNED)).collect() == []


def test_worker_keeps_tokenizers_and_memory_from_task_to_task(tokenizers):
    paths = [*map(tokenizer_path, ALIGNED)]
    kept = align.worker_aligner(*paths)
    texts = [" ".join(random.Random(i % 7).choices(ALPHABET, k=50)) for i in range(20)] + [None, "", "the the\nend"]
    expected = align.Aligner(tokenizers).links(texts)
    assert kept.links(texts[:9]) == expected[:9]
    assert align.worker_aligner(*paths) is kept and kept.index
    assert kept.links(texts) == expected
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
