import random
from pathlib import Path

import corpus_pipeline
import numpy as np
from siltstone.llm import near_copies, simhash


def grams(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stage_finds_every_pair_at_jaccard_08(spark):
    rng = random.Random(8)
    rows = []
    for g in range(30):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(60, 160))]
        shared = [f"s{i}" for i in range(30)]  # a passage of all documents
        for c in range(4):
            words = base + shared
            for _ in range(c):
                words[rng.randrange(len(base))] = f"c{rng.randint(0, 10**6)}"
            rows.append((10 * g + c, " ".join(words), "en", "s", 0))
    rows += [(1000, None, None, None, 0), (1001, " ", None, None, 0), (1002, "one two", None, None, 0), (1003, "One\ttwo", None, None, 0)]
    sets = {d: grams(t or "") for d, t, *_ in rows}
    parent = {d: d for d in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = 0
    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                pairs += 1
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.dedup_documents(spark, docs, "").collect()}
    assert pairs > 60 and kept == {find(d) for d in sets}
    assert simhash.deduplicate(docs).count() > len(kept)


def test_large_sets_against_brute_force(spark):
    """Pairs at 0.8 and above among texts of 150 to 3,000 words that share a third of their words with all others."""
    rng = random.Random(11)
    own = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    common, rows = own(1000), []
    for g, n in enumerate((150, 170, 260, 400, 700, 1500, 3000)):
        for b in range(4):
            base = own(n) + common[: n // 3]
            rows.append((100 * g + 10 * b, " ".join(base)))
            for c in range(1, 4):
                words = list(base)
                for at in rng.sample(range(n), int(len(base) * 0.0095 * c)):
                    words[at] = own(1)[0]
                if c == 3:
                    words += own(len(base) // 12)
                rows.append((100 * g + 10 * b + c, " ".join(words)))
    sets = {d: grams(t) for d, t in rows}
    close = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    group = {d: d for d in sets}
    for i, j in sorted(close) * 4:
        group[i] = group[j] = min(group[i], group[j])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert len(close) > 50 and min(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in close) < 0.85
    assert {r["doc_id"] for r in near_copies.deduplicate(docs).collect()} == set(group.values())


def test_positions_that_pairs_at_the_threshold_share():
    """Simulated pairs of similarity 0.8: fewer than LEAST shared positions never happen, EXPECTED are usual."""
    rng = np.random.default_rng(2)
    for n in (257, 333, 1000, 5000):
        for _ in range(60):
            m = int(rng.integers(n, int(n / 0.8) + 1))
            shared = int(np.ceil(0.8 / 1.8 * (n + m)))
            h = rng.integers(0, 2**64, n + m - shared, dtype=np.uint64)
            a, b = np.sort(h[:n]), np.sort(h[n - shared :])
            assert len(np.intersect1d(near_copies.positions(a, 0.8), near_copies.positions(b, 0.8))) >= near_copies.LEAST


def test_clashing_names_and_empty_tables(spark, no_docs):
    docs = spark.createDataFrame([(1, "a b c", "k", 1), (2, "a b c", "k", 2)], "doc_id long, text string, key string, `key_` int")
    got = simhash.deduplicate(docs, similarity=0.8).collect()
    assert [tuple(r) for r in got] == [(1, "a b c", "k", 1)]
    assert [tuple(r) for r in simhash.deduplicate(docs).collect()] == [(1, "a b c", "k", 1)]
    assert simhash.deduplicate(no_docs, similarity=0.8).count() == 0


def test_rows_without_id_and_repeats(spark, no_docs):
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, "x y z")], "doc_id long, text string")
    assert sorted(map(repr, near_copies.deduplicate(docs).collect())) == ["Row(doc_id=3, text='a b c d e f')", "Row(doc_id=None, text='x y z')"]
    assert near_copies.deduplicate(no_docs).count() == 0


def test_stage_links_by_fingerprints(spark, monkeypatch):
    """Without the lists of shingles the stage still unites what three bits tell; a link whose texts are unlike is none."""
    rng = random.Random(4)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(2000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "end"])), (3, "a " * 40 + "b c d e f"), (4, "a " * 40 + "g h i j k")]
    assert bin(simhash.fingerprint(rows[0][1].encode()) ^ simhash.fingerprint(rows[1][1].encode())).count("1") <= 3
    assert simhash.fingerprint(rows[2][1].encode()) == simhash.fingerprint(rows[3][1].encode())
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for name in ("_large_lists", "_small_lists"):
        whole = getattr(near_copies, name)
        monkeypatch.setattr(near_copies, name, lambda *a, whole=whole: whole(*a).where("false"))
    assert {r["doc_id"] for r in corpus_pipeline.dedup_documents(spark, docs, "").collect()} == {1, 3, 4}


def test_scratch_tables_are_deleted(spark):
    from siltstone.session import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = {p.name for p in folder.iterdir()} if folder.exists() else set()
    docs = spark.createDataFrame([(1, "a b c d e f\nx"), (2, "a b c d e f\ny"), (3, "a b c d e f\nz")], "doc_id long, text string")
    assert simhash.deduplicate(docs, similarity=0.8).count() == 3
    left = {p.name.rsplit("-", 1)[0] for p in folder.iterdir() if p.name not in before}
    assert left == {"fingerprints", "fingerprint-links", "kept-rows"}
