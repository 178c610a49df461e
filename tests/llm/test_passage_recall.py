import random

from siltstone.llm import substring


def test_changed_passages_are_found(spark):
    rng = random.Random(9)
    own = lambda n: [f"o{rng.randint(0, 10**9)}" for _ in range(n)]
    table, kinds = [], {}
    for size, changed in ((55, 0.08), (65, 0.1), (100, 0.12)):
        for _ in range(60):
            passage = own(size)
            other = list(passage)
            for at in rng.sample(range(3, size - 3), int(size * changed)):
                other[at] = own(1)[0]
            kinds.setdefault((size, changed), []).append((len(table), len(table) + 1))
            table += [own(30) + passage + own(20), own(10) + other + own(40)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(table)], "doc_id long, text string").repartition(3)
    found = {frozenset((r["doc_id"], r["partner_id"])) for r in substring.repeated_passages(docs).collect()}
    assert found <= {frozenset(p) for ps in kinds.values() for p in ps}
    for kind, pairs in kinds.items():
        assert sum(frozenset(p) in found for p in pairs) >= 0.95 * len(pairs), kind


def own(rng, n):
    return [f"o{rng.randint(0, 10**9)}" for _ in range(n)]


def frame(spark, table, extra=False):
    rows = [(i, " ".join(w)) for i, w in enumerate(table)]
    if extra:  # columns with names that are used inside
        return spark.createDataFrame([(*r, 7, 7, 7) for r in rows], "doc_id long, text string, class int, seed int, at int").repartition(3)
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_fragments_of_several_partners_are_no_passage(spark):
    rng = random.Random(21)
    parts = [own(rng, 25) for _ in range(4)]
    table = [own(rng, 30) + sum(parts, []) + own(rng, 30)] + [own(rng, 20) + p + own(rng, 60) for p in parts]
    assert substring.repeated_passages(frame(spark, table)).count() == 0


def test_passage_of_which_others_hold_fragments(spark):
    """Two texts share 56 words, of which either half stands in many others, whichever has the smallest key."""
    rng = random.Random(22)
    table, pairs = [], set()
    for _ in range(12):
        a, b = own(rng, 28), own(rng, 28)
        pairs.add(frozenset((len(table), len(table) + 1)))
        table += [own(rng, 40) + a + b + own(rng, 10), own(rng, 5) + a + b + own(rng, 70)]
        table += [own(rng, 30) + half + own(rng, 30) for half in (a, b) for _ in range(6)]
    found = substring.repeated_passages(frame(spark, table, True)).collect()
    assert {frozenset((r["doc_id"], r["partner_id"])) for r in found} == pairs


def common_words(a, b):
    row = [0] * (len(b) + 1)
    for u in a:
        left = 0
        for j, v in enumerate(b):
            up = row[j + 1]
            row[j + 1], left = max(up, row[j], left + (u == v)), up
    return row[-1]


def test_passages_against_brute_force(spark):
    """All pairs of a small corpus with exact, fuzzy, overlapping and repeated passages, hot ones too."""
    rng = random.Random(23)
    pool = [own(rng, rng.randint(30, 90)) for _ in range(12)]
    table = []
    for i in range(70):
        words = []
        for _ in range(rng.randint(1, 4)):
            part = list(pool[0] if i % 3 == 0 and rng.random() < 0.5 else rng.choice(pool))
            if rng.random() < 0.4:
                part[rng.randrange(len(part))] = own(rng, 1)[0]
            words += own(rng, rng.randint(0, 60)) + part[rng.choice([0, 0, 20]) :]
        table.append(words + own(rng, rng.randint(0, 40)))
    table += [list(table[3]), list(table[3])]
    runs = {}
    for i, words in enumerate(table):
        for s in range(len(words) - 49):
            runs.setdefault(tuple(words[s : s + 50]), set()).add(i)
    wanted = {i for docs in runs.values() if len(docs) > 1 for i in docs}
    found = substring.repeated_passages(frame(spark, table)).collect()
    assert wanted <= {d for r in found for d in (r["doc_id"], r["partner_id"])} and len(wanted) > 40
    for r in found:
        a, b = table[r["doc_id"]][r["start"] : r["end"]], table[r["partner_id"]][r["partner_start"] : r["partner_end"]]
        assert len(a) >= 50 and r["doc_id"] != r["partner_id"]
        assert common_words(a, b) >= 0.8 * max(len(a), len(b)) and common_words(a, b) >= r["matched"] - 1  # words are compared by one byte
    # Every word in an exactly shared run of 50 words is reported, but for the text that stands for all.
    for words, docs in runs.items():
        if len(docs) > 1:
            i = max(docs)
            at = next(s for s in range(len(table[i]) - 49) if tuple(table[i][s : s + 50]) == words)
            assert any((r["doc_id"] == i and r["start"] < at + 50 and at < r["end"]) or (r["partner_id"] == i and r["partner_start"] < at + 50 and at < r["partner_end"]) for r in found)


def test_one_word_over_and_over(spark):
    table = [["spam"] * 30_000, ["spam"] * 400 + own(random.Random(24), 50), ["spam"] * 20, [], ["a", "b"] * 5000]
    found = substring.repeated_passages(frame(spark, table)).collect()
    assert {frozenset((r["doc_id"], r["partner_id"])) for r in found} == {frozenset((0, 1))}


def test_thinned_runs():
    h = substring.np.array([5, 5, 5, 5, 5, 5, 5, 5, 5, 5, 9, 5, 3, 3], dtype="uint64")
    at = substring.np.arange(len(h))
    assert substring.thinned(h, at, 4).tolist() == [0, 4, 8, 9, 10, 11, 12, 13]
