"""BPE, decontamination, language ID, line dedup and passages on small tables."""

import hashlib
import random
import re
import unicodedata
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm import bpe, decontaminate, langid, line_dedup, queries, substring

PATH = public_tokenizers.path(queries.TOKENIZER)

SCHEMA_TEXTS = "doc_id long, text string, lang string, source string, n_chars long"


def key(x):
    return (x is None, x or 0)


def test_bpe_like_the_library(docs, texts):
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    want = []
    for d, t, *_ in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((key(d), ids, library.decode(ids, skip_special_tokens=False)))
    got = [(key(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) for r in bpe.encode(docs, PATH).collect()]
    assert sorted(got) == sorted(want)


def test_bpe_odd_texts():
    library, coder = Tokenizer.from_file(PATH), bpe.PairIndexBpe(PATH)
    rng = random.Random(2)
    letters = "ab  'sStTrRééΣσİǅẞ12²½Ⅷ中　\x1c\x85​﻿\U0001f600<|>_!?.,\t\n\x00"
    odd = ["".join(rng.choices(letters, k=rng.randint(0, 50))) for _ in range(1500)] + ["a<|endoftext|>b <|startoftext|>", "a" * 500, "!?" * 200]
    ids, decoded = coder.encode(odd)
    for text, i, d in zip(odd, ids, decoded, strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(i, "<u4").tolist() == want and d.decode() == library.decode(want, skip_special_tokens=False)


def differing(texts):
    """Those of texts whose ids or decoded text are not the library's."""
    library, coder = Tokenizer.from_file(PATH), bpe.PairIndexBpe(PATH)
    library.no_truncation()
    library.no_padding()
    ids, decoded = coder.encode(texts)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    back = library.decode_batch(want, skip_special_tokens=False)
    return [t for t, i, d, w, b in zip(texts, ids, decoded, want, back, strict=True) if np.frombuffer(i, "<u4").tolist() != w or d.decode() != b]


@pytest.mark.parametrize("before,after", [("a", "b"), ("1", "!")])
def test_bpe_every_code_point(before, after):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 100_000):
        assert differing([before + c + after for c in points[at : at + 100_000]]) == []


def test_bpe_order_of_marks():
    """Every mark among others of another class, and every decomposed letter."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    marks = [c for c in points if unicodedata.combining(c)]
    rng = random.Random(15)
    mixed = ["".join(rng.choice("aqe\u05d0\u0915") + "".join(rng.choices(marks, k=rng.randint(1, 4))) for _ in range(4)) for _ in range(20_000)]
    assert differing([t for m in marks for t in ("q\u0323" + m + "\u0327\u0301z", "q" + m + "\u0323\u0301z", "q\u031b" + m)] + mixed) == []
    assert differing([unicodedata.normalize("NFD", c) + "x" for c in points if unicodedata.decomposition(c)]) == []


def test_bpe_random_scripts():
    rng = random.Random(14)
    blocks = [(0x20, 0x7F), (0xA0, 0x250), (0x300, 0x370), (0x370, 0x600), (0x600, 0x700), (0x900, 0xE00), (0xE00, 0x1200), (0x1E00, 0x2100), (0x2000, 0x2C00), (0x3000, 0x3200), (0x4E00, 0x5200), (0xAC00, 0xB000), (0xFB00, 0x10000), (0x10300, 0x10A00), (0x1D400, 0x1D800), (0x1F300, 0x1FA00)]
    word = lambda: "".join(chr(rng.randrange(*rng.choice(chosen))) for _ in range(rng.randint(1, 12)))
    texts = []
    for _ in range(4000):
        chosen = rng.sample(blocks, 2)
        texts.append(" ".join(word() for _ in range(rng.randint(1, 8))))
    assert differing(texts) == []


def test_bpe_empty(no_docs):
    assert bpe.encode(no_docs, PATH).count() == 0


ITEMS = [(1, "the quick brown fox jumps over the lazy dog again and again today"), (2, "Short one"), (2, "short ONE"), (3, None), (4, ""), (None, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9"), (5, "the quick brown fox jumps over the lazy dog again and again today"), (6, "a b a b a b a b a b a b a")]


def slow_contamination(rows, items):
    find = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall
    low = lambda s: (s or "").translate({i: i + 32 for i in range(65, 91)})
    out = []
    for d, t in rows:
        words, hit, ids = find(low(t)), set(), set()
        for item, text in items:
            w = find(low(text))
            n = min(10, len(w))
            for s in range(len(w) - n + 1) if n else ():
                for at in range(len(words) - n + 1):
                    if words[at : at + n] == w[s : s + n]:
                        hit.update(range(at, at + n))
                        ids.update([str(item)] if item is not None else [])
        out.append((key(d), len(words), len(hit), sorted(ids)))
    return sorted(out)


@pytest.mark.parametrize("block_words", [1_000_000, 12])
def test_contamination_against_brute_force(spark, texts, block_words):
    rows = [(t[0], t[1]) for t in texts] + [(400, "x The QUICK brown-fox jumps over the lazy dog; again and AGAIN today y"), (401, "a short one and w0 w1 w2 w3 w4 w5 w6 w7 w8 w9."), (402, "a b a b a b a b a b a b"), (403, "quick brown fox jumps over the lazy dog again"), (404, "shorté one"), (404, "short one")]
    docs, items = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(ITEMS, "item_id int, text string")
    got = sorted((key(r["doc_id"]), r["n_words"], r["n_hit"], r["item_ids"]) for r in decontaminate.contamination(docs, items, block_words=block_words).collect())
    assert got == slow_contamination(rows, ITEMS)
    clean = decontaminate.clean(docs, items, block_words=block_words)
    dirty = Counter(g[0] for g in got if g[2])
    assert Counter(key(r["doc_id"]) for r in clean.collect()) == Counter(g[0] for g in got) - dirty


def test_proximity_matches(spark):
    docs = spark.createDataFrame([(1, "fox brown quick jumps the over lazy dog the again"), (2, "fox and dog")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "the quick brown fox jumps over the lazy dog again")], "item_id int, text string")
    assert {r["doc_id"] for r in decontaminate.proximity_matches(docs, items).collect()} == {1}
    assert decontaminate.phrase_matches(docs, items).count() == 0


def test_proximity_matches_without_the_rarest_term(spark):
    """A window with any two of its terms changed, its rarest one too, is still found; one with three changed is not."""
    rng = random.Random(31)
    item = [f"i{k}" for k in range(10)]
    rows, wanted = [], set()
    for d in range(60):
        gone = rng.sample(range(10), rng.choice([0, 1, 2, 3, 4]))
        words = [f"x{d}_{k}" if k in gone else w for k, w in enumerate(item)]
        rng.shuffle(words)
        rows.append((d, " ".join([f"b{rng.randint(0, 9)}" for _ in range(30)] + words + ["i9"] * (d % 3))))
        wanted |= {d} if len(gone) <= 2 else set()
    items = spark.createDataFrame([(1, " ".join(item))], "item_id int, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r["doc_id"] for r in decontaminate.proximity_matches(docs, items).collect()}
    assert wanted <= found and len(wanted) > 20
    for d, text in rows:  # nothing else than places with eight different terms
        words = text.split()
        near = any(len(set(words[max(0, c - 9) : c + 10]) & set(item)) >= 8 for c in range(len(words)) if words[c] in item)
        assert near or d not in found


def test_phrases_at_every_place(spark):
    """Starts of all occurrences, overlapping ones too, whatever the blocks."""
    docs = spark.createDataFrame([(1, "a b " * 9), (2, "x a b a b a b a b a b x"), (3, "a b a b a b a b a")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b a b a b a b a b"), (None, "x a")], "item_id int, text string")
    for block_words in (1, 25, 1000):
        got = {(r["doc_id"], r["item_id"], r["start"]) for r in decontaminate.phrase_matches(docs, items, block_words=block_words).collect()}
        assert got == {(1, 7, s) for s in (0, 2, 4, 6, 8)} | {(2, 7, 1), (2, None, 0)}


def test_one_index_whatever_the_benchmark(spark, monkeypatch):
    """The texts are read once, and no window that lacks a probe term goes to a block."""
    docs = spark.createDataFrame([(i, f"w{i} common words stand in every text here and there now") for i in range(50)], "doc_id long, text string").repartition(4)
    passes = []
    real = decontaminate.positional_index
    monkeypatch.setattr(decontaminate, "positional_index", lambda *a, **k: passes.append(1) or real(*a, **k))
    items = spark.createDataFrame([(i, f"w{i} common words stand in every text here and there") for i in range(0, 200, 2)], "item_id int, text string")
    got = decontaminate.contamination(docs, items).where("n_hit > 0").collect()
    assert passes == [1] and {r["doc_id"] for r in got} == set(range(0, 50, 2)) and all(r["item_ids"] == [str(r["doc_id"])] for r in got)


def test_clean_keeps_clashing_names(spark):
    docs = spark.createDataFrame([(1, "one two", "k", 1), (2, "three", "k", 2)], "doc_id long, text string, key string, block int")
    items = spark.createDataFrame([(1, "two")], "item_id int, text string")
    assert [tuple(r) for r in decontaminate.clean(docs, items).collect()] == [(2, "three", "k", 2)]


def test_contamination_of_nothing(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id int, text string")
    assert decontaminate.contamination(docs, none).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(no_docs, spark.createDataFrame(ITEMS, "item_id int, text string")).count() == 0


SPEECH = {"en": "the house and garden with that were there when something which", "de": "das haus und garten mit nicht aber auch wenn etwas welche", "fr": "la maison et le jardin avec pas mais aussi quand quelque chose", "es": "la casa y el jardin con no pero tambien cuando algo cual"}


def check_machines(docs, model, per_lang):
    """The machines that tasks trained are those trained here one after the other, family by family."""
    rows = sorted((r["lang"], r["h"], r["x"]) for r in langid.training_rows(docs, per_lang, "doc_id", "text", "lang").collect())
    chosen = [r for k, r in enumerate(rows) if sum(s[0] == r[0] for s in rows[:k]) < per_lang]
    x = np.array([np.frombuffer(v, dtype="<f2") for *_, v in chosen]).astype(np.float32)
    langs = np.array([lang for lang, *_ in chosen])
    family = np.array([langid._FAMILY_OF.get(v, v) for v in langs])
    for votes, y, inside in [(model.families, family, langs == langs)] + [(v, langs, family == f) for f, v in model.languages.items()]:
        assert votes.labels == sorted(set(y[inside].tolist())) and len(votes.pairs) == len(votes.weights) == len(votes.labels) * (len(votes.labels) - 1) // 2
        for (a, b), w in zip(votes.pairs, votes.weights, strict=True):
            a, b = votes.labels[a], votes.labels[b]
            these = inside & ((y == a) | (y == b))
            assert np.allclose(langid.train_svm(x[these], np.where(y[these] == a, 1.0, -1.0)), w, atol=1e-6)


def test_language_id_held_out_accuracy(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(SPEECH[lang].split(), k=rng.randint(8, 40))), lang) for i, lang in enumerate(list(SPEECH) * 100)]
    extra = [(1000, None, "en"), (1001, "12 !! €", "en"), (1002, "", None), (None, rows[0][1], "en"), (1003, rows[1][1], None), (1004, "\U0001f600 —", "de")]
    docs = spark.createDataFrame([(*r, "x") for r in rows + extra], "doc_id long, text string, lang string, score string")
    model = langid.fit(docs, per_lang=40)
    check_machines(docs, model, 40)
    out = langid.classify(docs, model, ["doc_id", "lang", "score"]).withColumn("held", langid.held_out()).collect()
    held = [r for r in out if r["held"] and r["doc_id"] < 1000]
    assert len(held) > 40 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out) and len(out) == len(rows) + len(extra)
    by_id = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out}
    assert by_id[1000] == by_id[1001] == by_id[1002] == by_id[1004] == ("und", 0.0) and by_id[1003][0] == rows[1][2]


def test_votes_against_a_plain_count():
    """One-versus-one voting restated: every pair votes, ties go to the larger sum of margins, then to the first label."""
    rng = np.random.default_rng(5)
    labels = ["a", "b", "c", "d", "e"]
    pairs = [(i, j) for i in range(5) for j in range(i + 1, 5)]
    for _ in range(200):
        weights = rng.normal(size=(len(pairs), 7)).round(1)
        x = rng.normal(size=6).round(1)
        votes, sums, weakest = dict.fromkeys(labels, 0), dict.fromkeys(labels, 0.0), dict.fromkeys(labels, np.inf)
        for (i, j), w in zip(pairs, weights, strict=True):
            m = float(w[:-1] @ x + w[-1])
            votes[labels[i] if m >= 0 else labels[j]] += 1
            for label, s in ((labels[i], m), (labels[j], -m)):
                sums[label] += s
                weakest[label] = min(weakest[label], s)
        best = max(labels, key=lambda v: (votes[v], round(sums[v], 9), -labels.index(v)))
        got, score = langid.Votes(labels, np.array(pairs), weights).predict(x)
        assert got == best and score == pytest.approx(1 / (1 + np.exp(-4 * weakest[best])))


def test_svm_separates_and_weighs_errors():
    """Separable points are separated; the weights are those of the same loss minimised by plain gradient descent."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(80, 3)).astype(np.float32)
    y = np.where(x @ np.array([1.0, -2.0, 0.5]) + 0.3 * rng.normal(size=80) > 0, 1.0, -1.0)
    w = langid.train_svm(x, y, cost=1.0, rounds=500)
    full = np.hstack([x, np.ones((80, 1))])
    slow = np.zeros(4)
    for _ in range(20_000):
        slack = np.maximum(0, 1 - y * (full @ slow))
        slow -= 0.002 * (slow - 2 * (full * (y * slack)[:, None]).sum(axis=0))
    assert np.allclose(w, slow, atol=0.02)


def test_language_id_with_nothing_to_learn(spark, docs, no_docs):
    assert langid.fit(no_docs) is None
    out = langid.classify(docs, langid.fit(docs.where("lang = 'xx'")), ["doc_id"])
    assert {tuple(r) for r in out.select("lang_pred", "score").collect()} == {("und", 0.0)}
    one = langid.classify(docs, langid.fit(docs), ["doc_id"])
    assert {r[0] for r in one.select("lang_pred").collect()} == {"en", "und"}


def test_features_of_long_text_are_whole():
    text = ("abc def " * 300_000) + "zzz " * 300_000
    a, b = langid.features(text), langid.features("abc def " * 1000 + "zzz " * 1000)
    assert np.allclose(a, b, atol=0.02)


def slow_lines(rows, min_tokens=4, min_docs=3, similar=0.7):
    lines, docs = [], sorted({(key(d), t) for d, t in rows if t is not None})
    for d, t in docs:
        for n, line in enumerate(t.split("\n")):
            words = re.sub("[ \t\r\f\x0b]+", " ", line).strip(" ").split(" ")
            words = ["<*>" if re.search("[0-9]", w) else w for w in words]
            if len(words) >= min_tokens:
                lines.append(((d, t), n, tuple(words)))
    leaf = lambda p: (len(p), p[:3])
    pattern_docs, patterns = defaultdict(set), defaultdict(set)
    for d, _, p in lines:
        pattern_docs[p].add(d)
        patterns[leaf(p)].add(p)
    template = {p: p for p in pattern_docs}

    def divide(name, ps):
        total = sum(len(pattern_docs[p]) for p in ps)
        if len(ps) < 2 or total < min_docs:
            return
        common, splits = [], []
        for at, column in enumerate(zip(*ps, strict=True)):
            counts = Counter()
            for p, w in zip(ps, column, strict=True):
                counts[w] += len(pattern_docs[p])
            n, w = max((n, w) for w, n in counts.items())
            common.append(w if 2 * n >= total else None)
            if len(counts) > 1 and n >= min_docs:
                splits.append((len(counts), at, counts))
        rest = defaultdict(list)
        for p in ps:
            if sum(a == b for a, b in zip(common, p, strict=True)) >= similar * len(p):
                template[p] = ("family", name)
            elif splits:
                _, at, counts = min(splits, key=lambda x: x[:2])
                rest[(at, p[at] if counts[p[at]] >= min_docs else None)].append(p)
        for part, ps in rest.items():
            divide((*name, part), ps)

    for key_, ps in patterns.items():
        divide((key_,), sorted(ps))
    seen, first = defaultdict(set), {}
    for d, n, p in lines:
        seen[template[p]].add(d)
        first[template[p]] = min([*([first[template[p]]] if template[p] in first else []), (d, n)], key=lambda x: (x[0][0][1] if not x[0][0][0] else -1, x[1]))
    gone = defaultdict(set)
    for d, n, p in lines:
        if len(seen[template[p]]) >= min_docs and first[template[p]] != (d, n):
            gone[d].add(n)
    return sorted(((key(d), None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[(key(d), t)])) for d, t in rows), key=repr)


def test_line_dedup_against_brute_force(spark, texts):
    rng = random.Random(4)
    rows = [(i, "\n".join([f"user {rng.randint(1, 99)} logged in from {i} at noon", t[1] or "", "", "short line", f"all rights of this {rng.choice(['page', 'site', 'page'])} are reserved by the owner alone"])) for i, t in enumerate(texts) if i % 2]
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, "a b c d\na b c d\na b c d"), (504, "x y z w " * 2000), (505, rows[0][1]), (505, rows[0][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, tokens int").repartition(3)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "tokens", "_ld_lines", "_ld_dropped"]
    got = sorted(((key(r["doc_id"]), r["text"]) for r in out.collect()), key=repr)
    assert got == slow_lines(rows)
    assert sum("logged in" in (t or "") for _, t in got) == 1


def family_rows(seed, families, docs, words=9):
    """Rows of one leaf: families with one or two variable words each, and lines that belong to none."""
    rng = random.Random(seed)
    shapes = [[rng.choice("abcdefgh") + str("xyz"[rng.randrange(3)]) for _ in range(words - 3)] for _ in range(families)]
    rows = []
    for i in range(docs):
        lines = [f"note {i} is of no further use"]
        for _ in range(rng.randint(1, 3)):
            shape = list(rng.choice(shapes)) if rng.random() < 0.8 else [rng.choice("abcdefgh") + rng.choice("xyzuvw") for _ in range(words - 3)]
            for at in rng.sample(range(words - 3), rng.randint(0, 2)):
                shape[at] = rng.choice("pqrs") + rng.choice("klmn") + rng.choice("tuvw")
            lines.append("the log says " + " ".join(shape))
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize(("seed", "families", "docs"), [(1, 2, 60), (2, 5, 80), (3, 12, 90)])
def test_line_families_of_one_leaf(spark, tmp_path, seed, families, docs):
    rows = family_rows(seed, families, docs)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = line_dedup.dedup_lines(table)
    got = sorted(((key(r["doc_id"]), r["text"]) for r in out.collect()), key=repr)
    assert got == slow_lines(rows)
    # The registered SQL divides leaves alike.
    table.write.parquet(str(tmp_path / "documents.parquet"))
    sql = queries.ORACLES["op2_line_dedup"].replace("from documents", f"from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted((key(d), t) for d, t in duckdb.sql(f"select doc_id, text from ({sql})").fetchall()) == sorted(got)


def test_small_family_beside_large_ones(spark):
    names = [a + b for a in "klmnpqrst" for b in "aeiou"]
    large = [f"today we saw {n} reading by the old harbour wall" for n in names]
    small = [f"today we saw no train that {n} could possibly take" for n in names[:40]]
    third = [f"today we saw seven of {n} ships leave for home" for n in names]
    rows = [(i, line) for i, line in enumerate([*large, *small, *third, "today we saw what nobody else has ever seen before"])]
    kept = [r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["text"]]
    assert sorted(kept) == sorted([large[0], small[0], third[0], rows[-1][1]])


def test_line_dedup_empty(no_docs):
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_repeated_passages(spark, texts):
    rng = random.Random(6)
    # Words of their own, so that nothing but the planted passages repeats.
    own = lambda tag, n: [f"{tag}{rng.randint(0, 10**9)}" for _ in range(n)]
    passage, other = own("p", 60), own("q", 45)
    fuzzy = [*passage[:20], "edited", *passage[21:45], *passage[46:]]
    rows = [(1, own("a", 100) + passage + own("b", 30)), (2, own("c", 10) + passage), (3, fuzzy + own("d", 50)), (4, own("e", 80)), (5, own("f", 20) + other), (6, other + own("g", 20)), (7, own("h", 90)), (9, own("i", 4)), (10, passage[:5])]
    rows += [(8, rows[6][1]), (8, rows[6][1])]
    table = [(d, " ".join(w)) for d, w in rows] + [(20, None), (21, ""), (None, " ".join(passage))]
    found = substring.repeated_passages(spark.createDataFrame([(*t, 1) for t in table], "doc_id long, text string, n int").repartition(3)).collect()
    sets = [{r["doc_id"], r["partner_id"]} for r in found]
    linked = set().union(*sets)
    assert linked == {1, 2, 3, 7, 8} and {7, 8} in sets
    for r in found:
        assert r["end"] - r["start"] >= 50 and r["matched"] <= r["end"] - r["start"] + 1
    spans = {r["doc_id"]: (r["start"], r["end"]) for r in found} | {r["partner_id"]: (r["partner_start"], r["partner_end"]) for r in found}
    for d, (a, b) in {1: (100, 160), 2: (10, 70), 3: (0, 59), 7: (0, 90)}.items():
        assert abs(spans[d][0] - a) <= 2 and abs(spans[d][1] - b) <= 2
    assert sum(r["doc_id"] == 8 for r in found) == 1


def test_repeated_passages_empty(no_docs):
    assert substring.repeated_passages(no_docs).count() == 0


def test_chain_is_best():
    rng = random.Random(7)
    for _ in range(60):
        n = rng.randint(1, 9)
        pts = sorted({(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(n)})
        x, y = np.array([p[0] for p in pts]), np.array([p[1] for p in pts])

        def best(i, pts=pts):
            tail = [best(j) - substring.GAP_COST * (pts[i][0] - pts[j][0] + pts[i][1] - pts[j][1]) for j in range(len(pts)) if pts[j][0] < pts[i][0] and pts[j][1] < pts[i][1]]
            return substring.K + max([0.0, *tail])

        chains = substring.chain(x, y)
        assert sorted(i for c in chains for i in c) == list(range(len(pts)))
        first = chains[0]
        score = substring.K * len(first) - substring.GAP_COST * (x[first[-1]] - x[first[0]] + y[first[-1]] - y[first[0]])
        assert score == pytest.approx(max(best(i) for i in range(len(pts))))


def test_winnow_guarantee():
    rng = np.random.default_rng(1)
    for n in (1, 15, 16, 17, 300):
        h = rng.integers(0, 50, n).astype(np.uint64)
        at = set(substring.winnow(h).tolist())
        assert at and all(any(i in at for i in range(s, s + substring.WINDOW)) for s in range(max(0, n - substring.WINDOW + 1)))


def test_digests(spark):
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]
