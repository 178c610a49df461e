"""Fuzzy repeated passages by collinear chaining of shared k-mer seeds.

1. A text is its lower-cased words.  Texts with equal words form a class.  Winnowing
   picks the smallest of every WINDOW consecutive k-mer hashes, so any shared run of
   WINDOW + K - 1 words shares a seed.  Words, seeds and classes come from one pass over the texts.
2. A seed that occurs in several classes has the class with the smallest key as its
   representative; every other occurrence is joined to it, and its own to the class with the
   largest key, so a passage in n classes gives n matches a seed, never all pairs, and every
   shared seed of a text is matched.
3. The matches of a class with one representative, sorted by position, are chained: a
   chain's score is K a seed less a cost for the words it passes over in either text, and
   the best predecessor comes from a Fenwick tree of prefix maxima over the
   representative's positions.  Chains are taken best first, each match once.
4. Chains are aligned on the words of both texts, as one-byte codes: mismatches between seeds are
   counted, gaps of unequal length are aligned by edit distance, and ends are extended past changed,
   added and missing words as long as four in five words match, so one shared seed is enough for a
   whole passage.  Spans that follow each other in both texts are made one.
   A passage has at least MIN_WORDS words in common with one partner, at an identity of at least MIN_IDENTITY.
5. The seeds of a passage may have several representatives that hold only fragments of it.  Where
   fragments touch and make MIN_WORDS words together, steps 2 to 4 are repeated for these
   places with pairs of consecutive seeds, then with four, as seeds: their representatives share
   longer runs with the text.
6. Fragments may hide a partner in every round, however long the seeds.  What is still left is matched by
   whole windows of MIN_WORDS words: classes that have a seed in common with a place are found by
   it, and only their windows around it are compared, so an exact passage is never lost, and a window in n classes gives n matches.

A class's matches, with the codes of its own and its partners' words, are the unit of work.

Edge cases: null, empty and short texts have no passages; rows without doc_id cannot
be reported and are left out; rows alike in doc_id and words are reported once; a passage repeated inside
one text only is no match; an empty table gives an empty result; ties go to the smaller class key; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh3_64_intdigest, xxh64_intdigest

from .common import salted_lookup, scratch, settled, stored
from .decontaminate import words

K = 6
WINDOW = 8
#: Rounds with two and four consecutive seeds as one, which find fuzzy passages too; exact ones that are left are found by windows.
ROUNDS = 2
#: Words beyond the outer matches with a partner that its codes are sent for.
REACH = 256
MIN_WORDS = 50
MIN_IDENTITY = 0.8
#: Cost of a word passed over between two seeds of a chain, in either text.
GAP_COST = 0.15
#: Up to so many words between two seeds may differ altogether.
MIN_GAP = 8
#: Gaps of unequal length are aligned up to so many words on the shorter side; beyond, the ends on either side are extended.
MAX_EDIT = 64
#: Cost of an unequal word in an end's extension, which stops at DROP below its best score.
MISS_COST = 4
DROP = 16
#: Words between two spans that still touch.
TOUCH = 10
_MEMORY = 200_000
_MATCH = ["class", "partner", "x", "y"]
#: In the place of matched words: a span that fragments make up.
_FRAGMENTS = -1
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _slide(a: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """pick over every ``size`` consecutive values."""
    out, held = a, 1
    while held < size:
        step = min(held, size - held)
        out = pick(out[:-step], out[step:])
        held += step
    return out


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of values that are the least of some window (all values, if there are fewer, are one window)."""
    n = len(hashes)
    if n <= window:
        return np.flatnonzero(hashes == hashes.min()) if n else np.zeros(0, dtype=np.int64)
    least = _slide(hashes, window, np.minimum)
    padded = np.concatenate([np.zeros(window - 1, dtype=hashes.dtype), least, np.zeros(window - 1, dtype=hashes.dtype)])
    return np.flatnonzero(_slide(padded, window, np.maximum) == hashes)


def thinned(hashes: np.ndarray, at: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Of neighbouring positions with one hash (a word over and over), the first, every window-th after it and the last."""
    if not len(at):
        return at
    same = (np.diff(at) == 1) & (np.diff(hashes[at]) == 0)
    number = np.arange(len(at))
    since = number - np.maximum.accumulate(np.where(np.r_[True, ~same], number, 0))
    return at[(since % window == 0) | np.r_[~same, True]]


class _Memory(dict):
    """Hashes of words, found once."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxh64_intdigest(word)
        return found


class Seeder:
    """Seeds of texts."""

    def __init__(self) -> None:
        self.memory = _Memory()

    def codes(self, found: list[bytes]) -> np.ndarray:
        if len(self.memory) > _MEMORY:
            self.memory.clear()
        return np.fromiter(map(self.memory.__getitem__, found), dtype=np.uint64, count=len(found))

    def seeds(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and positions of the seeds of a text, given the hashes of its words."""
        n = len(code)
        if n < K:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        rolled = np.zeros(n - K + 1, dtype=np.uint64)
        for j in range(K):
            rolled = rolled * _FACTOR + code[j : n - K + 1 + j]
        rolled ^= rolled >> np.uint64(29)
        rolled *= np.uint64(0xBF58476D1CE4E5B9)
        rolled ^= rolled >> np.uint64(32)
        at = thinned(rolled, winnow(rolled))
        return rolled[at].view(np.int64), at.astype(np.int32)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _classes(texts: DataFrame) -> DataFrame:
    """doc_id, class, n_words, codes (a byte a word), seeds and their positions per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeder = Seeder()
        for batch in batches:
            keys, sizes, codes, seeds, places = [], [], [], [], []
            for t in batch.column(1).cast(pa.binary()):
                code = seeder.codes(words(t.as_py()))
                keys.append(_signed(xxh3_64_intdigest(code.tobytes())))
                sizes.append(len(code))
                codes.append((code >> np.uint64(56)).astype(np.uint8).tobytes())
                seed, at = seeder.seeds(code)
                seeds.append(seed)
                places.append(at)
            ends = pa.array(np.cumsum([0, *map(len, seeds)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, dtype=kind), *found]))) for found, kind in ((seeds, np.int64), (places, np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(codes, pa.binary()), *lists], ["doc_id", "class", "n_words", "codes", "seeds", "places"])

    return texts.mapInArrow(run, "doc_id long, class long, n_words long, codes binary, seeds array<long>, places array<int>")


def chain(x: np.ndarray, y: np.ndarray, cost: float = GAP_COST) -> list[list[int]]:
    """Best collinear chains of matches (sorted by x, then y): lists of match numbers, best score first, each match once."""
    n = len(x)
    if not n:
        return []
    dx, dy = np.diff(x), np.diff(y)
    if n == 1 or (np.all(dx > 0) and np.all(dx == dy) and dx.max() * 2 * cost < K):
        return [list(range(n))]
    ranks = np.unique(y, return_inverse=True)[1] + 1
    size = int(ranks.max())
    best_value, best_match = [-np.inf] * (size + 1), [-1] * (size + 1)
    score, back = [0.0] * n, [-1] * n
    xs, ys, rs = x.tolist(), y.tolist(), ranks.tolist()
    pending: list[int] = []
    for i in range(n):
        if pending and xs[i] > xs[pending[0]]:  # only matches with smaller x may precede
            for p in pending:
                value, r = score[p] + cost * (xs[p] + ys[p]), rs[p]
                while r <= size:
                    if value > best_value[r]:
                        best_value[r], best_match[r] = value, p
                    r += r & -r
            pending = []
        r, value, match = rs[i] - 1, -np.inf, -1
        while r > 0:
            if best_value[r] > value:
                value, match = best_value[r], best_match[r]
            r -= r & -r
        gain = value - cost * (xs[i] + ys[i])
        score[i], back[i] = (K + gain, match) if gain > 0 else (float(K), -1)
        pending.append(i)
    used = [False] * n
    chains = []
    for i in sorted(range(n), key=lambda j: (-score[j], j)):
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = back[i]
        if path:
            chains.append(path[::-1])
    return chains


def _edit_matches(a: bytes, b: bytes) -> int:
    """Equal codes in a best alignment of two short runs."""
    row = [0] * (len(b) + 1)
    for u in a:
        left = 0
        for j, v in enumerate(b):
            up = row[j + 1]
            row[j + 1], left = max(up, row[j], left + (u == v)), up
    return row[-1]


def _extension(a: bytes, b: bytes, i: int, j: int, credit: int) -> tuple[int, int, int]:
    """Words by which an end at i, j extends in this and the other text, and how many of them match.

    The score counts a match 1, a changed, added or missing word -MISS_COST, so a passage has four equal words
    in five while it is not negative; credit is the score of the passage so far.  The last end counts that has a better
    score than all before it, or three equal words and, with the credit, a score of at least 0.
    """
    start, other = i, j
    n, m = len(a), len(b)
    score = best = matched = run = 0
    found = (0, 0, 0)
    while i < n and j < m:
        if a[i] == b[j]:
            step = 1
            if i + 32 <= n and j + 32 <= m and a[i : i + 32] == b[j : j + 32]:
                step = 32
            i, j, matched, score, run = i + step, j + step, matched + step, score + step, run + step
            if score > best or (run >= 3 and score + credit >= 0):
                best, found = score, (i - start, j - other, matched)
            continue
        score, run = score - MISS_COST, 0
        if score < best - DROP:
            break
        most, di, dj = -1, 1, 1
        for u, v in ((1, 1), (1, 0), (0, 1)):
            ahead = sum(p == q for p, q in zip(a[i + u : i + u + 4], b[j + v : j + v + 4], strict=False))
            if ahead > most:
                most, di, dj = ahead, u, v
        i, j = i + di, j + dj
    return found


def _gap_matches(a: bytes, b: bytes) -> tuple[int, int]:
    """Words between two seeds (the longer side) and how many of them match."""
    if len(a) != len(b):
        return max(len(a), len(b)), _edit_matches(a, b) if min(len(a), len(b)) <= MAX_EDIT else 0
    return len(a), len(a) if a == b else sum(u == v for u, v in zip(a, b, strict=True))


def align(path: list[int], x: list[int], y: list[int], a: bytes, b: bytes) -> list[tuple[int, int, int, int, int]]:
    """(start, end, other start, other end, matched words) of the parts of a chain; a and b are the codes of this and the other text.

    A chain is cut where more than MIN_GAP words between two seeds match by less than half.
    """
    parts: list[tuple[list[int], int]] = [([path[0]], K)]
    for i, j in zip(path, path[1:], strict=False):
        gap, other = x[j] - x[i] - K, y[j] - y[i] - K
        if gap <= 0 or other <= 0:  # the seeds overlap
            gap, found = max(gap, other), min(gap, other)
        else:
            gap, found = _gap_matches(a[x[i] + K : x[j]], b[y[i] + K : y[j]])
        if gap > MIN_GAP and 2 * found < gap:
            parts.append(([j], K))
        else:
            members, matched = parts[-1]
            parts[-1] = ([*members[:1], j], matched + K + found)
    back, other_back = a[::-1], b[::-1]
    out = []
    for members, matched in parts:
        first, last = members[0], members[-1]
        missed = max(x[last] - x[first], y[last] - y[first]) + K - matched
        credit = matched - MISS_COST * missed
        head, other_head, head_matched = _extension(back, other_back, len(a) - x[first], len(b) - y[first], credit)
        credit += head_matched - MISS_COST * (max(head, other_head) - head_matched)
        tail, other_tail, tail_matched = _extension(a, b, x[last] + K, y[last] + K, credit)
        out.append((x[first] - head, x[last] + K + tail, y[first] - other_head, y[last] + K + other_tail, matched + head_matched + tail_matched))
    return out


def _united(spans: list[tuple[int, int, int, int, int]], min_identity: float) -> list[tuple[int, int, int, int, int]]:
    """Spans of one partner, those that follow each other within TOUCH words in both texts made one, as long as enough words of the whole match."""
    out: list[tuple[int, int, int, int, int]] = []
    for s in sorted(spans):
        start, end, other, other_end, matched = out[-1] if out else (0, -TOUCH - 1, 0, 0, 0)
        if 0 <= s[0] - end <= TOUCH and 0 <= s[2] - other_end <= TOUCH and matched + s[4] >= min_identity * max(s[1] - start, s[3] - other):
            out[-1] = (start, s[1], other, s[3], matched + s[4])
        else:
            out.append(s)
    return out


def passages_of(partner: np.ndarray, x: np.ndarray, y: np.ndarray, own: bytes, others: dict[int, tuple[int, bytes]], min_words: int, min_identity: float) -> list[tuple]:
    """(partner, start, end, partner start, partner end, matched) of one class, from its matches sorted by partner, x and y, and the codes of its words and (from which word on) of its partners'.

    Chains whose words a better chain with the same partner has covered already are passed over.
    Fragments that may belong to a passage with yet another partner come last, marked _FRAGMENTS.
    """
    out, weak = [], []
    edges = np.flatnonzero(np.diff(partner)) + 1
    for a, b in zip(np.r_[0, edges].tolist(), np.r_[edges, len(partner)].tolist(), strict=True):
        low, codes = others[int(partner[a])]
        xs, ys = x[a:b].tolist(), (y[a:b] - low).tolist()
        spans, covered = [], bytearray(len(own))
        for path in chain(x[a:b], y[a:b]):
            if all(covered[xs[i]] and covered[xs[i] + K - 1] for i in path):
                continue
            for span in align(path, xs, ys, own, codes):
                start, end, other_start, other_end, matched = span
                if matched >= min_identity * max(end - start, other_end - other_start):
                    spans.append(span)
                    covered[start:end] = b"\1" * (end - start)
        for start, end, other, other_end, matched in _united(spans, min_identity):
            (out if end - start >= min_words else weak).append((int(partner[a]), start, end, other + low, other_end + low, matched))
    return out + _stitched(out, weak, min_words)


def _stitched(found: list[tuple], weak: list[tuple], min_words: int) -> list[tuple]:
    """Places where spans too short to report, in no reported passage, make min_words together, or so many that the ends, which may have no seed, can be missing."""
    least = max(K, min_words - 2 * (WINDOW - 1))
    spans = sorted((s[1], s[2]) for s in weak if not any(f[1] <= s[1] and s[2] <= f[2] for f in found))
    out, start, end = [], 0, -TOUCH - 1
    for a, b in [*spans, (None, None)]:
        if a is not None and a <= end + TOUCH and end >= 0:
            end = max(end, b)
            continue
        if end - start >= least:
            out.append((0, start, end, 0, 0, _FRAGMENTS))
        start, end = a, b
    return out


def _chained(matches: DataFrame, min_words: int, min_identity: float) -> DataFrame:
    """Passages of all classes; the codes of a class (partner is the class) and of its partners are rows with x = -1 and the first coded word as y."""

    def rows(table: pa.Table) -> pa.RecordBatch | None:
        key = table["class"].to_numpy()
        partner, x, y = (table[c].to_numpy() for c in _MATCH[1:])
        told = np.flatnonzero(x < 0)
        codes = {(int(key[i]), int(partner[i])): c for i, c in zip(told.tolist(), table["codes"].take(pa.array(told)).to_pylist(), strict=True)}
        edges = np.flatnonzero(np.diff(key)) + 1
        out = []
        for a, b in zip(np.r_[0, edges].tolist(), np.r_[edges, len(key)].tolist(), strict=True):
            name, at = int(key[a]), a + np.flatnonzero(x[a:b] >= 0)
            others = {int(partner[i]): (int(y[i]), codes[name, int(partner[i])]) for i in (a + np.flatnonzero(x[a:b] < 0)).tolist()}
            out += [(name, *p) for p in passages_of(partner[at], x[at], y[at], others[name][1], others, min_words, min_identity)]
        if not out:
            return None
        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["class", "partner", "start", "end", "other_start", "other_end", "matched"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the class that the last batch ended with may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            cut = int(np.flatnonzero(key == key[-1])[0])
            if held and (cut > 0 or key[0] != held[-1].column(0)[0].as_py()):
                done = pa.Table.from_batches([*held, batch.slice(0, cut)])
                if (found := rows(done)) is not None:
                    yield found
                held = []
            elif cut > 0 and (found := rows(pa.Table.from_batches([batch.slice(0, cut)]))) is not None:
                yield found
            held.append(batch.slice(cut))
        if held and (found := rows(pa.Table.from_batches(held))) is not None:
            yield found

    dealt = matches.select(*_MATCH, "codes").repartition("class").sortWithinPartitions("class", "partner", "x", "y")
    return dealt.mapInArrow(run, "class long, partner long, start int, end int, other_start int, other_end int, matched int")


def _dealt(occurrences: DataFrame, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Matches (class, partner, x, y) of the occurrences (seed, class, at) that share a seed, of the classes of ``wanted`` only, if given; and those occurrences, with the number n of each seed's."""
    ends = occurrences.groupBy("seed").agg(F.min("class").alias("partner"), F.max("class").alias("last"), F.count("*").alias("n"))
    shared = stored(ends.where("partner < last").select("seed", "partner", "last", "n"), "shared-seeds")
    # Equal texts once; n stays, as the weight of a seed in later lookups.
    met = salted_lookup(occurrences.select("seed", "class", "at"), shared.withColumn("w", F.col("n")), "seed", "w", F.xxhash64("class", "at"), once=True)
    met = settled(met.where("partner is not null"), "seed-matches")
    # All occurrences of a seed in its representative's text are few and in one class; its first one is matched.
    base = met.where("class = partner").groupBy("seed").agg(F.min("at").alias("y"), F.max("n").alias("n"))
    others = met.where("class <> partner")
    own = met.where("class = partner").drop("partner").withColumnsRenamed({"at": "x", "last": "partner"})
    if wanted is not None:
        others, own = others.join(wanted, "class", "left_semi"), own.join(wanted, "class", "left_semi")
    others = others.select("seed", "class", "partner", F.col("at").alias("x"))
    matches = salted_lookup(others, stored(base, "seed-bases"), "seed", "n", F.xxhash64("class", "x")).select(*_MATCH)
    # A representative's own occurrences are matched with the last class, so that its passages have no holes.
    tail = met.where("class = last").groupBy("seed").agg(F.min("at").alias("y"))
    return stored(matches.unionByName(own.join(tail, "seed").select(*_MATCH)), "passage-matches"), met.select("seed", "class", "at", "n")


def _aligned(matches: DataFrame, rows: DataFrame, min_words: int, min_identity: float) -> DataFrame:
    """Passages of the matched classes: the words of every class, and of its partners, go with its matches."""
    pairs = matches.groupBy("class", "partner").agg(F.greatest(F.min("y") - REACH, F.lit(0)).alias("low"), (F.max("y") + K + REACH).alias("high"))
    whole = matches.select("class", F.col("class").alias("partner"), F.lit(0).alias("low"), F.lit(2**31 - 1).alias("high")).distinct()
    pairs = stored(pairs.union(whole), "passage-pairs")
    weights = pairs.groupBy("partner").agg(F.count("*").alias("n"))
    coded = rows.select(F.col("class").alias("partner"), "codes").join(weights.select("partner"), "partner", "left_semi").groupBy("partner").agg(F.max("codes").alias("codes"))
    told = salted_lookup(pairs, coded.join(weights, "partner"), "partner", "n", F.xxhash64("class"))
    told = told.select("class", "partner", F.lit(-1).alias("x"), F.col("low").alias("y"), F.substring("codes", F.col("low") + 1, F.col("high") - F.col("low")).alias("codes"))
    matches = matches.withColumn("codes", F.lit(None).cast("binary")).unionByName(told)
    return settled(_chained(matches, min_words, min_identity), "passages")


def _kept(occurrences: DataFrame, inside: DataFrame) -> DataFrame:
    """The occurrences (seed, class, at) whose seed has one inside."""
    seeds = stored(inside.select("seed", "n").distinct().withColumn("inside", F.lit(True)), "place-seeds")
    return salted_lookup(occurrences.drop("n"), seeds, "seed", "n", F.xxhash64("class", "at")).where("inside").drop("inside")


def _longer(occurrences: DataFrame, places: DataFrame) -> DataFrame:
    """Of the shared seeds that lie in the places (class, start, end), all occurrences in all classes, two consecutive ones as one seed."""
    inside = occurrences.join(places.select("class", "start", "end"), "class").where("at >= start and at < end")
    kept = _kept(occurrences, inside)
    order = Window.partitionBy("class").orderBy("at", "seed")
    pairs = kept.withColumn("next", F.lead("seed").over(order)).withColumn("gap", F.lead("at").over(order) - F.col("at")).where("next is not null")
    return stored(pairs.select(F.xxhash64("seed", "next", "gap").alias("seed"), "class", "at"), "longer-seeds")


def _windows(occurrences: DataFrame, places: DataFrame, rows: DataFrame, min_words: int) -> DataFrame:
    """Windows of min_words words (seed, class, at) around the seeds that lie near the places, in all classes that have these.

    Texts that share a window have the same seeds in it, but for the WINDOW - 1 places at either end, whose choice depends on what
    stands outside.  The first such seed is at most WINDOW - 1 places further on and tells where the window may begin.
    The seeds that begin within the rest are part of the window's key, as a set, for a word said over and over has them at any
    places: its codes alone, a byte a word, take such a word for another.
    """
    edge = WINDOW - 1
    reach = min_words - K - 3 * edge
    first, last = (-2 * edge, -edge) if reach >= 0 else (K - min_words, 0)
    near = places.select("class", (F.col("start") - min_words).alias("low"), (F.col("end") + min_words).alias("high"))
    inside = occurrences.join(near, "class").where("at >= low and at < high")
    run = Window.partitionBy("class").orderBy("at").rangeBetween(0, max(0, reach))
    kept = _kept(occurrences, inside).select(F.xxhash64(F.sort_array(F.collect_set("seed").over(run))).alias("seed"), "class", "at")
    kept = stored(kept, "window-seeds")
    coded = rows.select("class", "codes").join(kept.select("class").distinct(), "class", "left_semi").groupBy("class").agg(F.max("codes").alias("codes"))
    # Of the places where a window may begin, each once: those that the seed before gives go.
    before = F.lag("at").over(Window.partitionBy("class").orderBy("at"))
    low = F.greatest(F.col("at") + first, F.lit(0), F.coalesce(F.col("before") + last + 1, F.lit(0)))
    ranges = kept.withColumn("before", before).select("seed", "class", low.alias("low"), (F.col("at") + last).alias("high")).where("low <= high")
    starts = ranges.select("seed", "class", F.explode(F.sequence("low", "high")).alias("at"))
    window = F.substring(F.col("codes"), F.col("at") + 1, F.lit(min_words))
    cut = starts.join(coded, "class").select("seed", window.alias("window"), "class", "at").where(F.octet_length("window") == min_words)
    return stored(cut.select(F.xxhash64("window", "seed").alias("seed"), "class", "at"), "windows")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY) -> DataFrame:
    """Passages that a text shares with another: doc_id, start, end, partner_id, partner_start, partner_end, matched (words; end exclusive).

    Of texts with equal words, the one with the smallest doc_id stands for all;
    every other one has one row, its whole text, with that one as its partner.
    """
    texts = _texts(docs, id_col, text_col)
    rows = stored(_classes(texts).where(F.col("n_words") >= K), "passage-classes")
    classes = stored(rows.groupBy("class").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "passage-representatives")

    occurrences = rows.select("class", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select(F.col("s.seeds").alias("seed"), "class", F.col("s.places").alias("at"))
    with scratch(docs.sparkSession):
        matches, occurrences = _dealt(occurrences)
        found = _aligned(matches, rows, min_words, min_identity)
    single, left = occurrences, found.where(F.col("matched") == _FRAGMENTS)
    found = found.where(F.col("matched") != _FRAGMENTS)
    long = (F.col("end") - F.col("start")) >= min_words
    for r in range(ROUNDS + 1):
        # Short places need the windows only: the longer seeds of the rounds before are for fuzzy passages.
        with scratch(docs.sparkSession):
            places = stored(left.where(long) if r < ROUNDS else left, "places")
            if places.isEmpty():
                continue
            longer = _longer(occurrences, places) if r < ROUNDS else _windows(single, places, rows, min_words)
            matches, occurrences = _dealt(longer, places.select("class").distinct())
            again = _aligned(matches, rows, min_words, min_identity)
        found = found.union(again.where(F.col("matched") != _FRAGMENTS))
        left = left.where(~long).union(again.where(F.col("matched") == _FRAGMENTS))
    found = stored(found.distinct(), "found-passages")

    rep = classes.select("class", "rep")
    named = found.join(rep, "class").withColumnRenamed("rep", "doc_id").drop("class")
    partners = rep.select(F.col("class").alias("partner"), F.col("rep").alias("partner_id"))
    uses = found.groupBy("partner").agg(F.count("*").alias("n"))
    named = salted_lookup(named, partners.join(uses, "partner"), "partner", "n", F.xxhash64("doc_id", "start"))
    fuzzy = named.select("doc_id", "start", "end", "partner_id", F.col("other_start").alias("partner_start"), F.col("other_end").alias("partner_end"), "matched")
    copies = salted_lookup(rows.select("doc_id", "class", "n_words").where(F.col("n_words") >= min_words).distinct(), classes.where("n > 1"), "class", "n", F.xxhash64("doc_id")).where("rep is not null and doc_id <> rep")
    whole = F.col("n_words").cast("int")
    return fuzzy.unionByName(copies.select("doc_id", F.lit(0).alias("start"), whole.alias("end"), F.col("rep").alias("partner_id"), F.lit(0).alias("partner_start"), whole.alias("partner_end"), whole.alias("matched")))
