"""Near copies by Jaccard similarity of word shingles: the positional index with count filtering of SimHash, over shingle buckets.

Near copies at similarity 0.8 differ in about ten of a SimHash's 64 bits, in any of its
bytes, so no shared byte is guaranteed.  Here a text's positions are buckets instead:

1. A text is the set of the hashes of its SHINGLE-word shingles (ASCII lower case, ASCII
   white space); shorter texts are one shingle.  Texts with equal sets form a class.
2. The range of hashes is cut into buckets whose number depends on the size class of the
   set, and a set is posted under the contents of every bucket that holds two shingles or
   more.  Sets of similarity s differ in at most (1 - s) / (1 + s) of both sizes, so most of
   those differences fall into few buckets, and the number of buckets is chosen so that
   EXPECTED positions agree at s; a pair with fewer than LEAST (probability about 3e-6 at s,
   and far less above) is the only one that can be missed.  A set is posted in its own and in the next
   size class, so partners of another size meet it.
3. Count filtering: a set with fewer than LEAST shared positions has no partner; of the others
   all but the LEAST - 1 commonest are kept, among which a pair with LEAST must still meet.
4. Sets of at most SMALL / s shingles are posted by single shingles, the rarest n - ceil(s n) + 1 of each, with the number
   of rarer ones: two sets have nothing in common before the rarest shingle they share, which bounds what they share (no pair is missed).
5. Pairs that a SimHash index linked before (simhash.deduplicate) are taken with those of the lists.
   Classes that meet are verified by their sets: first each with the most typical class it
   meets (whose shingles are the commonest), then what is left apart, pair by pair.  Components of all links are groups of near copies.

Edge cases: null and blank texts have the empty set and are copies of each other; a null
doc_id is kept only if its whole group has none; an empty table gives an empty result;
ties go to the smaller id; other columns are kept, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import components, free_name, row_key, scratch, settled, skew_lookup, stored
from .substring import Seeder

SHINGLE = 5
SIMILARITY = 0.8
#: Sets with at most so many shingles as the smaller of a pair are posted by single shingles.
SMALL = 256
#: Positions that agree at the least similarity, on average, and the number that a pair must share.
EXPECTED, LEAST = 18, 3
#: Keys of rows to verify that are broadcast at most (16 bytes each).
BROADCAST_KEYS = 100_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes | None, seeder: Seeder, size: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of all word shingles, in ascending (unsigned) order."""
    words = (text or b"").lower().split()  # bytes: lower() and split() see ASCII only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    code = seeder.codes(words)
    size = min(size, len(words))
    rolled = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for j in range(size):
        rolled = rolled * _FACTOR + code[j : len(words) - size + 1 + j]
    return np.unique(_mixed(rolled))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@cache
def size_classes(similarity: float) -> list[int]:
    """The largest size of each size class; a partner of a set is in the same class or in one beside it."""
    out = [SMALL]
    while out[-1] < 1 << 40:
        out.append(int(out[-1] / similarity) + 1)
    return out


def agreeing(buckets: int, total: float, similarity: float) -> float:
    """Buckets of two shingles or more that agree, on average, for two sets of that similarity with ``total`` shingles together."""
    unlike = (1 - similarity) / (1 + similarity) * total
    alike = (total - unlike) / 2 / buckets
    return buckets * exp(-unlike / buckets) * (1 - exp(-alike) * (1 + alike))


@cache
def buckets_of(size_class: int, similarity: float, expected: float = EXPECTED) -> int:
    """The least number of buckets that gives the largest and the smallest pair of a size class ``expected`` agreeing positions."""
    most = size_classes(similarity)[size_class]
    totals = (2 * most, (similarity + similarity**2) * most)
    for k in range(2, most):
        if min(agreeing(k, t, similarity) for t in totals) >= expected:
            return k
    return max(range(2, most), key=lambda k: min(agreeing(k, t, similarity) for t in totals))


def positions(h: np.ndarray, similarity: float) -> np.ndarray:
    """What a set (ascending hashes) is posted under: one hash for each bucket of two shingles or more, in both size classes."""
    if len(h) <= SMALL:
        return np.zeros(0, dtype=np.uint64)
    own = bisect_left(size_classes(similarity), len(h))
    out = []
    for size_class in (own, own + 1):
        bucket = ((h >> np.uint64(32)) * np.uint64(buckets_of(size_class, similarity))) >> np.uint64(32)
        start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        several = np.diff(np.r_[start, len(h)]) > 1
        out.append(_mixed(np.add.reduceat(h, start)[several] + np.array([size_class], dtype=np.uint64) * _FACTOR))
    return np.concatenate(out)


def _column(found: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype=np.uint64), *found]).view(np.int64)))


def _posted(texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """key, doc_id, class, n, the positions of the set, and the set itself where it is small, of every row of (key, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeder, none = Seeder(), np.zeros(0, dtype=np.uint64)
        for batch in batches:
            found = [shingles(t.as_py(), seeder, size) for t in batch.column(2).cast(pa.binary())]
            ids = np.array([xxh3_64_intdigest(h.tobytes()) for h in found], dtype=np.uint64).view(np.int64)
            small = [h if len(h) * similarity <= SMALL else none for h in found]
            columns = [batch.column(0), batch.column(1), pa.array(ids), pa.array([len(h) for h in found], pa.int32()), _column([positions(h, similarity) for h in found]), _column(small)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "class", "n", "at", "h"])

    return texts.mapInArrow(run, "key binary, doc_id long, class long, n int, at array<long>, h array<long>")


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """class and whole set of every row of (key, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeder = Seeder()
        for batch in batches:
            found = [shingles(t.as_py(), seeder, size) for t in batch.column(2).cast(pa.binary())]
            ids = np.array([xxh3_64_intdigest(h.tobytes()) for h in found], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), _column(found)], ["class", "h"])

    return texts.mapInArrow(run, "class long, h array<long>")


def _weight() -> Column:
    """How typical a class is: how often what it holds occurs."""
    return F.aggregate("s", F.lit(0).cast("long"), lambda a, e: a + e["df"]).alias("weight")


def _large_lists(rows: DataFrame) -> DataFrame:
    """(entry, class, n, at, weight): the positions under which classes of large sets may meet."""
    posted = rows.select("class", "n", F.explode("at").alias("entry"))
    mark = F.hash("entry", "class")  # two classes of an entry differ in it, for all but a 2^-32 of entries
    met = posted.groupBy("entry").agg(F.min(mark).alias("a"), F.max(mark).alias("b"), F.count("*").alias("w")).where("a < b")
    met = stored(met.select("entry", "w", F.col("w").alias("df")), "met-positions")
    held = skew_lookup(posted, met, "entry", "w", F.xxhash64("class")).where("df is not null").distinct()
    order = F.array_sort(F.collect_list(F.struct("df", "entry")))  # at most as many as the text has shingles
    per = held.groupBy("class", "n").agg(order.alias("s")).where(F.size("s") >= LEAST)
    per = per.select("class", "n", _weight(), F.explode(F.slice("s", F.lit(1), F.size("s") - (LEAST - 1))).alias("e"))
    return per.select("e.entry", "class", "n", F.lit(0).alias("at"), "weight")  # buckets have no order: nothing is known of what lies before


def _small_lists(rows: DataFrame, similarity: float) -> DataFrame:
    """(entry, class, n, at, weight): the rarest shingles of classes of small sets, with the number of shingles that are rarer; those of one class alone need not be posted."""
    small = rows.where(F.size("h") > 0).dropDuplicates(["class"])
    entries = small.select("class", "n", F.explode("h").alias("entry"))
    counts = stored(entries.groupBy("entry").agg(F.count("*").alias("w")).where("w > 1").withColumn("df", F.col("w")), "shingle-counts")
    held = skew_lookup(entries, counts, "entry", "w", F.xxhash64("class")).where("df is not null")
    need = F.ceil(F.col("n") * F.lit(similarity) - F.lit(1e-9)).cast("int")
    order = F.array_sort(F.collect_list(F.struct("df", "entry")))
    per = held.groupBy("class", "n").agg(order.alias("s")).where(F.size("s") >= need)
    per = per.select("class", "n", _weight(), (F.col("n") - F.size("s")).alias("alone"), F.posexplode(F.slice("s", F.lit(1), F.size("s") - need + 1)).alias("k", "e"))
    return per.select("e.entry", "class", "n", (F.col("alone") + F.col("k")).alias("at"), "weight")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (u, v) of classes whose sets have at least that similarity."""
    pairs = stored(pairs.distinct(), "near-pairs")
    for side in ("u", "v"):
        weights = pairs.groupBy(F.col(side)).agg(F.count("*").alias("w"))
        table = sets.select(F.col("class").alias(side), F.col("h").alias(f"h_{side}")).join(weights, side)
        pairs = skew_lookup(pairs, table, side, "w", F.xxhash64("u", "v"))
    both = F.size(F.array_intersect("h_u", "h_v"))
    return pairs.where(both >= F.lit(similarity) * (F.size("h_u") + F.size("h_v") - both) - F.lit(1e-9)).select("u", "v")


def _fits(a: Column, b: Column, similarity: float) -> Column:
    return F.least(a, b) >= F.lit(similarity) * F.greatest(a, b) - F.lit(1e-9)


def _reaches(n: str, at: str, other: str, similarity: float) -> Column:
    """Whether a set of n shingles without its ``at`` rarest ones can have enough in common with a set of ``other`` shingles."""
    return F.col(n) - F.col(at) >= F.lit(similarity / (1 + similarity)) * (F.col(n) + F.col(other)) - F.lit(1e-6)


def _apart(lists: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    """The rows of lists (entry, class, ...) that links leave in several groups, with their root."""
    rooted = stored(lists.join(roots, lists["class"] == roots["node"], "left").select(*lists.columns, F.coalesce("root", "class").alias("root")), name)
    several = rooted.groupBy("entry").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("w")).where("a < b").select("entry", "w", F.lit(True).alias("several"))
    return skew_lookup(rooted, several, "entry", "w", F.xxhash64("class")).where("several").drop("several")


def groups(texts: DataFrame, rows: DataFrame, linked: DataFrame | None = None, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root): the components of all pairs of classes of at least that similarity; linked (u, v): pairs of classes found before, to be verified."""
    lists = stored(_large_lists(rows).unionByName(_small_lists(rows, similarity)), "near-lists")
    # The most typical member of a list is the one that most others are near to.
    typical = F.max(F.struct("weight", "class", "n"))
    ends = lists.groupBy("entry").agg(typical.alias("c"), F.min("class").alias("a"), F.max("class").alias("b"), F.count("*").alias("w")).where("a < b")
    ends = stored(ends.select("entry", "w", F.col("c.weight").alias("c_weight"), F.col("c.class").alias("c_class"), F.col("c.n").alias("c_n")), "near-ends")
    lists = stored(skew_lookup(lists, ends, "entry", "w", F.xxhash64("class")).where("c_class is not null"), "met-lists")
    met = lists.select("class")
    if linked is not None:
        met = met.union(linked.select("u")).union(linked.select("v"))
    met = met.distinct()
    picked = stored(rows.groupBy("class").agg(F.min("key").alias("key")).join(met, "class", "left_semi").select("key"), "near-keys")
    if picked.count() <= BROADCAST_KEYS:
        picked = F.broadcast(picked)
    sets = stored(_sets(texts.join(picked, "key", "left_semi").dropDuplicates(["key"]), size), "shingle-sets")

    # Every class with the most typical one that it meets, and what was linked before.
    fits = _fits(F.col("n"), F.col("c_n"), similarity) & (F.col("c_class") != F.col("class"))
    pair = lambda a, b: (F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    near = lists.where(fits).groupBy("class").agg(F.max(F.struct("c_weight", "c_class")).alias("c"))
    near = near.select(*pair("class", "c.c_class"))
    near = stored(_verified(near if linked is None else near.union(linked.select(*pair("u", "v"))), sets, similarity), "first-links")
    roots = components(near)
    # What is still apart, pair by pair, where the shingles from the shared one on are enough.
    apart = stored(_apart(lists.select("entry", "class", "n", "at"), roots, "first-roots"), "first-apart").select("entry", "class", "n", "at", "root")
    a, b = apart.toDF("entry", "u", "n_u", "at_u", "root_u"), apart.toDF("entry", "v", "n_v", "at_v", "root_v")
    enough = _fits(F.col("n_u"), F.col("n_v"), similarity) & _reaches("n_u", "at_u", "n_v", similarity) & _reaches("n_v", "at_v", "n_u", similarity)
    rest = a.join(b, "entry").where((F.col("u") < F.col("v")) & (F.col("root_u") != F.col("root_v")) & enough)
    rest = stored(_verified(rest.select("u", "v"), sets, similarity), "last-links")
    return roots if rest.isEmpty() else components(near.union(rest))


def linked_classes(rows: DataFrame, prints: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs (u, v) of classes whose fingerprints are equal or linked; prints: (key, fp) of every row of rows (key, class), links: (u, v) of fingerprints."""
    held = rows.select("key", "class").distinct().join(prints.select("key", "fp").distinct(), "key").select("fp", "class").distinct()
    held = stored(held, "print-classes")
    first = held.groupBy("fp").agg(F.min("class").alias("first"))
    equal = held.join(first, "fp").where(F.col("class") != F.col("first")).select(F.col("first").alias("u"), F.col("class").alias("v"))
    a, b = first.toDF("u", "first_u"), first.toDF("v", "first_v")
    near = links.join(a, "u").join(b, "v").where(F.col("first_u") != F.col("first_v")).select(F.col("first_u").alias("u"), F.col("first_v").alias("v"))
    return stored(equal.union(near).distinct(), "linked-classes")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY, prints: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """One row of every group of near copies, all columns: the one with the smallest id.

    prints (key, fp) and links (u, v) of fingerprints, where given, are pairs found by another index; they are verified like any other.
    """
    name = free_name(docs, "key")
    with scratch(docs.sparkSession):
        texts = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        rows = stored(_posted(texts, size, similarity), "shingle-positions")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
        classes = stored(rows.groupBy("class").agg(first.alias("k")), "shingle-classes")
        linked = linked_classes(rows, prints, links) if prints is not None and links is not None else None
        roots = groups(texts, rows, linked, size, similarity)
        joined = classes.join(roots, classes["class"] == roots["node"], "left").select(F.coalesce("root", "class").alias("root"), "k")
        kept = settled(joined.groupBy("root").agg(F.min("k").alias("k")).select(F.col("k.key").alias(name)), "kept-rows")
    marked = docs.withColumn(name, row_key(id_col, text_col))
    # Rows alike in id and text share a key; one of them stays.
    return marked.join(kept, name, "left_semi").dropDuplicates([name]).select(*docs.columns)
