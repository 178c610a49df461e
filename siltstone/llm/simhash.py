"""SimHash near-duplicate detection over a byte-position inverted index with count filtering.

A document's fingerprint has 64 bits.  Two fingerprints with at most three
differing bits differ in at most three of their eight bytes, so they share at
least least five positional bytes.  Posting every fingerprint under each single byte
would give lists that grow with the corpus, so a posting holds four positional
bytes at once, for the 28 position sets of BLOCKS: two disjoint Steiner systems S(3, 4, 8), in
which any five positions hold exactly two of the sets and four positions at most one.  The
lists in which a pair meets are tallied: two, the guaranteed minimum, say that five
positional bytes are shared, one that only four are.  Pairs that reach the minimum
are verified bit by bit, others never are.  Lists longer than LIST_LIMIT are split, for pairs in
reach, over the eight half-bytes of the four bytes that they leave open, so no list needs to be cut.

Exact copies share a fingerprint and meet as one entry.  Edge cases: null and
empty texts have fingerprint zero and link like any other; repeated rows are
rows; a null doc_id never becomes a component id unless its whole component
has none; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import near_copies
from .common import components, free_name, row_key, scratch, settled, skew_lookup, stored

MAX_DISTANCE = 3
SHINGLE = 3
SEED = 42
#: The 4-subsets of 0..7 whose members XOR to zero, a Steiner system S(3, 4, 8): any three positions are missed by one of the sets.
SYSTEM = [b for b in combinations(range(8), 4) if b[0] ^ b[1] ^ b[2] ^ b[3] == 0]


def _disjoint(system: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """The image of a system under the first permutation of positions that leaves none of its sets."""
    for p in permutations(range(8)):
        image = [tuple(sorted(p[i] for i in b)) for b in system]
        if not set(image) & set(system):
            return image
    raise ValueError("no disjoint image")


#: Position sets of the postings, and the lists in which a pair with five positional bytes in common meets at least.
BLOCKS = SYSTEM + _disjoint(SYSTEM)
LEAST_LISTS = 2
LIST_LIMIT = 1000
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Majority of the bits of the XXH64 hashes of all word shingles, as an unsigned integer."""
    words = (text or b"").lower().split()  # bytes: lower() and split() see ASCII only
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    if n < shingle:
        spans = [(0, len(line))]
    else:
        size = np.fromiter(map(len, words), dtype=np.int64, count=n)
        end = np.cumsum(size + 1) - 1
        spans = list(zip((end - size)[: n - shingle + 1].tolist(), end[shingle - 1 :].tolist(), strict=True))
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(spans), _CHUNK):
        hashes = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in spans[i : i + _CHUNK]], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(spans)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc_id, fp) per row of docs: the row's key and its fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            found = np.fromiter((fingerprint(x.as_py()) for x in texts), dtype=np.uint64, count=len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["key", "doc_id", "fp"])

    pruned = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return pruned.mapInArrow(run, "key binary, doc_id long, fp long")


def _field(x: Column, position: int, bits: int) -> Column:
    """The position-th field of that many bits, from the most significant."""
    return F.shiftrightunsigned(x, 64 - bits * (position + 1)).bitwiseAND(F.lit((1 << bits) - 1))


def _joined(fields: list[Column], bits: int) -> Column:
    key = F.lit(0).cast("long")
    for f in fields:
        key = F.shiftleft(key, bits).bitwiseOR(f)
    return key


def _postings(fps: DataFrame) -> DataFrame:
    fp = F.col("fp")
    keys = [F.struct(F.lit(i).alias("block"), _joined([_field(fp, p, 8) for p in b], 8).alias("key")) for i, b in enumerate(BLOCKS)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("e")).select("fp", "e.block", "e.key")


def _split(postings: DataFrame) -> DataFrame:
    """Entries of long lists, under each half-byte set of the four bytes that their list leaves open."""
    fp = F.col("fp")
    rest = F.lit(None).cast("long")
    for i, b in enumerate(BLOCKS):
        left = [p for p in range(8) if p not in b]
        rest = F.when(F.col("block") == i, F.shiftleft(_joined([_field(fp, p, 8) for p in left], 8), 32)).otherwise(rest)
    keys = [F.struct(F.lit(i).alias("part"), _joined([_field(F.col("rest"), p, 4) for p in b], 4).alias("subkey")) for i, b in enumerate(SYSTEM)]
    open_bytes = postings.withColumn("rest", rest)
    return open_bytes.select("fp", "block", "key", F.explode(F.array(*keys)).alias("e")).select("fp", "block", "key", "e.part", "e.subkey")


def candidates(fps: DataFrame, list_limit: int = LIST_LIMIT) -> DataFrame:
    """Pairs (u, v), u < v, of distinct fingerprints fp that meet in LEAST_LISTS lists or more."""
    postings = stored(_postings(fps), "postings")
    counts = postings.groupBy("block", "key").count()
    lists = counts.where("count > 1").select("block", "key", (F.col("count") > list_limit).alias("long_list"))
    met = postings.join(lists, ["block", "key"])
    short = met.where("not long_list").select("fp", "block", "key", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("subkey"))
    entries = short.unionByName(_split(met.where("long_list").drop("long_list")))
    a, b = entries.withColumnRenamed("fp", "u"), entries.withColumnRenamed("fp", "v")
    meetings = a.join(b, ["block", "key", "part", "subkey"]).where("u < v").select("u", "v", "block")
    # A pair may meet in several parts of a split list, which count as one.
    return meetings.groupBy("u", "v").agg(F.countDistinct("block").alias("lists")).where(F.col("lists") >= LEAST_LISTS).select("u", "v")


def links(fps: DataFrame, list_limit: int = LIST_LIMIT) -> DataFrame:
    """Pairs (u, v), u < v, of distinct fingerprints fp with at most MAX_DISTANCE differing bits."""
    return candidates(fps, list_limit).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_DISTANCE)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: key, doc_id, fp (signed), fingerprint (16 hex digits) and component_id, the smallest doc_id reachable."""
    rows = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "classes")
    roots = components(links(classes.select("fp")))
    joined = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    table = joined.join(least, "root").select("fp", "component_id", "n")
    out = skew_lookup(rows, table, "fp", "n", F.xxhash64("doc_id"))
    return out.select("key", "doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """One row of every component of docs, all columns: the one with the smallest id.

    With ``similarity``, near copies are the texts of that Jaccard similarity of their five-word shingles: the links of the fingerprints
    are verified by it, and pairs that differ in more bits are added from a positional index over shingle buckets (near_copies), so none is lost.
    """
    if similarity is not None:
        with scratch(docs.sparkSession):
            prints = settled(fingerprints(docs, id_col, text_col).select("key", "fp"), "fingerprints")
            found = settled(links(prints.select("fp").distinct()), "fingerprint-links")
        return near_copies.deduplicate(docs, id_col, text_col, similarity=similarity, prints=prints, links=found)
    name = free_name(docs, "key")
    with scratch(docs.sparkSession):
        rows = stored(near_duplicates(docs, id_col, text_col).drop("fingerprint"), "near-duplicates")
        group = F.coalesce(F.concat(F.lit("i"), F.col("component_id")), F.concat(F.lit("f"), F.col("fp")))
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
        kept = settled(rows.groupBy(group.alias("g")).agg(first.alias("k")).select(F.col("k.key").alias(name)), "kept-rows")
    marked = docs.withColumn(name, row_key(id_col, text_col))
    # Rows alike in id and text share a key; one of them stays.
    return marked.join(kept, name, "left_semi").dropDuplicates([name]).select(*docs.columns)
