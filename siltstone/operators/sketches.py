"""Sketches of key sets and samples that are kept beside a table and merged batch by batch.

Bloom filter: a key sets BITS_PER_KEY bits of one block of 32,768; a block is a row (bucket, bits) made by the
bitmap aggregates, so filters are built and merged map-side and a probe is one lookup.  A key that
the filter does not know is surely new; only the others need the anti join with the ledger.

Bottom-k sample: per part (a month) the n rows that come first in hash order; the first n of any parts'
samples are the sample of their union, so no part is read again.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import stratified_sample, uniform_sample

BLOCK_BITS = 32_768  # of a bitmap aggregate
BITS_PER_KEY = 6
#: Room for each key, in bits: about one stranger in a hundred is taken for known.
ROOM = 12
#: Blocks (4 KiB each) that are broadcast at most; beyond, a probe is dealt by block.
BROADCAST_BLOCKS = 16_384


def block_count(keys: int) -> int:
    return max(1, ceil(keys * ROOM / BLOCK_BITS))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("long"))


def _bits(key: Column) -> Column:
    """Places of a key's bits in its block, from two hashes."""
    a, b = F.xxhash64(key, F.lit(1)), F.xxhash64(key, F.lit(2)).bitwiseOR(F.lit(1))
    steps = [F.pmod(F.shiftright(a, 3).bitwiseXOR(F.shiftrightunsigned(b, 4 * i)), F.lit(BLOCK_BITS).cast("long")) for i in range(BITS_PER_KEY)]
    return F.array(*steps)


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(bucket, bits) of all keys; null is no key."""
    set_bits = keys.where(F.col(key).isNotNull()).select(_block(F.col(key), blocks).alias("bucket"), F.explode(_bits(F.col(key))).alias("_at"))
    return set_bits.groupBy("bucket").agg(F.bitmap_construct_agg("_at").alias("bits"))


def merged(*filters: DataFrame) -> DataFrame:
    """One filter of the keys of several with as many blocks."""
    return reduce(DataFrame.unionByName, filters).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def probed(rows: DataFrame, key: str, filter_: DataFrame, blocks: int, name: str = "maybe") -> DataFrame:
    """rows with a column that is false where the key is surely in none of the filter's keys."""
    side = F.broadcast(filter_) if blocks <= BROADCAST_BLOCKS else filter_
    met = rows.withColumn("_bucket", _block(F.col(key), blocks)).join(side.withColumnsRenamed({"bucket": "_bucket", "bits": "_blocks_bits"}), "_bucket", "left")

    def is_set(at: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col("_blocks_bits"), F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(at, F.lit(8)))), F.lit(2)) == 1

    known = F.forall(_bits(F.col(key)), is_set)
    return met.withColumn(name, F.col(key).isNotNull() & F.col("_blocks_bits").isNotNull() & F.coalesce(known, F.lit(False))).drop("_bucket", "_blocks_bits")


def new_rows_by_sketch(batch: DataFrame, ledger: DataFrame, key: str, filter_: DataFrame, blocks: int) -> DataFrame:
    """new_rows() of a batch, where rows that the filter does not know skip the join with the ledger."""
    marked = probed(batch, key, filter_, blocks, "_maybe")
    sure = marked.where("not _maybe").drop("_maybe")
    return sure.unionByName(marked.where("_maybe").drop("_maybe").join(ledger.select(key).distinct(), key, "left_anti"))


def bottom_k(rows: DataFrame, part: str, n: int, key: str, seed: int) -> DataFrame:
    """The n rows of each part that come first in hash order: a sample that merges."""
    return stratified_sample(rows, part, n, key, seed)


def merged_sample(samples: list[DataFrame], n: int, key: str, seed: int) -> DataFrame:
    """The uniform sample of n rows over the union of what the bottom-k samples were taken from."""
    return uniform_sample(reduce(DataFrame.unionByName, samples), n, key, seed)


def false_positive_rate(strangers: DataFrame, key: str, filter_: DataFrame, blocks: int) -> DataFrame:
    """One row: keys that are in none of the filter's, and how many of them the filter takes for known."""
    marked = probed(strangers, key, filter_, blocks)
    return marked.agg(F.count("*").alias("n_strangers"), F.count_if("maybe").alias("n_taken"))

