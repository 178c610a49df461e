"""Deterministic sampling: rows are ordered by the md5 of their key and a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import hash_order


def uniform_sample(rows: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """n rows without replacement (a distributed top-n, no full sort)."""
    return rows.orderBy(hash_order(F.col(key), seed), key).limit(n)


#: Up to this cap the planner keeps only the best rows of each task before a group meets (spark.sql.optimizer.windowGroupLimitThreshold).
SMALL_CAP = 1000
#: Hex digits of the hash that deal a group into pieces.
PIECE_DIGITS = 3


def stratified_sample(rows: DataFrame, group: str | list[str], cap: int, key: str, seed: int) -> DataFrame:
    """At most cap rows of every group, the first in hash order.

    With a cap above SMALL_CAP a group is ranked in pieces by the head of its hashes: pieces
    that lie wholly beyond the cap go before any row is sorted, and no task sees a whole group.
    """
    groups = [group] if isinstance(group, str) else group
    if cap <= SMALL_CAP:
        order = Window.partitionBy(*groups).orderBy(hash_order(F.col(key), seed), F.col(key))
        return rows.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= cap).drop("_rn")
    return _in_pieces(rows, groups, key, seed, F.col("_before") < cap).where(F.col("_before") + F.col("_rn") <= cap).select(*rows.columns)


def _in_pieces(rows: DataFrame, groups: list[str], key: str, seed: int, wanted: Column | None = None) -> DataFrame:
    """rows with _before (rows of the group in earlier pieces), _size (of the group) and _rn (rank inside the piece), in hash order."""
    tagged = rows.withColumn("_h", hash_order(F.col(key), seed)).withColumn("_b", F.substring("_h", 1, PIECE_DIGITS))
    sizes = tagged.groupBy(*groups, "_b").agg(F.count("*").alias("_n"))
    by_group = Window.partitionBy(*groups)
    before = F.coalesce(F.sum("_n").over(by_group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    names = [f"_group_{i}" for i in range(len(groups))]
    offsets = sizes.select(*[F.col(g).alias(n) for g, n in zip(groups, names, strict=True)], F.col("_b").alias("_piece"), before.alias("_before"), F.sum("_n").over(by_group).alias("_size"))
    if wanted is not None:
        offsets = offsets.where(wanted)
    same = tagged["_b"] == offsets["_piece"]
    for g, n in zip(groups, names, strict=True):
        same = same & tagged[g].eqNullSafe(offsets[n])
    placed = tagged.join(offsets, same).drop("_piece", *names)
    return placed.withColumn("_rn", F.row_number().over(Window.partitionBy(*groups, "_b").orderBy("_h", key)))


def remainder_sample(rows: DataFrame, taken: DataFrame, condition: Column, n: int, key: str, seed: int) -> DataFrame:
    """n more rows that satisfy a condition, none of them taken before."""
    return uniform_sample(rows.where(condition).join(taken.select(key), key, "left_anti"), n, key, seed)


def train_val_split(rows: DataFrame, label: str, key: str, seed: int, val_share: float = 0.15) -> DataFrame:
    """Column split: val for the first val_share of every class in hash order, by rounding up; a class of one row trains.

    A class is ranked in 4096 pieces by the head of its hashes, so no task sees a whole class.
    """
    placed = _in_pieces(rows, [label], key, seed)
    is_val = (F.col("_size") > 1) & (F.col("_before") + F.col("_rn") <= F.ceil(F.col("_size") * F.lit(val_share)))
    return placed.withColumn("split", F.when(is_val, F.lit("val")).otherwise(F.lit("train"))).select(*rows.columns, "split")


def readable_sample(rows: DataFrame, text: str, n: int, key: str, seed: int, low: int = 150, high: int = 450, group: str | None = None) -> DataFrame:
    """n rows (of every group) of readable length; of any length where fewer than n are readable."""
    readable = F.coalesce(F.length(text).between(low, high), F.lit(False))
    if group is None:
        enough = rows.where(readable).limit(n).count() >= n
        return uniform_sample(rows.where(readable) if enough else rows, n, key, seed)
    # The first n readable and the first n other rows of a group tell whether n are readable, and hold what is taken either way.
    best = stratified_sample(rows.withColumn("_readable", readable), [group, "_readable"], n, key, seed)
    enough = F.count_if("_readable").over(Window.partitionBy(group)) >= n
    pool = best.withColumn("_enough", enough).where(~F.col("_enough") | F.col("_readable")).drop("_enough", "_readable")
    return stratified_sample(pool, group, n, key, seed)


def positions(rows: DataFrame, order: list[str], bucket: Column) -> DataFrame:
    """Column position, from 1 in order.

    bucket must grow with the order; rows are numbered inside their bucket, after the
    rows of all earlier buckets, so no task sees more than one bucket's rows.
    """
    tagged = rows.withColumn("_bucket", bucket)
    sizes = tagged.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = tagged.withColumn("_rn", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)))
    return inside.join(offsets, "_bucket").withColumn("position", F.col("_before") + F.col("_rn")).drop("_bucket", "_before", "_rn")


def canary_chunks(rows: DataFrame, order: list[str], bucket: Column, canary: int = 250, chunk: int = 4000) -> DataFrame:
    """Columns position and chunk: 0 for the first ``canary`` rows, then 1, 2, ... of ``chunk`` rows each."""
    number = F.when(F.col("position") <= canary, F.lit(0)).otherwise(F.floor((F.col("position") - canary - 1) / chunk) + 1)
    return positions(rows, order, bucket).withColumn("chunk", number.cast("int"))
