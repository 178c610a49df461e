"""Key sets: new rows, leakage guards, deduplication by key, unions and overlays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_rows(batch: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Rows whose key the ledger does not know; repeats inside the batch all stay."""
    return batch.join(ledger.select(key).distinct(), key, "left_anti")


def ledger_union(*keys: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, keys).distinct()


def union_same_schema(first: DataFrame, *others: DataFrame) -> DataFrame:
    """UNION ALL of tables that must have the same columns and types."""
    for other in others:
        if dict(first.dtypes) != dict(other.dtypes):
            raise ValueError(f"schemas differ: {first.dtypes} and {other.dtypes}")
    return reduce(DataFrame.unionByName, others, first)


def excluding(rows: DataFrame, column: str, *blocked: DataFrame, blocked_column: str = "id") -> DataFrame:
    """Rows whose id is in none of the blocked sets; ids are compared as strings, and a null never blocks."""
    ids = ledger_union(*[b.select(F.col(blocked_column).cast("string").alias("_blocked")) for b in blocked])
    return rows.join(ids, rows[column].cast("string") == F.col("_blocked"), "left_anti")


def exclusion_report(rows: DataFrame, kept: DataFrame, blocked: DataFrame, column: str, blocked_column: str = "id") -> DataFrame:
    """One row: rows before and after, blocked ids, blocked ids that were there, and whether the loss is exactly theirs."""
    before, after = rows.agg(F.count("*").alias("n_before")), kept.agg(F.count("*").alias("n_after"))
    ids = blocked.select(F.col(blocked_column).cast("string").alias("_blocked")).distinct()
    found = rows.select(F.col(column).cast("string").alias("_blocked")).join(ids, "_blocked", "left_semi").agg(F.count("*").alias("n_found"))
    sizes = ids.agg(F.count("*").alias("n_blocked"))
    # Four one-row tables side by side.
    joined = before.join(after).join(found).join(sizes)
    return joined.withColumn("exact", F.col("n_before") - F.col("n_after") == F.col("n_found"))


def require_exact_exclusion(report: DataFrame) -> None:
    row = report.first()
    if not row["exact"]:
        raise AssertionError(f"exclusion leaks: {row.asDict()}")


def _one_per_key(rows: DataFrame, keys: list[str], pick) -> DataFrame:
    # Keys are taken from the groups, so that a table bucketed by them stays so.
    return rows.groupBy(*keys).agg(pick.alias("_one")).select(*[F.col(c) if c in keys else F.col("_one")[c].alias(c) for c in rows.columns])


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, aggregated map-side, so a key may hold much of the table.

    order must be unique within a key for a reproducible result.
    """
    return _one_per_key(rows, keys, F.min_by(F.struct(*rows.columns), F.struct(*order)))


def last_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _one_per_key(rows, keys, F.max_by(F.struct(*rows.columns), F.struct(*order)))


def overlay(base: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Whole groups of base are replaced by incoming's."""
    return base.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def is_unique(rows: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, and whether every key occurs once."""
    counted = rows.agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys"))
    return counted.withColumn("is_unique", F.col("n_rows") == F.col("n_keys"))


def merge_without_repeats(first: DataFrame, second: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """first and what of second has a new key, and the repeats that were left out."""
    keys = first.select(key).distinct()
    return union_same_schema(first, second.join(keys, key, "left_anti")), second.join(keys, key, "left_semi")


def category_change(before: DataFrame, after: DataFrame, category: str) -> DataFrame:
    """Counts per category before and after, 0 where it is absent: one pass over the tagged union."""
    tagged = before.select(category, F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select(category, F.lit(0).alias("b"), F.lit(1).alias("a")))
    return tagged.groupBy(category).agg(F.sum("b").alias("n_before"), F.sum("a").alias("n_after"))
