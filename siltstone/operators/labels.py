"""Closed label sets from histograms: coverage, assignment, incident groups, class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import OTHER

COVERAGE = 0.99
MAX_CLASSES = 35


def histogram(rows: DataFrame, label: str) -> DataFrame:
    """(label, n), largest first, ties by label."""
    return rows.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label)


def label_coverage(counts: DataFrame, label: str, coverage: float = COVERAGE, max_classes: int = MAX_CLASSES) -> DataFrame:
    """(label, n, rank, cum, kept): the head of the histogram that reaches the coverage, max_classes at most.

    counts has one row a label, so its window in one task is bounded by the label set.
    """
    order = Window.orderBy(F.desc("n"), F.asc(label))
    cum = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(Window.partitionBy())
    ranked = counts.select(label, "n", F.row_number().over(order).alias("rank"), cum.alias("cum"))
    n_keep = F.least(F.lit(max_classes), F.sum((F.col("cum") < coverage).cast("int")).over(Window.partitionBy()) + 1)
    return ranked.withColumn("kept", F.col("rank") <= n_keep)


def assign_labels(rows: DataFrame, coverage: DataFrame, label: str, out: str = "label", other: str = OTHER) -> DataFrame:
    """Column out: the label where it was kept, else the bucket; at most MAX_CLASSES kept labels are broadcast."""
    keep = coverage.where("kept").select(F.col(label).alias("_keep"))
    return rows.join(F.broadcast(keep), F.col(label) == F.col("_keep"), "left").withColumn(out, F.coalesce("_keep", F.lit(other))).drop("_keep")


def group_size(rows: DataFrame, group: str, size: str = "group_size", flag: str = "multi_row") -> DataFrame:
    """Rows of each row's group, and whether there are several.

    Counted before the join, so a group that holds much of the table is
    pre-aggregated and the adaptive join can split it.
    """
    counts = rows.groupBy(group).agg(F.count("*").alias(size))
    return rows.join(counts, group, "left").withColumn(size, F.coalesce(size, F.lit(0))).withColumn(flag, F.col(size) > 1)


def multi_row_share(rows: DataFrame, group: str) -> DataFrame:
    """One row: rows, rows that share their group, their share."""
    counts = rows.groupBy(group).agg(F.count("*").alias("n"))
    out = counts.agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("n_multi"))
    return out.withColumn("multi_share", F.col("n_multi") / F.col("n_rows"))


def class_weights(rows: DataFrame, label: str, universe: DataFrame | None = None) -> DataFrame:
    """Balanced weights n / (k * n_c) over present classes; 1.0 for absent classes of the universe."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    present = counts.withColumn("weight", F.sum("n").over(Window.partitionBy()) / (F.count("*").over(Window.partitionBy()) * F.col("n")))
    if universe is None:
        return present
    return universe.select(label).distinct().join(present, label, "left").select(label, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("weight", F.lit(1.0)).alias("weight"))


def upper_median(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """The element at n div 2 (from 0) of each group's sorted values.

    Values are counted first, so a group is held as its distinct values.
    """
    counts = rows.groupBy(*group, value).agg(F.count("*").alias("_c"))
    order = Window.partitionBy(*group).orderBy(value)
    cum = F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("_cum", cum).withColumn("_at", F.floor(F.sum("_c").over(Window.partitionBy(*group)) / 2))
    return placed.where("_cum > _at").groupBy(*group).agg(F.min(value).alias("upper_median"))
