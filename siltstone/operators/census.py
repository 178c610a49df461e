"""Monthly census: counts per month and category, month totals, replacement of whole months, JSON at the edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPLETE_DAY = 28
SCHEMA_ID = "month-census/1"


def month_census(rows: DataFrame, ym: str = "ym", category: str = "category") -> DataFrame:
    """(ym, category, n)."""
    return rows.groupBy(ym, category).agg(F.count("*").alias("n"))


def month_totals(rows: DataFrame, ym: str = "ym", day: str = "day") -> DataFrame:
    """(ym, n, max_day, complete): a month is complete once a late enough day was seen."""
    out = rows.groupBy(ym).agg(F.count("*").alias("n"), F.max(day).alias("max_day"))
    return out.withColumn("complete", F.col("max_day") >= COMPLETE_DAY)


def census_grouping_sets(rows: DataFrame, ym: str = "ym", category: str = "category", day: str = "day") -> DataFrame:
    """Both levels in one pass: rows per (ym, category), and per ym with a null category; is_total tells them apart."""
    out = rows.groupingSets([[ym, category], [ym]], ym, category).agg(F.count("*").alias("n"), F.max(day).alias("max_day"), F.grouping(category).alias("_g"))
    return out.withColumn("is_total", F.col("_g") == 1).drop("_g")


def universe(census: DataFrame, category: str = "category") -> DataFrame:
    return census.select(category).distinct()


def to_document(census: DataFrame, totals: DataFrame, source: str, cutoff: str, built_at: str) -> DataFrame:
    """The nested document of the whole census, one row; its size is months times categories."""
    counts = census.groupBy("ym").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("counts"))
    months = totals.join(counts, "ym", "left").select("ym", F.struct("n", "max_day", "counts").alias("m"))
    # Months hold maps, which have no order: only ym is compared.
    by_month = F.array_sort(F.collect_list(F.struct("ym", "m")), lambda a, b: F.when(a["ym"] < b["ym"], -1).when(a["ym"] > b["ym"], 1).otherwise(0))
    whole = months.agg(F.map_from_entries(by_month).alias("months"))
    names = universe(census).agg(F.array_sort(F.collect_set("category")).alias("universe"))
    envelope = F.struct(F.lit(SCHEMA_ID).alias("schema"), F.lit(source).alias("source"), F.lit(cutoff).alias("cutoff"), F.lit(built_at).alias("built_at"), "universe", "months")
    return whole.join(names).select(F.to_json(envelope).alias("document"))


def from_document(documents: DataFrame, column: str = "document") -> tuple[DataFrame, DataFrame]:
    """census (ym, category, n) and totals (ym, n, max_day) of a document."""
    shape = "struct<months: map<string, struct<n: bigint, max_day: int, counts: map<string, bigint>>>>"
    months = documents.select(F.from_json(column, shape).alias("d")).select(F.explode("d.months").alias("ym", "m"))
    totals = months.select("ym", F.col("m.n").alias("n"), F.col("m.max_day").alias("max_day"))
    return months.select("ym", F.explode("m.counts").alias("category", "n")), totals.withColumn("complete", F.col("max_day") >= COMPLETE_DAY)
