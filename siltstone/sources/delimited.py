"""Projected scan of delimited text: wanted fields by their place, without parsing the others.

Lines are read as bytes and decoded as Latin-1, a line's separators are counted, and it is split no
further than the last wanted field.  A line with too many fields is dropped, one with too few
is padded with blanks, and both are known by the count alone, so no column is read for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import COMPLAINT_COLUMNS


def field_count(line: Column, separator: str = "\t") -> Column:
    return F.length(line) - F.length(F.translate(line, separator, "")) + 1


def scan_fields(spark: SparkSession, path: str, wanted: list[str], columns: list[str] | None = None, separator: str = "\t", keep_broken: bool = False) -> DataFrame:
    """The wanted columns, in the order asked for; empty lines are no rows.

    With keep_broken all lines stay, and a column ``n_fields`` says how many fields each has.
    """
    names = list(columns or COMPLAINT_COLUMNS)
    places = [names.index(w) for w in wanted]
    raw = spark.read.text(path).select(F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("_line")).where(F.col("_line") != "")
    limit = max(places, default=0) + 2  # the last part holds the rest of the line unparsed
    lines = raw.select(F.split("_line", f"\\Q{separator}\\E" if len(separator) > 1 else separator, limit).alias("_fields"), field_count(F.col("_line"), separator).alias("n_fields"))
    if not keep_broken:
        lines = lines.where(F.col("n_fields") <= len(names))
    fields = [F.coalesce(F.get("_fields", i), F.lit("")).alias(w) for w, i in zip(wanted, places, strict=True)]
    return lines.select(*fields, *(["n_fields"] if keep_broken else []))


def broken_lines(spark: SparkSession, path: str, columns: list[str] | None = None, separator: str = "\t") -> DataFrame:
    """(kind, n): lines that fit, are short or are over-long, from their separators alone."""
    n = len(columns or COMPLAINT_COLUMNS)
    counted = scan_fields(spark, path, [], columns, separator, keep_broken=True)
    kind = F.when(F.col("n_fields") > n, F.lit("long")).when(F.col("n_fields") < n, F.lit("short")).otherwise(F.lit("fit"))
    return counted.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
