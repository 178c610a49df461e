"""Sinks: Parquet, dated copies, summaries, sorted line files, keyed upserts."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sets import last_per_key
from ..session import fresh_path


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_dated(df: DataFrame, folder: str, stamp: str) -> str:
    """An immutable copy under its date; ``latest.txt`` beside it is replaced to name it."""
    path = f"{folder.rstrip('/')}/{stamp}"
    df.write.mode("error").parquet(path)
    df.sparkSession.createDataFrame([(stamp,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder.rstrip('/')}/latest")
    return path


def write_summary(summary: dict, path: str) -> None:
    """One JSON object, replaced atomically on the driver."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(target.name + ".part")
    part.write_text(json.dumps(summary, indent=2, default=str))
    os.replace(part, target)


def write_sorted_lines(keys: DataFrame, path: str, column: str = "key") -> None:
    """Distinct keys in order; range partitions keep the files in order without one task for all."""
    keys.select(F.col(column).alias("value")).where("value is not null").distinct().orderBy("value").write.mode("overwrite").text(path)


def replace_folder(df: DataFrame, write: Callable[[DataFrame, str], None], path: str) -> None:
    """Write df beside path and put it in path's place once it is whole; a write that fails leaves path as it was.

    A reader sees the old folder or the new one; between the two renames it sees none.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    mark = uuid.uuid4().hex[:12]
    new, old, target = name(f"{path}.new-{mark}"), name(f"{path}.old-{mark}"), name(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    write(df, f"{path}.new-{mark}")
    if files.exists(target) and not files.rename(target, old):
        raise OSError(f"cannot move {path} away")
    if not files.rename(new, target):
        files.rename(old, target)
        raise OSError(f"cannot put the new {path} in place")
    files.delete(old, True)


def upsert_json_lines(log: DataFrame, update: DataFrame, path: str, key: str = "cmplid") -> DataFrame:
    """Rows of log (which may be read from path) replaced by those of update with the same key, written as JSON lines; the log as it is now."""
    merged = last_per_key(log.withColumn("_seq", F.lit(0)).unionByName(update.withColumn("_seq", F.lit(1)), allowMissingColumns=True), [key], ["_seq"]).drop("_seq")
    replace_folder(merged, lambda df, to: df.write.json(to), path)
    return merged.sparkSession.read.schema(merged.schema).json(path)


def write_bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """df as a table bucketed and sorted by key, each bucket one file; tables with as many buckets join and group by the key without a shuffle.

    The table gets a name of its own in the session's catalogue and its files a new folder among the shared ones; drop_bucketed() forgets it.
    """
    path = fresh_path(df.sparkSession, name)
    table = f"{name.replace('-', '_')}_{path.rsplit('-', 1)[-1]}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)


def drop_bucketed(spark: SparkSession, prefix: str) -> int:
    """Forget the bucketed tables whose names begin with prefix; how many there were. Their files stay with the shared folder."""
    found = [t.name for t in spark.catalog.listTables() if t.name.startswith(prefix.replace("-", "_") + "_") and not t.isTemporary]
    for t in found:
        spark.sql(f"drop table if exists {t}")
    return len(found)


def replace_months(df: DataFrame, path: str, month: str = "ym") -> None:
    """Write whole months into a table partitioned by month: months of df replace theirs, the files of all others are not touched."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(month).parquet(path)


def copy_if_other(spark: SparkSession, source: str, target: str) -> bool:
    """Copy a file under another name, unless one as long and as new is there; whether it was copied."""
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    a, b = name(source), name(target)
    files = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(b):
        x, y = files.getFileStatus(a), files.getFileStatus(b)
        if x.getLen() == y.getLen() and x.getModificationTime() <= y.getModificationTime():
            return False
    return spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(files, a, files, b, False, True, spark.sparkContext._jsc.hadoopConfiguration())
