"""Incremental ingest with Structured Streaming: a ledger of seen keys and a census whose months are replaced.

Every micro-batch is one published dump.  The census, which is small, is kept in versions, the
ledger in parts, each under the id of its batch; a batch reads only what lies
below its id, so one that is run again after a failure overwrites its own output and never reads it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.cascade import GateClosed
from ..operators.census import month_census, month_totals
from ..operators.sets import ledger_union, new_rows, overlay
from ..sources.readers import path_exists
from ..sources.sinks import replace_months


class VersionedTable:
    """A Parquet table of versions named by batch id; current(before) is the latest version below a batch id."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _versions(self) -> list[int]:
        if not path_exists(self.spark, self.folder):
            return []
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop)
        names = [f.getPath().getName() for f in files]
        return sorted(int(n[2:]) for n in names if n.startswith("v-") and path_exists(self.spark, f"{self.folder}/{n}/_SUCCESS"))

    def current(self, before: int | None = None) -> DataFrame:
        found = [v for v in self._versions() if before is None or v < before]
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/v-{found[-1]}") if found else self.spark.createDataFrame([], self.schema)

    def write(self, table: DataFrame, version: int) -> None:
        """Write a version; of the older ones, the last is kept for a batch that runs again."""
        table.write.mode("overwrite").parquet(f"{self.folder}/v-{version}")
        for old in [v for v in self._versions() if v < version][:-1]:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/v-{old}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class AppendedKeys(VersionedTable):
    """Keys seen so far, a part a batch with what was new to it; nothing is written twice."""

    def __init__(self, spark: SparkSession, folder: str, key: str):
        super().__init__(spark, folder, f"{key} string")

    def current(self, before: int | None = None) -> DataFrame:
        found = [f"{self.folder}/v-{v}" for v in self._versions() if before is None or v < before]
        return self.spark.read.schema(self.schema).parquet(*found) if found else self.spark.createDataFrame([], self.schema)

    def write(self, table: DataFrame, version: int) -> None:
        table.write.mode("overwrite").parquet(f"{self.folder}/v-{version}")


def run_ledger(stream: DataFrame, key: str, ledger: AppendedKeys, sink: Callable[[DataFrame, int], None], checkpoint: str, since: Column | None = None) -> StreamingQuery:
    """New rows of each batch go to the sink; repeats within a batch all stay, unlike with dropDuplicates.

    ``since``, a condition on the rows, bounds what is looked at and remembered, such as days after a cutoff.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch if since is None else batch.where(since)
        seen = ledger.current(batch_id)
        sink(new_rows(rows, seen, key), batch_id)
        ledger.write(ledger_union(new_rows(rows.select(key), seen, key)), batch_id)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


CENSUS_SCHEMA = "ym string, category string, n bigint"
TOTALS_SCHEMA = "ym string, n bigint, max_day int, complete boolean"


def run_census(stream: DataFrame, census: VersionedTable, totals: VersionedTable, checkpoint: str, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Rows (ym, day, category): a month of a later dump replaces the month as it was; ``after`` is called once a batch is in."""

    def step(batch: DataFrame, batch_id: int) -> None:
        census.write(overlay(census.current(batch_id), month_census(batch), "ym"), batch_id)
        totals.write(overlay(totals.current(batch_id), month_totals(batch), "ym"), batch_id)
        if after is not None:
            after(batch_id)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class MonthTable:
    """A Parquet table partitioned by month, of which a batch rewrites the months it brings and no other file."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def current(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.folder) if path_exists(self.spark, self.folder) else self.spark.createDataFrame([], self.schema)

    def replace(self, months: DataFrame) -> None:
        replace_months(months.repartition("ym"), self.folder)


def run_census_in_place(stream: DataFrame, census: MonthTable, totals: MonthTable, checkpoint: str) -> StreamingQuery:
    """run_census() on tables whose months are replaced in place: a batch costs what it brings, and one that runs again writes the same months."""

    def step(batch: DataFrame, _: int) -> None:
        census.replace(month_census(batch))
        totals.replace(month_totals(batch))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_chunks(stream: DataFrame, label: Callable[[DataFrame], DataFrame], gate: Callable[[DataFrame], bool], folder: str, checkpoint: str) -> StreamingQuery:
    """Label a stream of chunk files, one micro-batch each, resumable: finished chunks are in the checkpoint.

    The first chunk is the canary: where its labelled rows do not pass the gate, the
    query fails before the next chunk is paid for.  A chunk that runs again overwrites its own output.
    """

    def step(chunk: DataFrame, batch_id: int) -> None:
        spark, path = chunk.sparkSession, f"{folder.rstrip('/')}/chunk={batch_id}"
        label(chunk).write.mode("overwrite").parquet(path)
        if batch_id == 0 and not gate(spark.read.parquet(path)):
            raise GateClosed(path)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, group: str, watermark: str = "1 day", width: str = "1 day") -> DataFrame:
    """Counts per time window and group with a watermark, for feeds of single events; works on batches too."""
    source = events.withWatermark(ts, watermark) if events.isStreaming else events
    out = source.groupBy(F.window(ts, width).alias("w"), group).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), group, "n", "total")
