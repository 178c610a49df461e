"""Replays of a finished feed through the incremental pipeline, for checks of batch against stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.drift import mix_rule
from ..session import fresh_path
from .incremental import CENSUS_SCHEMA, TOTALS_SCHEMA, AppendedKeys, MonthTable, VersionedTable, run_census, run_census_in_place, run_ledger, windowed_counts
from .state import MixRule, dump_census, run_keyed_ledger, run_mix_rule


def _fed(dumps: list[DataFrame], folder: str, run: Callable[[DataFrame], StreamingQuery]) -> None:
    """Publish dumps one after the other and run the stream after each: one micro-batch a dump, state in the checkpoint."""
    spark = dumps[0].sparkSession
    for dump in dumps:
        dump.write.mode("append").parquet(f"{folder}/feed")
        run(spark.readStream.schema(dump.schema).parquet(f"{folder}/feed")).awaitTermination()


def replay_census(dumps: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """census (ym, category, n) and totals of dumps with rows (ym, day, category), built by the stream; a later dump replaces its months."""
    spark = dumps[0].sparkSession
    folder = fresh_path(spark, "stream-census")
    census, totals = VersionedTable(spark, f"{folder}/census", CENSUS_SCHEMA), VersionedTable(spark, f"{folder}/totals", TOTALS_SCHEMA)
    _fed(dumps, folder, lambda rows: run_census(rows, census, totals, f"{folder}/checkpoint"))
    return census.current(), totals.current()


def replay_ledger(dumps: list[DataFrame], key: str, since: Column | None = None) -> DataFrame:
    """The rows of all dumps that were new when they arrived, with the number of their batch."""
    spark = dumps[0].sparkSession
    folder = fresh_path(spark, "stream-ledger")
    ledger = AppendedKeys(spark, f"{folder}/ledger", key)
    sink = lambda new, batch: new.write.mode("overwrite").parquet(f"{folder}/new/batch={batch}")
    _fed(dumps, folder, lambda rows: run_ledger(rows, key, ledger, sink, f"{folder}/checkpoint", since))
    return spark.read.parquet(f"{folder}/new")


def replay_fire(dumps: list[DataFrame], as_of: str, last_n: int, prior_months: int) -> list[dict | None]:
    """The first fire after each dump, as the stream's census had it then."""
    spark = dumps[0].sparkSession
    folder = fresh_path(spark, "stream-fire")
    census, totals = VersionedTable(spark, f"{folder}/census", CENSUS_SCHEMA), VersionedTable(spark, f"{folder}/totals", TOTALS_SCHEMA)
    fires: list[dict | None] = []

    def after(_: int) -> None:
        row = mix_rule(census.current(), totals.current(), as_of, last_n, prior_months)["fire"].first()  # one row
        fires.append(row.asDict() if row else None)

    _fed(dumps, folder, lambda rows: run_census(rows, census, totals, f"{folder}/checkpoint", after))
    return fires


def replay_counts(events: DataFrame, ts: str, group: str) -> DataFrame:
    """windowed_counts() of a feed of single events, run as a stream."""
    spark = events.sparkSession
    folder = fresh_path(spark, "stream-counts")

    def run(rows: DataFrame) -> StreamingQuery:
        write = lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/counts")
        counted = windowed_counts(rows, ts, group)
        return counted.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()

    _fed([events], folder, run)
    return spark.read.parquet(f"{folder}/counts")


def _one_by_one(folder: str, name: str) -> Callable[[DataFrame, int], None]:
    return lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")


def replay_keyed_ledger(dumps: list[DataFrame], key: str, since: Column | None = None) -> DataFrame:
    """replay_ledger() with the keys in the state store; the query starts again from its checkpoint for every dump."""
    spark = dumps[0].sparkSession
    folder = fresh_path(spark, "keyed-ledger")
    _fed(dumps, folder, lambda rows: run_keyed_ledger(rows, key, _one_by_one(folder, "new"), f"{folder}/checkpoint", since))
    return spark.read.parquet(f"{folder}/new")


def replay_mix_rule(dumps: list[DataFrame], rule: MixRule, series: Column) -> DataFrame:
    """(batch, series, month, previous_month): fires of dumps with rows (ym, day, category), as the state machine gave them."""
    spark = dumps[0].sparkSession
    folder = fresh_path(spark, "mix-rule")
    _fed([dump_census(d, series) for d in dumps], folder, lambda rows: run_mix_rule(rows, rule, _one_by_one(folder, "fires"), f"{folder}/checkpoint"))
    return spark.read.parquet(f"{folder}/fires").select("batch", "series", "month", "previous_month")


def replay_census_in_place(dumps: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """replay_census() on tables partitioned by month."""
    spark = dumps[0].sparkSession
    folder = fresh_path(spark, "month-census")
    census, totals = MonthTable(spark, f"{folder}/census", CENSUS_SCHEMA), MonthTable(spark, f"{folder}/totals", TOTALS_SCHEMA)
    _fed(dumps, folder, lambda rows: run_census_in_place(rows, census, totals, f"{folder}/checkpoint"))
    return census.current(), totals.current()
