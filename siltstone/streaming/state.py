"""Keyed state in the state store: keys seen so far, and the drift rule as a state machine a series.

A batch touches only the state of the keys it brings, so its cost does not grow with what was
seen before.  State lives in RocksDB on the executors and in the query's checkpoint; a query that starts again goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from math import log, sqrt
from statistics import mean, stdev

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructField, StructType

from ..functions.exprs import windows_at
from ..operators.census import COMPLETE_DAY
from ..operators.drift import LAST_N, PRIOR_MONTHS, SIGMAS

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class SeenKeys(StatefulProcessor):
    """Rows of a key that no earlier batch had; repeats within a batch all stay."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        if not self.seen.exists():
            self.seen.update((True,))
            yield from rows

    def close(self) -> None:
        pass


def unseen(stream: DataFrame, key: str) -> DataFrame:
    """Rows of the stream whose key is new to the state; a null key is a key."""
    return stream.groupBy(key).transformWithState(SeenKeys(), stream.schema, "Append", "None")


def run_keyed_ledger(stream: DataFrame, key: str, sink: Callable[[DataFrame, int], None], checkpoint: str, since: Column | None = None) -> StreamingQuery:
    """The ledger with keyed state instead of a table of keys: new rows of each batch go to the sink; ``since`` bounds what is looked at and remembered."""
    rows = stream if since is None else stream.where(since)
    with rocksdb(stream.sparkSession):
        return unseen(rows, key).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class MixRule(StatefulProcessor):
    """The two-month drift rule of one series.

    State: a row a month with its category counts and largest day, which a later dump replaces; the pool and the
    line, made anew only when a month of their windows changed; the month that fired, until it is re-armed.
    ``rearm_ms`` after a fire a timer clears it, at the next batch then, and the rule watches months after it only.
    """

    def __init__(self, as_of: str, last_n: int = LAST_N, prior_months: int = PRIOR_MONTHS, sigmas: float = SIGMAS, rearm_ms: int | None = None):
        self.as_of, self.sigmas, self.rearm_ms = as_of, sigmas, rearm_ms
        w = windows_at(as_of, last_n, prior_months)
        self.pool_window, self.line_window = (w["pool_start"], w["pool_end"]), (w["last_start"], w["last_end"])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.months = handle.getMapState("months", "ym string", "n bigint, max_day int, distance double, counts map<string,bigint>")
        self.pool = handle.getValueState("pool", "counts map<string,bigint>")
        self.line = handle.getValueState("line", "threshold double")
        self.fired = handle.getValueState("fired", "month string, silent boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        came: dict[str, dict[str, int]] = {}
        days: dict[str, int] = {}
        for r in rows:
            came.setdefault(r["ym"], {})[r["category"]] = r["n"]
            days[r["ym"]] = max(days.get(r["ym"], 0), r["max_day"] or 0)
        inside = lambda ym, window: window[0] <= ym <= window[1]
        for ym, counts in came.items():
            self.months.updateValue((ym,), (sum(counts.values()), days[ym], None, counts))
        known = {k[0]: v for k, v in self.months.iterator()}
        if any(inside(ym, self.pool_window) for ym in came) or not self.pool.exists():
            pool: dict[str, int] = {}
            for ym, (_, _, _, counts) in known.items():
                if inside(ym, self.pool_window):
                    for c, n in counts.items():
                        pool[c] = pool.get(c, 0) + n
            self.pool.update((pool,))
            measure = known  # the pool is another one: all months are measured anew
        else:
            pool = self.pool.get()[0]
            measure = {ym: known[ym] for ym in came}
        for ym, (n, day, _, counts) in measure.items():
            known[ym] = (n, day, distance(counts, pool), counts)
            self.months.updateValue((ym,), known[ym])
        if measure is known or any(inside(ym, self.line_window) for ym in came) or not self.line.exists():
            d = [v[2] for ym, v in known.items() if inside(ym, self.line_window)]
            self.line.update(((mean(d) if d else 0.0) + self.sigmas * (stdev(d) if len(d) > 1 else 0.0),))
        found = self._first(known, self.line.get()[0])
        if found is not None:
            self.fired.update((found[0], True))
            if self.rearm_ms is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.rearm_ms)
            yield Row(series=key[0], month=found[0], previous_month=found[1])

    def _first(self, known: dict[str, tuple], threshold: float) -> tuple[str, str] | None:
        """The first complete month after the anchor, or after the last fire, that trips right after a complete one that does."""
        month, silent = self.fired.get() if self.fired.exists() else (None, False)
        if silent:
            return None
        walked = sorted(ym for ym, v in known.items() if ym > (month or self.as_of) and v[1] >= COMPLETE_DAY)
        trips = [known[ym][2] > threshold for ym in walked]
        return next(((b, a) for a, b, x, y in zip(walked, walked[1:], trips, trips[1:], strict=False) if x and y), None)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        self.fired.update((self.fired.get()[0], False))
        yield from ()

    def close(self) -> None:
        pass


def distance(counts: dict[str, int], pool: dict[str, int]) -> float:
    """Jensen-Shannon distance of two counts of categories; absent ones count 0."""
    n, m = sum(counts.values()), sum(pool.values())
    total = 0.0
    for c in counts.keys() | pool.keys():
        p, q = (counts.get(c, 0) / n if n else 0.0), (pool.get(c, 0) / m if m else 0.0)
        middle = max((p + q) / 2, 1e-12)
        total += sum(0.5 * x * log(x / middle) for x in (p, q) if x > 0)
    return sqrt(max(0.0, total))


def run_mix_rule(census: DataFrame, rule: MixRule, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Fires (series, month, previous_month) of a stream of census rows (series, ym, category, n, max_day), a dump a batch."""
    schema = StructType([StructField("series", census.schema["series"].dataType), *StructType.fromDDL("month string, previous_month string")])
    mode = "None" if rule.rearm_ms is None else "ProcessingTime"
    with rocksdb(census.sparkSession):
        fires = census.groupBy("series").transformWithState(rule, schema, "Append", mode)
        # A query that waits for timers is never done with what is available, so it takes one batch at a time.
        when = {"availableNow": True} if rule.rearm_ms is None else {"once": True}
        return fires.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**when).start()


def dump_census(rows: DataFrame, series: Column) -> DataFrame:
    """What a dump's rows (ym, day, category) feed to the rule: a row a month and category, so no task sees a month's rows."""
    counts = rows.groupBy(series.alias("series"), "ym", "category").agg(F.count("*").alias("n"), F.max("day").alias("max_day"))
    return counts.select("series", "ym", "category", "n", "max_day")
