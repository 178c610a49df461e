"""Category-mix drift: monthly distances to a pool, a threshold from the last months, a walk, and the first fire.

Categories that neither side has add nothing to the distance, so sparse joins
replace dense vectors over the universe.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import js_divergence, month_series, shift_month, windows_at
from ..session import settled

LAST_N = 24
PRIOR_MONTHS = 240
SIGMAS = 2.0


def pool_mix(census: DataFrame, start: str, end: str) -> DataFrame:
    """(category, pool_n, q) of the months from start to end."""
    pool = census.where(F.col("ym").between(start, end)).groupBy("category").agg(F.sum("n").alias("pool_n"))
    return pool.withColumn("q", F.try_divide(F.col("pool_n").cast("double"), F.sum("pool_n").over(Window.partitionBy()).cast("double")))


def distances(census: DataFrame, totals: DataFrame, pool: DataFrame) -> DataFrame:
    """(ym, n, distance) per month with rows: the Jensen-Shannon distance of its mix to the pool's; 0 for an empty pool."""
    months = totals.where("n > 0").select("ym", F.col("n").alias("month_n"))
    rows = census.join(months, "ym").join(pool.select("category", "q"), "category", "left")
    rows = rows.select("ym", "month_n", (F.col("n") / F.col("month_n")).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    met = rows.groupBy("ym", F.col("month_n").alias("n")).agg(js_divergence(F.col("p"), F.col("q")).alias("js"), F.sum("q").alias("met"))
    # A category of the pool that a month lacks adds q / 2 * ln 2, so no month needs to be paired with all categories.
    whole = pool.agg(F.coalesce(F.sum("q"), F.lit(0.0)).alias("whole"))  # one row: 1, or 0 for an empty pool
    distance = F.sqrt(F.greatest(F.lit(0.0), F.col("js") + F.lit(math.log(2) / 2) * (F.col("whole") - F.col("met"))))
    return met.join(F.broadcast(whole)).select("ym", "n", F.when(F.col("whole") > 0, distance).otherwise(F.lit(0.0)).alias("distance"))


def threshold(dist: DataFrame, start: str, end: str, sigmas: float = SIGMAS) -> DataFrame:
    """One row (mean, sd, threshold) over the months from start to end; sd of fewer than two is 0."""
    inside = dist.where(F.col("ym").between(start, end))
    out = inside.agg(F.coalesce(F.avg("distance"), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_samp("distance"), F.lit(0.0)).alias("sd"))
    return out.withColumn("threshold", F.col("mean") + F.lit(sigmas) * F.col("sd"))


def walk(spark: SparkSession, dist: DataFrame, totals: DataFrame, line: DataFrame, after: str) -> DataFrame:
    """All calendar months after ``after`` up to the last one: (month, n, distance, max_day, complete, trip)."""
    last = totals.agg(F.max("ym").alias("last"))
    months = last.select(F.explode(month_series(F.lit(shift_month(after, 1)), F.col("last"))).alias("month"))
    t = totals.select(F.col("ym").alias("month"), F.col("n"), "max_day")
    d = dist.select(F.col("ym").alias("month"), "distance")
    out = months.join(t, "month", "left").join(d, "month", "left").join(F.broadcast(line.select("threshold")))
    complete = F.coalesce(F.col("max_day") >= 28, F.lit(False))
    return out.select("month", F.coalesce("n", F.lit(0)).alias("n"), "distance", "max_day", complete.alias("complete"), F.coalesce(F.col("distance") > F.col("threshold"), F.lit(False)).alias("trip"))


def first_fire(steps: DataFrame) -> DataFrame:
    """(month, previous_month) of the first complete month that trips right after another complete one in the list; empty if none.

    steps has one row a month.
    """
    order = Window.orderBy("month")
    marked = steps.where("complete").select("month", "trip", F.lag("trip").over(order).alias("before"), F.lag("month").over(order).alias("previous_month"))
    return marked.where("trip and before").orderBy("month").limit(1).select("month", "previous_month")


def walk_summary(steps: DataFrame) -> DataFrame:
    """One row: n_over counts every trip, n_over_complete those of complete months, n_partial the others."""
    count = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    trip, complete = F.col("trip"), F.col("complete")
    return steps.agg(count(trip).alias("n_over"), count(trip & complete).alias("n_over_complete"), count(trip & ~complete).alias("n_partial"))


def mix_rule(census: DataFrame, totals: DataFrame, as_of: str, last_n: int = LAST_N, prior_months: int = PRIOR_MONTHS) -> dict[str, DataFrame]:
    """The whole rule at an anchor month: pool, distances, line, walk, fire, summary.

    Census, totals and distances, a row a month and category at most, are written once, so no part looks at the rows again.
    """
    census, totals = settled(census, "census"), settled(totals, "totals")
    return _mix_rule(census, totals, as_of, last_n, prior_months)


def _mix_rule(census: DataFrame, totals: DataFrame, as_of: str, last_n: int, prior_months: int) -> dict[str, DataFrame]:
    w = windows_at(as_of, last_n, prior_months)
    pool = pool_mix(census, w["pool_start"], w["pool_end"])
    dist = settled(distances(census, totals, pool), "distances")
    line = threshold(dist, w["last_start"], w["last_end"])
    steps = walk(census.sparkSession, dist, totals, line, as_of)
    return {"pool": pool, "distances": dist, "line": line, "walk": steps, "fire": first_fire(steps), "summary": walk_summary(steps)}


def slide(census: DataFrame, totals: DataFrame, as_of: str, last_n: int = LAST_N, prior_months: int = PRIOR_MONTHS) -> list[dict]:
    """Fires one after the other: after each, the rule is anchored anew at the month of the fire."""
    census, totals = settled(census, "census"), settled(totals, "totals")
    fires: list[dict] = []
    while (row := _mix_rule(census, totals, as_of, last_n, prior_months)["fire"].first()) is not None:  # one row
        fires.append({"as_of": as_of, "month": row["month"], "previous_month": row["previous_month"]})
        as_of = row["month"]
    return fires


def from_rows(rows: DataFrame, day: Column, category: Column) -> tuple[DataFrame, DataFrame]:
    """census and totals of raw rows with a yyyymmdd day."""
    from ..functions.exprs import day_of, month_of
    from .census import month_census, month_totals

    keyed = rows.select(month_of(day).alias("ym"), day_of(day).alias("day"), category.alias("category"))
    return month_census(keyed), month_totals(keyed)
