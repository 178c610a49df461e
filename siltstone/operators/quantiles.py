"""Exact quantiles by distributed selection: sketches bound the wanted values, counted passes narrow the bounds.

A round sketches what lies inside the bounds (KLL, merged map-side), takes the sketch's
values on either side of the wanted ranks as new bounds, and counts the rows below, at and between them; the
counts are exact, so a bound that the sketch put wrongly is not taken over.  Once at most ``most`` different values are left
inside, they are counted by value and the ranks are read off.  Equal values are one
throughout, so a value may hold most rows; no task sees more than ``most`` values of a group.

Nulls take no part; NaN counts as the largest value, equal to infinity; a group without values has a null quantile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import settled

#: Different values of a group that a task may see.
MOST = 10_000
#: Accuracy of a sketch; the ranks it is asked for, and how many of their steps it may be wrong by.
SKETCH_K, STEPS, MARGIN = 400, 100, 2
#: Groups whose bounds are broadcast at most; beyond, they are joined by a shuffle.
BROADCAST_GROUPS = 10_000


def exact_quantile(rows: DataFrame, value: str, share: float, groups: list[str] | None = None, name: str = "quantile", most: int = MOST) -> DataFrame:
    """(groups..., name): the interpolated quantile of each group; of all rows, one row, without groups."""
    keys = [f"_g{i}" for i in range(len(groups or []))] or ["_g0"]
    of = [F.col(g) for g in groups or []] or [F.lit(0)]
    tagged = rows.select(*[c.alias(k) for c, k in zip(of, keys, strict=True)], F.nanvl(F.col(value).cast("double"), F.lit(float("inf"))).alias("_v"))
    values = tagged.where("_v is not null")
    same = lambda table: [F.col(f"r.{k}").eqNullSafe(F.col(f"{table}.{k}")) for k in keys]

    # n rows; ranks r1 and r2 (from 1) are wanted; the rest goes to interpolation.
    at = F.lit(float(share)) * (F.col("n") - 1)
    whole = values.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    state = whole.select(*keys, "n", "lo", "hi", (F.floor(at) + 1).alias("r1"), (F.ceil(at) + 1).alias("r2"), (at - F.floor(at)).alias("rest"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    state = settled(state.withColumn("done", F.col("lo") == F.col("hi")), "quantile-bounds")
    wide = state.count() > BROADCAST_GROUPS
    side = (lambda df: df) if wide else F.broadcast

    def inside(condition: str = "not done") -> DataFrame:
        joined = values.alias("r").join(side(state.where(condition)).alias("s"), [*same("s"), F.col("r._v").between(F.col("s.lo"), F.col("s.hi"))])
        return joined.select(*[F.col(f"r.{k}").alias(k) for k in keys], "_v", "n", "lo", "hi", "r1", "r2", "rest", "below", "inside")

    while not state.where("not done").isEmpty():
        sized = inside().groupBy(*keys).agg(F.approx_count_distinct("_v").alias("values"), F.kll_sketch_agg_double("_v", F.lit(SKETCH_K)).alias("sketch"))
        met = state.where("not done").join(sized, [state[k].eqNullSafe(sized[k]) for k in keys]).select(*[state[k] for k in keys], "n", "lo", "hi", "r1", "r2", "rest", "below", "inside", "values", "sketch")
        grid = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)]))
        step = lambda r: (F.col(r) - F.col("below")) / F.col("inside") * STEPS
        a = F.get("grid", F.greatest(F.lit(0), F.floor(step("r1") - MARGIN)).cast("int"))
        b = F.get("grid", F.least(F.lit(STEPS), F.ceil(step("r2") + MARGIN)).cast("int"))
        tried = met.withColumn("few", F.col("values") <= most // 2).withColumn("grid", grid).withColumn("a", F.greatest("lo", a)).withColumn("b", F.least("hi", b)).drop("sketch", "grid")
        state_before, state = state, settled(tried.withColumn("done", F.lit(False)), "quantile-tries")
        counted = _narrowed(inside("not few"), state.where("not few"), keys, side)
        finished = _counted_by_value(inside("few"), keys)
        kept = [*keys, "n", "lo", "hi", "r1", "r2", "rest", "below", "inside", "done"]
        rest = state_before.where("done").select(*kept)
        state = settled(rest.unionByName(counted.select(*kept)).unionByName(finished.select(*kept)), "quantile-bounds")
    # lo and hi are the values at r1 and r2 now; infinities do not interpolate.
    quantile = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("rest"))
    found = state.select(*keys, quantile.alias("_q"))
    every = tagged.select(*keys).distinct() if groups else rows.sparkSession.range(1).select(F.lit(0).alias("_g0"))
    out = every.alias("r").join(found.alias("f"), same("f"), "left")
    return out.select(*[F.col(f"r.{k}").alias(g) for k, g in zip(keys, groups or [], strict=False)], F.col("f._q").alias(name))


def _narrowed(rows: DataFrame, state: DataFrame, keys: list[str], side) -> DataFrame:
    """The bounds of the tries where the exact counts bear them out; a value that holds a wanted rank becomes the bound itself."""
    v, tries = F.col("r._v"), state.select(*keys, "a", "b")
    joined = rows.alias("r").join(side(tries).alias("t"), [F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys])
    a, b = F.col("t.a"), F.col("t.b")
    # The smallest value above a bound and the largest one below it let each bound move past its own value.
    counts = joined.groupBy(*[F.col(f"r.{k}").alias(k) for k in keys]).agg(
        *[F.first(f"r.{c}").alias(c) for c in ("n", "lo", "hi", "r1", "r2", "rest", "below", "inside")], F.first(a).alias("a"), F.first(b).alias("b"),
        F.count_if(v < a).alias("under_a"), F.count_if(v <= a).alias("upto_a"), F.count_if(v < b).alias("under_b"), F.count_if(v <= b).alias("upto_b"),
        F.min(F.when(v > a, v)).alias("after_a"), F.max(F.when(v < b, v)).alias("before_b"),
    )
    r1, r2 = F.col("r1") - F.col("below"), F.col("r2") - F.col("below")
    at_a, above_a, at_b, below_b = r1 > F.col("under_a"), r1 > F.col("upto_a"), r2 <= F.col("upto_b"), r2 <= F.col("under_b")
    lo = F.when(above_a, F.col("after_a")).when(at_a, F.col("a")).otherwise(F.col("lo"))
    hi = F.when(below_b, F.col("before_b")).when(at_b, F.col("b")).otherwise(F.col("hi"))
    cut = F.when(above_a, F.col("upto_a")).when(at_a, F.col("under_a")).otherwise(F.lit(0))
    left = F.when(below_b, F.col("under_b")).when(at_b, F.col("upto_b")).otherwise(F.col("inside"))
    # r1 at the lower bound's value and r2 at the upper one's: nothing between them matters.
    met = at_a & ~above_a & at_b & ~below_b
    return counts.select(*keys, "n", lo.alias("lo"), hi.alias("hi"), "r1", "r2", "rest", (F.col("below") + cut).alias("below"), (left - cut).alias("inside"), (met | (lo == hi)).alias("done"))


def _counted_by_value(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Both values of groups with few different ones left, by running counts over those."""
    state = ["n", "r1", "r2", "rest", "below", "inside"]
    by_value = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_c"), *[F.first(c).alias(c) for c in state])
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("below")
    ranked = by_value.withColumn("_upto", upto)
    pick = lambda r: F.min(F.when(F.col("_upto") >= F.col(r), F.col("_v")))
    return ranked.groupBy(*keys).agg(*[F.first(c).alias(c) for c in state], pick("r1").alias("lo"), pick("r2").alias("hi")).withColumn("done", F.lit(True))


def exact_median(rows: DataFrame, value: str, groups: list[str] | None = None, name: str = "median", most: int = MOST) -> DataFrame:
    return exact_quantile(rows, value, 0.5, groups, name, most)
