"""Comparing two dumps: on their unstable ids, and on fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import changed, shortened
from .sets import first_per_key


def id_sets(new: DataFrame, old: DataFrame, key: str, day: str) -> DataFrame:
    """One row: new ids; old ids inside the new dump's days; added (in no old row at all); removed and common (inside the window)."""
    window = new.agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    old_days = old.select(F.col(key).alias("_k"), F.col(day).alias("_d")).join(F.broadcast(window))
    old_ids = old_days.groupBy("_k").agg(F.max(F.col("_d").between(F.col("_lo"), F.col("_hi"))).alias("in_window"))
    new_ids = new.select(F.col(key).alias("_k")).distinct().withColumn("is_new", F.lit(True))
    both = new_ids.join(old_ids, "_k", "full_outer")
    is_new, in_old, inside = F.col("is_new").isNotNull(), F.col("in_window").isNotNull(), F.coalesce("in_window", F.lit(False))
    return both.agg(F.count_if(is_new).alias("n_new"), F.count_if(inside).alias("n_old_window"), F.count_if(is_new & ~in_old).alias("n_added"), F.count_if(inside & ~is_new).alias("n_removed"), F.count_if(inside & is_new).alias("n_common"))


def field_changes(new: DataFrame, old: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, n_changed) over all ids that both dumps have, in or out of the window."""
    a = new.select(key, *[F.col(f).alias(f"_new_{f}") for f in fields])
    pairs = a.join(old.select(key, *fields), key)
    sums = pairs.agg(*[F.count_if(changed(F.col(f"_new_{f}"), F.col(f))).alias(f) for f in fields])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n_changed")) for f in fields])).alias("r")).select("r.*")


def change_examples(new: DataFrame, old: DataFrame, key: str, field: str, n: int = 8) -> DataFrame:
    a = new.select(key, F.col(field).alias("new_value"))
    pairs = a.join(old.select(key, F.col(field).alias("old_value")), key)
    return pairs.where(changed(F.col("new_value"), F.col("old_value"))).orderBy(key).limit(n)


def _paired(new: DataFrame, old: DataFrame, fp: str, order: list[str], columns: list[str]) -> DataFrame:
    a = first_per_key(new, [fp], order).select(fp, F.lit(True).alias("_in_new"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    b = first_per_key(old, [fp], order).select(fp, F.lit(True).alias("_in_old"), *columns)
    return a.join(b, fp, "full_outer")


def revision_audit(new: DataFrame, old: DataFrame, fp: str, order: list[str], columns: list[str], hashed: bool = False) -> DataFrame:
    """One row: fingerprints in both, only in new, only in old, and per column how many of the common ones changed.

    Only the compared columns are shuffled, by the hash of the fingerprint; with ``hashed``, fp is that hash, and nothing is where the dumps are bucketed by it.
    """
    names = list(dict.fromkeys([*order, *columns]))
    new, old = (rows.select(fp if hashed else F.sha2(fp, 256).alias(fp), *names) for rows in (new, old))
    pairs = _paired(new, old, fp, order, columns)
    both = F.col("_in_new").isNotNull() & F.col("_in_old").isNotNull()
    counts = [F.count_if(both & changed(F.col(f"_new_{c}"), F.col(c))).alias(f"n_changed_{c}") for c in columns]
    return pairs.agg(F.count_if(both).alias("n_common"), F.count_if(F.col("_in_old").isNull()).alias("n_only_new"), F.count_if(F.col("_in_new").isNull()).alias("n_only_old"), *counts)


def revision_examples(new: DataFrame, old: DataFrame, fp: str, order: list[str], column: str, text: str, n: int = 6, chars: int = 180) -> DataFrame:
    names = list(dict.fromkeys([fp, *order, column, text]))
    pairs = _paired(new.select(*names), old.select(*names), fp, order, [column, text]).where("_in_new is not null and _in_old is not null")
    rows = pairs.where(changed(F.col(f"_new_{column}"), F.col(column))).orderBy(fp).limit(n)
    return rows.select(fp, F.col(column).alias("old_value"), F.col(f"_new_{column}").alias("new_value"), shortened(F.col(text), chars).alias("text"))


def date_range(rows: DataFrame, day: str) -> DataFrame:
    """One row: smallest and largest day, null for no rows."""
    return rows.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))
