"""Shared helpers: the shared folder, written intermediate tables, skew-safe lookups, components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path, shared_dir

# A key that holds at least one row in HOT_SHARE counts as hot, so no table has
# more than HOT_SHARE hot keys and broadcasting them is bounded.
HOT_SHARE = 1000
# One task joins so many rows of a key at ease, so keys with fewer are never hot.
HOT_ROWS = 10_000
SALTS = 64
ARROW_ROWS = 2000

#: Paths of the tables stored inside each open scratch(), the innermost last.
_SCRATCH: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    return _stored_at(df, fresh_path(df.sparkSession, name))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored inside are deleted at its end; what is read later is written by settled() and lasts as long as the scratch() around this one."""
    paths: list[str] = []
    token = _SCRATCH.set((*_SCRATCH.get(), paths))
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for path in paths:
            remove_path(spark, path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Rows go to Python in batches of at most ARROW_ROWS: long texts then take little memory on either side."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= ARROW_ROWS:
        yield
        return
    spark.conf.set(name, str(ARROW_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def settled(df: DataFrame, name: str) -> DataFrame:
    """Like stored(), but the table outlives the innermost scratch()."""
    token = _SCRATCH.set(_SCRATCH.get()[:-1])
    try:
        return stored(df, name)
    finally:
        _SCRATCH.reset(token)


def _stored_at(df: DataFrame, path: str) -> DataFrame:
    if open_ := _SCRATCH.get():
        open_[-1].append(path)
    with small_batches(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(id_col: str, text_col: str) -> Column:
    """Sixteen bytes that stand for a row's id and text; rows alike in both share it."""
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.col(text_col).cast("string"), F.col(text_col).isNull().cast("string"))))


def free_name(df: DataFrame, name: str) -> str:
    """A column name beginning with name that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remove_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def cleanup(spark: SparkSession) -> None:
    """Delete every intermediate table of this application; results must be written before."""
    remove_path(spark, shared_dir(spark))


def skew_lookup(left: DataFrame, right: DataFrame, key: str, weight: str, spread: Column) -> DataFrame:
    """Left join to right, which has one row per key, when one key may hold a third of left's rows.

    weight names right's column with the number of left rows of its key.  Keys
    with at least 1/HOT_SHARE of all rows (so at most HOT_SHARE keys) and HOT_ROWS rows are dealt
    over SALTS partitions by ``spread``, a deterministic hash of the left row; where no key
    has as many, the tables are joined without a look for them.
    Null keys match nothing and stay.
    """
    known = F.col(key).isNotNull()
    total, most = right.agg(F.coalesce(F.sum(weight), F.lit(0)), F.coalesce(F.max(F.when(known, F.col(weight))), F.lit(0))).first()
    salt = F.pmod(spread, F.lit(SALTS)).cast("int")
    if most < HOT_ROWS or most * HOT_SHARE < total:
        marked = left.withColumn("_salt", F.when(F.col(key).isNull(), salt).otherwise(F.lit(0)))
        # Zero, but no literal: Spark would drop it from the join's keys, and null keys would meet in one partition.
        return marked.join(right.drop(weight).withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(1)).cast("int")), [key, "_salt"], "left").drop("_salt")
    hot = right.where((F.col(weight) * HOT_SHARE >= F.lit(total)) & (F.col(weight) >= HOT_ROWS) & known).select(F.col(key).alias("_hot"))
    marked = left.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    marked = marked.withColumn("_salt", F.when(F.col("_hot").isNotNull() | F.col(key).isNull(), salt).otherwise(F.lit(0))).drop("_hot")
    wide = right.drop(weight).join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    salts = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    wide = wide.withColumn("_salt", F.explode(salts)).drop("_hot")
    return marked.join(wide, [key, "_salt"], "left").drop("_salt")


def salted_lookup(left: DataFrame, right: DataFrame, key: str, weight: str, spread: Column, once: bool = False) -> DataFrame:
    """Like skew_lookup, but hot keys are told by their values, so that no row is joined or exploded to find them; once: equal rows are made one.

    At most HOT_SHARE keys are hot; only their rows of right are repeated, one for each of SALTS partitions.
    Equal left rows have equal spread and meet in one partition, so they are made one without another shuffle.
    """
    known = F.col(key).isNotNull()
    total, most = right.agg(F.coalesce(F.sum(weight), F.lit(0)), F.coalesce(F.max(F.when(known, F.col(weight))), F.lit(0))).first()
    hot = []
    if most >= HOT_ROWS and most * HOT_SHARE >= total:
        hot = [r[0] for r in right.where((F.col(weight) * HOT_SHARE >= F.lit(total)) & (F.col(weight) >= HOT_ROWS) & known).select(key).collect()]
    dealt = F.col(key).isin(hot) if hot else F.lit(False)
    marked = left.withColumn("_salt", F.when(F.col(key).isNull() | dealt, F.pmod(spread, F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    table = right.drop(weight)
    # Zero, but no literal: Spark would drop it from the join's keys, and null keys would meet in one partition.
    wide = table.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(1)).cast("int"))
    if hot:
        wide = wide.unionByName(table.where(dealt).withColumn("_salt", F.explode(F.sequence(F.lit(1), F.lit(SALTS - 1)))))
    found = marked.join(wide, [key, "_salt"], "left")
    return (found.distinct() if once else found).drop("_salt")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges(u, v): one row (node, root) per node that has an edge; root is the smallest node.

    Alternates the large-star and small-star steps until the edge set is
    stable; every round is written to the shared folder, so lineage stays short.
    """
    spark = edges.sparkSession

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    path = fresh_path(spark, name)
    current = _stored_at(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), path)
    seen = mark(current)
    while seen[0]:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        small = small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        done, path = path, fresh_path(spark, name)
        current = _stored_at(small, path)
        now = mark(current)
        remove_path(spark, done)
        if now == seen:
            break
        seen = now
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
