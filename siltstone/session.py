"""Session defaults (UTC, adaptive execution with skew handling, ANSI casts) and the folder for intermediate tables."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "siltstone", master: str | None = None, **settings: str) -> SparkSession:
    """A session for the library; settings override the defaults, with dots as double underscores."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.ansi.enabled": "true",
    } | {k.replace("__", "."): v for k, v in settings.items()}
    builder = SparkSession.builder.appName(app).config(map=conf)
    return (builder.master(master) if master else builder).getOrCreate()


@functools.cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="siltstone-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return "file://" + folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: a part of spark.checkpoint.dir; where that is unset, a local one, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the executors of {master} share")
        found = _local_folder()
    return found.rstrip("/") + "/siltstone-" + spark.sparkContext.applicationId


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read back: it is computed once, and lineage stays short."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
