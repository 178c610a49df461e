"""Sources: delimited complaint dumps, Parquet, JSON, line sets, and optional or skipped inputs."""

from __future__ import annotations

import json
import shutil
import urllib.request
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import to_number
from ..schema import NUMERIC_COLUMNS, complaint_schema

_CORRUPT = "_corrupt_line"


def read_complaints(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A tab-separated dump: no header, no quoting, Latin-1; blanks stay blank, over-long lines are dropped, short ones padded."""
    schema = complaint_schema()
    fields = len(schema)
    raw = spark.read.csv(path, schema=T.StructType([*schema, T.StructField(_CORRUPT, T.StringType())]), sep="\t", quote="", encoding="ISO-8859-1", header=False, mode="PERMISSIVE", columnNameOfCorruptRecord=_CORRUPT)
    fitting = raw.where(F.col(_CORRUPT).isNull() | (F.size(F.split(_CORRUPT, "\t")) <= fields))
    return fitting.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns or schema.names])


def typed(complaints: DataFrame) -> DataFrame:
    """Number columns as doubles, null where they hold no number."""
    return complaints.withColumns({c: to_number(F.col(c)) for c in NUMERIC_COLUMNS if c in complaints.columns})


def read_columns(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table


def read_envelope(spark: SparkSession, path: str, rows: str = "rows") -> DataFrame:
    """The rows of JSON documents that wrap them in an envelope."""
    return spark.read.json(path, multiLine=True).select(F.explode(rows).alias("row")).select("row.*")


def read_eval_results(spark: SparkSession, glob: str) -> DataFrame:
    """Result rows of one JSON document a model, named provider/model; rows without usage are dropped."""
    table = spark.read.json(glob, multiLine=True)
    rows = table.select(F.concat_ws("/", "provider", "model").alias("model_key"), F.col("elapsed_s"), F.explode("results").alias("r"))
    return rows.where("r.usage is not null").select("model_key", "elapsed_s", "r.*")


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_lines(spark: SparkSession, path: str, column: str = "key") -> DataFrame:
    """The distinct non-blank lines of a text file; none where there is no file."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], f"{column} string")
    return spark.read.text(path).select(F.trim("value").alias(column)).where(F.col(column) != "").distinct()


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    return spark.read.json(path, schema=schema)


def read_if_exists(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A Parquet table, or an empty one of that schema."""
    return spark.read.parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def read_ids(spark: SparkSession, path: str, names: tuple[str, ...] = ("cmplid", "CMPLID")) -> DataFrame:
    """The id column of an optional table, whichever of the names it has, as a string column ``id``."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "id string")
    table = spark.read.parquet(path)
    name = next(n for n in names if n in table.columns)
    return table.select(F.col(name).cast("string").alias("id")).distinct()


def read_in_file_order(spark: SparkSession, path: str, ordinal: str = "_ordinal") -> DataFrame:
    """A Parquet table with a column that orders its rows as its files do, however they are dealt: file, then row in the file."""
    table = spark.read.parquet(path)
    return table.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(ordinal))


def read_mixed_json(spark: SparkSession, path: str, fields: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """JSON documents, one a line, whose fields and types differ: a column a field from the first path that gives its type, and ``broken``.

    fields: name -> (type, paths).  A value of another type is no value there; a line that is no JSON has
    nulls and is broken; blank lines are no rows.  One scan, no inference over the data.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.try_parse_json("value").alias("_v"))
    found = [F.coalesce(*[F.try_variant_get("_v", p, kind) for p in paths]).alias(name) for name, (kind, paths) in fields.items()]
    return lines.select(*found, F.col("_v").isNull().alias("broken"))


def probe(url: str, timeout: float = 30.0) -> dict:
    """Change-detection headers of a URL; a failure is data, not an exception."""
    try:
        request = urllib.request.Request(url, method="HEAD")
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return {"url": url, "status": reply.status, "last_modified": reply.headers.get("Last-Modified"), "etag": reply.headers.get("ETag"), "length": int(reply.headers["Content-Length"]) if reply.headers.get("Content-Length") else None, "error": None}
    except (OSError, ValueError) as e:
        return {"url": url, "status": None, "last_modified": None, "etag": None, "length": None, "error": f"{type(e).__name__}: {e}"}


def unchanged(now: dict, before: dict | None, force: bool = False) -> bool:
    """Whether a source can be skipped: the same modification date as last time, and no force."""
    return bool(not force and before and now.get("last_modified") and now["last_modified"] == before.get("last_modified"))


def download(url: str, folder: str, timeout: float = 600.0) -> dict:
    """Fetch and unpack an archive on the driver; the file takes its name once it is whole."""
    root = Path(folder)
    root.mkdir(parents=True, exist_ok=True)
    target = root / url.rsplit("/", 1)[-1]
    part = target.with_name(target.name + ".part")
    with urllib.request.urlopen(url, timeout=timeout) as reply, part.open("wb") as out:
        shutil.copyfileobj(reply, out, 1 << 20)
        headers = dict(reply.headers)
    part.replace(target)
    if zipfile.is_zipfile(target):
        with zipfile.ZipFile(target) as z:
            z.extractall(root / target.stem)
    meta = {"url": url, "bytes": target.stat().st_size, "last_modified": headers.get("Last-Modified"), "etag": headers.get("ETag")}
    (root / (target.stem + ".json")).write_text(json.dumps(meta))
    return meta


def pick_text_file(folder: str) -> str | None:
    """The dump among unpacked files: the first .txt named FLAT... or ...COMPLAINT..., else the largest."""
    found = sorted(p for p in Path(folder).rglob("*") if p.suffix.lower() == ".txt")
    named = [p for p in found if p.name.upper().startswith("FLAT") or "COMPLAINT" in p.name.upper()]
    best = named[0] if named else max(found, key=lambda p: p.stat().st_size, default=None)
    return None if best is None else str(best)
