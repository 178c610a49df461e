"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir), works on every document that the stage before it kept
and returns a DataFrame that is written as Parquet and read again.  All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bpe, decontaminate, langid, line_dedup, simhash
from siltstone.llm.common import ARROW_ROWS, free_name, stored
from siltstone.llm.queries import tokenizer_path

#: Near copies: Jaccard similarity of five-word shingles.
SIMILARITY = 0.8


def _configure(spark: SparkSession) -> None:
    """Small batches to Python in every stage: a stage's result is computed when its caller writes it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: a null text or one without letters (UND) goes, however many languages there are.

    Where nothing has a label there is no language to know, and every row goes; repeated rows stay, each judged alike; an
    empty table stays empty; other columns are kept, whatever their names.
    """
    _configure(spark)
    names = (free_name(docs, "_lang_pred"), free_name(docs, "_lang_score"))
    found = langid.classify(docs, langid.fit(docs), docs.columns, out=names)
    return found.where(F.col(names[0]) != langid.UND).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines, short ones too; a document of which nothing is left goes, and n_chars follows the text.

    A null text stays null; rows alike in id and text are one document and lose the same lines; of lines that tie for the
    first occurrence the one with the smaller doc_id stays (null first); an empty table stays empty; other columns are kept, whatever their names.
    """
    _configure(spark)
    dropped = F.col(line_dedup.prefix_of(docs) + "dropped")
    found = line_dedup.dedup_lines(docs, short=True)
    found = found.where((dropped == 0) | F.col("text").rlike(r"\S"))
    n_chars = F.when(dropped > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.withColumn("n_chars", n_chars).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: five-word shingles, Jaccard similarity of 0.8 or more.

    The smallest doc_id stays (a null one only if its group has no other), of rows alike in id and text one; null and blank
    texts are copies of each other; an empty table stays empty; other columns are kept, whatever their names.
    """
    _configure(spark)
    return simhash.deduplicate(docs, similarity=SIMILARITY)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item.

    Null and empty texts share none and stay, repeated rows stay or go together; with an empty
    benchmark all stay; an empty table stays empty; other columns are kept, whatever their names.
    """
    _configure(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of every document.

    Null and empty texts have no tokens; repeated rows are encoded each; an empty table gives an empty result; other columns go.
    """
    _configure(spark)
    return bpe.encode(docs, tokenizer_path()).select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontaminate", decontaminated),
    ("bpe", tokens),
]

#: Language ID, near copies and BPE have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
