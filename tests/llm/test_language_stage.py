import corpus_pipeline
from pyspark.sql import functions as F
from siltstone.llm import langid


def test_only_texts_without_letters_go(spark, monkeypatch):
    rows = [(1, "some words", "en", "s", 0), (2, "12 !!", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # As with many languages: a winner that lost pairs has a low score.
    low = lambda docs, model, columns, out: docs.withColumn(out[0], F.when(F.col("doc_id") == 1, "en").otherwise(langid.UND)).withColumn(out[1], F.lit(0.1))
    monkeypatch.setattr(langid, "classify", low)
    assert [r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()] == [1]
