"""Scoring rows: top classes, run summaries, a pluggable classifier, and label calls through an injected client."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import ratio, top_k
from .quantiles import exact_median


def with_top3(rows: DataFrame, probabilities: str, labels: list[str] | None = None) -> DataFrame:
    """pred, confidence and top3 (a JSON array of {label, p}) from a column of class probabilities."""
    best = top_k(F.col(probabilities), 3)
    name = (lambda i: F.get(F.array(*[F.lit(v) for v in labels]), i)) if labels else (lambda i: i.cast("string"))
    named = F.transform(best, lambda x: F.struct(name(x["label"]).alias("label"), x["p"].alias("p")))
    out = rows.withColumn("_top", named)
    return out.withColumn("pred", F.get("_top", 0)["label"]).withColumn("confidence", F.get("_top", 0)["p"].cast("double")).withColumn("top3", F.to_json("_top")).drop("_top")


def train_text_classifier(rows: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 14) -> PipelineModel:
    """TF-IDF with logistic regression; class numbers follow the sorted labels."""
    stages = [
        StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="skip"),
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"\W+"),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol="_label", maxIter=20, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(rows.where(F.col(text).isNotNull() & F.col(label).isNotNull()))


def classify(rows: DataFrame, model: PipelineModel, text: str = "text") -> DataFrame:
    """rows with pred, confidence and top3; a null text is scored as a blank one."""
    labels = list(model.stages[0].labels)
    scorer = PipelineModel(model.stages[1:])
    scored = scorer.transform(rows.withColumn("_raw_text", F.col(text)).withColumn(text, F.coalesce(text, F.lit(""))))
    scored = scored.withColumn("_p", vector_to_array("probability")).withColumn(text, F.col("_raw_text"))
    return with_top3(scored, "_p", labels).select(*rows.columns, "pred", "confidence", "top3")


def incoming_summary(scored: DataFrame, day: str, field: str, unknown: str = "UNKNOWN OR OTHER", low: float = 0.5) -> DataFrame:
    """One row over scored rows: dates, interpolated median confidence, rates of unknowns, of low confidence, of agreement with the field.

    The median is selected exactly by counted passes (quantiles.exact_median), so no task gathers all confidences.
    """
    out = scored.agg(
        F.count("*").alias("n"),
        F.min(day).alias("first_day"),
        F.max(day).alias("last_day"),
        F.count_if(F.col("pred") == unknown).alias("n_unknown"),
        F.count_if(F.col("confidence") < low).alias("n_low"),
        F.count_if(F.col("pred").eqNullSafe(F.col(field))).alias("n_agree"),
    )
    rate = {name: ratio(F.col(f"n_{name}"), F.col("n")) for name in ("unknown", "low", "agree")}
    out = out.join(exact_median(scored, "confidence", name="median_confidence"))  # one row each
    return out.select("n", "first_day", "last_day", "median_confidence", *[v.alias(f"{k}_rate") for k, v in rate.items()])


def score_batches(rows: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], labels: list[str], text: str = "text", batch: int = 256) -> DataFrame:
    """rows with pred, confidence and top3 from any batch model.

    ``load`` runs once a task and returns a function from texts to class probabilities in the order of labels; a null text is scored as a blank one.
    """
    schema = T.StructType([*rows.schema, T.StructField("_p", T.ArrayType(T.DoubleType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            texts = [t if isinstance(t, str) else "" for t in frame[text]]
            found: list[list[float]] = []
            for i in range(0, len(texts), batch):
                found += [list(map(float, p)) for p in model(texts[i : i + batch])]
            yield frame.assign(_p=found)

    return with_top3(rows.mapInPandas(run, schema), "_p", labels).drop("_p")


def call_labeller(rows: DataFrame, client: Callable[[list[str]], list[str | None]], text: str, retries: int = 4, batch: int = 64, pause: float = 1.0) -> DataFrame:
    """rows with reply and error columns from a client that answers a list of texts; recorded or remote.

    A batch that fails, or gets another number of answers than texts, is tried again up to ``retries`` times, after
    ``pause`` seconds, twice as many the next time and so on; then its rows carry the error.
    """
    schema = T.StructType([*rows.schema, T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            replies: list[str | None] = []
            errors: list[str | None] = []
            texts = frame[text].tolist()
            for i in range(0, len(texts), batch):
                part, problem, answers = texts[i : i + batch], None, None
                for attempt in range(retries):
                    if attempt:
                        time.sleep(pause * 2 ** (attempt - 1))
                    try:
                        answers, problem = list(client(part)), None
                        if len(answers) != len(part):
                            raise ValueError(f"{len(answers)} answers to {len(part)} texts")
                        break
                    except Exception as e:  # the client's own failures are data here
                        problem = f"{type(e).__name__}: {e}"
                replies += answers if problem is None else [None] * len(part)
                errors += [problem] * len(part)
            yield frame.assign(reply=replies, error=errors)

    return rows.mapInPandas(run, schema)
