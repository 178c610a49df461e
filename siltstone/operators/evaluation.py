"""Scoring predictions against multi-answer keys: slices, intervals, F1, class reports, gates and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import extract_json, keep_or_other, ratio, same_to_3dp, wilson, year_bucket
from ..schema import LABEL_SCHEMA, PRIMARY_CATEGORIES, RARE_CATEGORIES, YEAR_BUCKETS
from .sets import first_per_key

#: Fixed values of the promotion gate, in shares.
LEGACY_DROP, HARD_DROP = 0.02, 0.03
#: The answer that an unusable reply counts as.
PARSE_FAILURE = "PARSE_FAILURE"


def score_replies(replies: DataFrame, gold: DataFrame, reply: str = "reply", key: str = "cmplid", primary: tuple[str, ...] = PRIMARY_CATEGORIES, rare: tuple[str, ...] = RARE_CATEGORIES) -> DataFrame:
    """Parsed replies beside their answers: pred, correct, off_list, pred_crash, pred_fire, error.

    A reply without a usable object is an error: no prediction, not correct.
    The join is inner; a reply whose id has no answer is left out.
    """
    parsed = replies.withColumn("_r", extract_json(F.col(reply), LABEL_SCHEMA)).join(gold, key)
    raw = F.col("_r.component")
    bucket = keep_or_other(raw, primary)
    direct = F.array_contains("accept", raw)
    correct = raw.isNotNull() & (direct | F.array_contains("accept", bucket))
    out = parsed.withColumn("raw_component", raw).withColumn("pred", F.when(raw.isNotNull(), F.when(direct, raw).otherwise(bucket)))
    out = out.withColumn("correct", F.coalesce(correct, F.lit(False))).withColumn("off_list", F.when(raw.isNotNull(), ~raw.isin(*primary, *rare)))
    out = out.withColumn("confidence", F.col("_r.confidence")).withColumn("pred_crash", F.col("_r.crash")).withColumn("pred_fire", F.col("_r.fire"))
    return out.withColumn("error", F.when(raw.isNull(), F.lit("no usable JSON object"))).drop("_r")


def accuracy_slices(results: DataFrame, hard: str = "is_hard", correct: str = "correct") -> DataFrame:
    """(slice, n, k, accuracy, lo, hi) for all, hard and easy rows, and for those of which it is not known (``missing``), in one pass; errors count as wrong."""
    k = F.count_if(F.col(correct))
    out = results.groupingSets([[], [hard]], hard).agg(F.count("*").alias("n"), k.alias("k"), F.grouping(hard).alias("_g"))
    name = F.when(F.col("_g") == 1, F.lit("all")).when(F.col(hard), F.lit("hard")).when(~F.col(hard), F.lit("easy")).otherwise(F.lit("missing"))
    return _interval(out.select(name.alias("slice"), "n", "k"))


def _interval(counts: DataFrame) -> DataFrame:
    w = wilson(F.col("k"), F.col("n"))
    return counts.withColumn("accuracy", ratio(F.col("k"), F.col("n"))).withColumn("lo", w["lo"]).withColumn("hi", w["hi"])


def accuracy_by(results: DataFrame, group: Column, name: str, correct: str = "correct") -> DataFrame:
    """(name, n, k, accuracy, share, lo, hi) per group; a null group is ``missing``."""
    out = results.groupBy(F.coalesce(group.cast("string"), F.lit("missing")).alias(name)).agg(F.count("*").alias("n"), F.count_if(F.col(correct)).alias("k"))
    return _interval(out).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def year_bucket_accuracy(results: DataFrame, year: str, correct: str = "correct", buckets: tuple = YEAR_BUCKETS) -> DataFrame:
    """Accuracy per closed range of years; rows of other years and without a year are reported too."""
    return accuracy_by(results, year_bucket(F.col(year), buckets), "bucket", correct)


def flag_agreement(results: DataFrame, predicted: str, truth: str) -> DataFrame:
    """One row: eligible rows (prediction Y or N) and their agreement with the truth."""
    eligible = F.coalesce(F.col(predicted).isin("Y", "N"), F.lit(False))
    out = results.agg(F.count_if(eligible).alias("n_eligible"), F.count_if(eligible & F.col(predicted).eqNullSafe(F.col(truth))).alias("n_agree"))
    return out.withColumn("agreement", ratio(F.col("n_agree"), F.col("n_eligible")))


def effective_truth(fallback: str = "accept_first", primary: tuple[str, ...] = PRIMARY_CATEGORIES) -> Column:
    """The label a row counts for: the prediction where it is correct, else accept[0], the bucketed or the raw primary label."""
    other = {"accept_first": F.get("accept", 0), "bucket_primary": keep_or_other(F.col("primary"), primary), "primary": F.col("primary")}[fallback]
    return F.when(F.col("correct"), F.col("pred")).otherwise(other)


def effective_pairs(results: DataFrame, fallback: str = "accept_first", primary: tuple[str, ...] = PRIMARY_CATEGORIES, failures: bool = False) -> DataFrame:
    """results with ``truth`` and ``answer`` for class reports; rows without a prediction go, or answer PARSE_FAILURE."""
    rows = results.withColumn("truth", effective_truth(fallback, primary)).withColumn("answer", F.coalesce("pred", F.lit(PARSE_FAILURE)))
    return rows if failures else rows.where(F.col("pred").isNotNull())


def reproduction(results: DataFrame, complaints: DataFrame, published: float, buckets: tuple = YEAR_BUCKETS, key: str = "cmplid", day: str = "ldate") -> dict[str, DataFrame]:
    """An evaluation run once more: slices, whether the accuracy is the published one to three decimals, accuracy by year received, rows without a day."""
    dates = first_per_key(complaints.select(F.col(key).cast("string").alias("_key"), F.col(day).alias("_day")), ["_key"], ["_day"])
    dated = results.join(dates, results[key].cast("string") == F.col("_key"), "left")
    dated = dated.withColumn("received_year", F.substring("_day", 1, 4).try_cast("int"))
    slices = accuracy_slices(results)
    same = slices.where("slice = 'all'").select("accuracy", F.lit(published).alias("published"), same_to_3dp(F.col("accuracy"), F.lit(published)).alias("passed"), F.abs(F.col("accuracy") - F.lit(published)).alias("abs_diff"))
    missing = dated.agg(F.count_if(F.col("_key").isNull()).alias("n_missing"))
    return {"slices": slices, "check": same, "by_year": year_bucket_accuracy(dated, "received_year", buckets=buckets), "missing": missing}


def confusion(pairs: DataFrame, truth: str, pred: str) -> DataFrame:
    """(label, tp, n_true, n_pred): one pass over the two roles of each row."""
    roles = F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(truth) == F.col(pred)).cast("int").alias("tp")), F.struct(F.col(pred).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("tp")))
    rows = pairs.where(F.col(pred).isNotNull()).select(F.explode(roles).alias("r")).select("r.*")
    return rows.groupBy("label").agg(F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"), F.sum("t").alias("n_true"), F.sum("p").alias("n_pred")).where("label is not null")


def class_report(pairs: DataFrame, truth: str, pred: str, labels: DataFrame | None = None) -> DataFrame:
    """(label, precision, recall, f1, support) per observed label, or per label of a fixed list, largest support first."""
    counts = confusion(pairs, truth, pred)
    if labels is not None:
        counts = labels.select(F.col(labels.columns[0]).alias("label")).distinct().join(counts, "label", "left").fillna(0)
    zero = F.lit(0.0)
    return counts.select(
        "label",
        F.coalesce(ratio(F.col("tp"), F.col("n_pred")), zero).alias("precision"),
        F.coalesce(ratio(F.col("tp"), F.col("n_true")), zero).alias("recall"),
        F.coalesce(ratio(2 * F.col("tp"), F.col("n_true") + F.col("n_pred")), zero).alias("f1"),
        F.col("n_true").alias("support"),
    ).orderBy(F.desc("support"), "label")


def macro_f1(report: DataFrame) -> DataFrame:
    """One row: macro and support-weighted averages of a class report."""
    weighted = ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support"))
    return report.agg(F.count("*").alias("n_labels"), F.avg("f1").alias("macro_f1"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), weighted.alias("weighted_f1"))


def promotion_gate(scores: DataFrame) -> DataFrame:
    """The promotion gate for rows (key, champion_k, champion_n, challenger_k, challenger_n), key in current, legacy, hard: one row."""
    pick = lambda key, c: F.max(F.when(F.col("key") == key, F.col(c)))
    cols = {f"{key}_{c}": pick(key, c) for key in ("current", "legacy", "hard") for c in ("champion_k", "champion_n", "challenger_k", "challenger_n")}
    wide = scores.agg(*[v.alias(k) for k, v in cols.items()])
    acc = lambda key, who: ratio(F.col(f"{key}_{who}_k"), F.col(f"{key}_{who}_n"))
    a, b = (wilson(F.col(f"current_{who}_k"), F.col(f"current_{who}_n")) for who in ("champion", "challenger"))
    out = wide.select(
        (acc("current", "challenger") > acc("current", "champion")).alias("better"),
        (acc("legacy", "champion") - acc("legacy", "challenger") <= LEGACY_DROP).alias("legacy_ok"),
        (acc("hard", "champion") - acc("hard", "challenger") <= HARD_DROP).alias("hard_ok"),
        ((a["hi"] < b["lo"]) | (b["hi"] < a["lo"])).alias("intervals_apart"),
    )
    return out.withColumn("promote", F.col("better") & F.col("legacy_ok") & F.col("hard_ok") & F.col("intervals_apart"))


def alerts(signals: DataFrame) -> DataFrame:
    """Monitoring alerts (draft thresholds) over rows of js, unknown_rate, unknown_base, confidence, confidence_base, agreement,
    agreement_base, agreement_days, disagreement, disagreement_base, check_k, check_n, champion_accuracy: one boolean a signal."""
    check = wilson(F.col("check_k"), F.col("check_n"))
    return signals.select(
        "*",
        (F.col("js") > 0.08).alias("mix_alert"),
        (F.col("unknown_rate") - F.col("unknown_base") >= 0.05).alias("unknown_alert"),
        (F.col("confidence") - F.col("confidence_base") <= -0.10).alias("confidence_alert"),
        ((F.abs(F.col("agreement") - F.col("agreement_base")) >= 0.10) & (F.col("agreement_days") >= 7)).alias("agreement_alert"),
        (F.col("disagreement") - F.col("disagreement_base") >= 0.15).alias("disagreement_alert"),
        F.coalesce(check["hi"] < F.col("champion_accuracy") - 0.05, F.lit(False)).alias("check_alert"),
    )
