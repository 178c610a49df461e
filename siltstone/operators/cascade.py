"""Two-stage labelling: merging a cheap and an escalated stage, costs, gates, and a backtest over model pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import binomial_se, keep_or_other, ratio, token_cost
from ..schema import PRICE_SCHEMA, PRICES, PRIMARY_CATEGORIES, RARE_CATEGORIES

#: Only this confidence escalates; a low one does not.
ESCALATE = "medium"
CANARY_MAX_ERRORS, CANARY_MIN_PARSED = 0.05, 0.95
#: Rows that a stage is tried on first.
CANARY_ROWS, SMART_CANARY_ROWS = 250, 50


class GateClosed(RuntimeError):
    """A canary did not pass; nothing more is called."""
#: Which confidences each backtest policy sends to the second model.
POLICIES = (("medium", ("medium",)), ("low_and_medium", ("low", "medium")))


def prices(spark) -> DataFrame:
    return spark.createDataFrame(list(PRICES), PRICE_SCHEMA)


def price_of(models: DataFrame, price_table: DataFrame) -> DataFrame:
    """models(provider, model) with their rates: the exact name, else the longest name that the model extends by a dash; null if none.

    The price table is a small dimension (a row a model), hence the broadcast.
    """
    names = price_table.select(F.col("provider").alias("_provider"), F.col("model").alias("_name"), "rate_in", "rate_cached", "rate_out")
    fits = (F.col("provider") == F.col("_provider")) & ((F.col("model") == F.col("_name")) | F.startswith("model", F.concat("_name", F.lit("-"))))
    joined = models.select("provider", "model").distinct().join(F.broadcast(names), fits, "left")
    best = Window.partitionBy("provider", "model").orderBy(F.length("_name").desc_nulls_last(), "_name")
    return joined.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").select("provider", "model", F.col("_name").alias("priced_as"), "rate_in", "rate_cached", "rate_out")


def with_cost(calls: DataFrame, price_table: DataFrame) -> DataFrame:
    """calls(provider, model, uncached, cached, output, written, batch) with cost_usd, null for an unknown price."""
    priced = calls.join(F.broadcast(price_of(calls, price_table)), ["provider", "model"], "left")
    cost = token_cost(F.col("provider"), F.col("rate_in"), F.col("rate_cached"), F.col("rate_out"), F.col("uncached"), F.col("cached"), F.col("output"), F.col("written"), F.col("batch"))
    return priced.withColumn("cost_usd", cost)


def merge_stages(first: DataFrame, second: DataFrame, key: str = "cmplid", fields: tuple[str, ...] = ("component",)) -> DataFrame:
    """(key, the fields, confidence, error, escalated, cost_usd): the second stage wins where it has an error-free answer.

    The first stage's cost always counts, the second's only where its answer is used; the confidence is the first stage's.
    Both have key, the fields, confidence, error, cost_usd.
    """
    b = second.select(key, *[F.col(c).alias(f"_2_{c}") for c in (*fields, "error", "cost_usd")], F.lit(True).alias("_2"))
    joined = first.join(b, key, "left")
    use = F.col("_2").isNotNull() & F.col("_2_error").isNull()
    return joined.select(key, *[F.when(use, F.col(f"_2_{c}")).otherwise(F.col(c)).alias(c) for c in fields], "confidence", F.when(~use, F.col("error")).alias("error"), use.alias("escalated"), (F.coalesce("cost_usd", F.lit(0.0)) + F.when(use, F.coalesce("_2_cost_usd", F.lit(0.0))).otherwise(F.lit(0.0))).alias("cost_usd"))


def to_escalate(first: DataFrame) -> DataFrame:
    return first.where(F.col("error").isNull() & (F.col("confidence") == ESCALATE))


def stage_summary(rows: DataFrame, primary: tuple[str, ...] = PRIMARY_CATEGORIES, rare: tuple[str, ...] = RARE_CATEGORIES) -> DataFrame:
    """One row: counts and rates of a stage; off-list answers are a share of the parsed ones, null if none parsed."""
    parsed = F.col("component").isNotNull() & F.col("error").isNull()
    off = parsed & ~F.col("component").isin(*primary, *rare)
    out = rows.agg(F.count("*").alias("n"), F.count_if(parsed).alias("n_parsed"), F.count_if(F.col("error").isNotNull()).alias("n_errors"), F.count_if(off).alias("n_off_list"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"))
    return out.withColumn("error_rate", ratio(F.col("n_errors"), F.col("n"))).withColumn("parse_rate", ratio(F.col("n_parsed"), F.col("n"))).withColumn("off_list_rate", ratio(F.col("n_off_list"), F.col("n_parsed")))


def canary_gate(summary: DataFrame) -> DataFrame:
    """Column passed: few errors, enough parsed, and a cost that shows that calls were made."""
    ok = (F.col("error_rate") <= CANARY_MAX_ERRORS) & (F.col("parse_rate") >= CANARY_MIN_PARSED) & (F.col("cost_usd") > 0) & (F.col("n_parsed") > 0)
    return summary.withColumn("passed", F.coalesce(ok, F.lit(False)))


def label_table(merged: DataFrame, primary: tuple[str, ...] = PRIMARY_CATEGORIES, rare: tuple[str, ...] = RARE_CATEGORIES) -> DataFrame:
    """component_label, null where there is no answer, and whether the answer is in neither list."""
    raw = F.col("component")
    return merged.withColumn("component_label", F.when(raw.isNotNull(), keep_or_other(raw, primary))).withColumn("off_list", F.when(raw.isNotNull(), ~raw.isin(*primary, *rare)))


def solo(results: DataFrame) -> DataFrame:
    """(model, n, accuracy, se, cost_per_100k) of each model alone; results has model, cmplid, correct, confidence, cost_usd."""
    out = results.groupBy("model").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.sum("cost_usd").alias("cost"))
    return out.select("model", "n", "accuracy", binomial_se(F.col("accuracy"), F.col("n")).alias("se"), (F.col("cost") / F.col("n") * 100_000).alias("cost_per_100k"))


def backtest(results: DataFrame, cheap: list[str], smart: list[str], policies: tuple = POLICIES) -> DataFrame:
    """(cheap, smart, policy, n, escalated, accuracy, se, cost_per_100k) over the ids that both models have.

    One join by id meets each cheap answer with the few smart ones; the grid of pairs and
    policies is a list of options, not of rows.
    """
    a = results.where(F.col("model").isin(*cheap)).select("cmplid", F.col("model").alias("cheap"), F.col("correct").alias("_a"), "confidence", F.col("cost_usd").alias("_ca"))
    b = results.where(F.col("model").isin(*smart)).select("cmplid", F.col("model").alias("smart"), F.col("correct").alias("_b"), F.col("cost_usd").alias("_cb"))
    pairs = a.join(b, "cmplid").where("cheap <> smart")
    options = F.array(*[F.struct(F.lit(name).alias("policy"), F.coalesce(F.col("confidence").isin(*sent), F.lit(False)).alias("up")) for name, sent in policies])
    rows = pairs.select("*", F.inline(options))
    right = F.when(F.col("up"), F.col("_b")).otherwise(F.col("_a")).cast("double")
    cost = F.coalesce("_ca", F.lit(0.0)) + F.when(F.col("up"), F.coalesce("_cb", F.lit(0.0))).otherwise(F.lit(0.0))
    out = rows.groupBy("cheap", "smart", "policy").agg(F.count("*").alias("n"), F.avg(F.col("up").cast("double")).alias("escalated"), F.avg(right).alias("accuracy"), F.avg(cost).alias("_cost"))
    return out.select("cheap", "smart", "policy", "n", "escalated", "accuracy", binomial_se(F.col("accuracy"), F.col("n")).alias("se"), (F.col("_cost") * 100_000).alias("cost_per_100k"))


#: Models to a word of bits.
MODEL_BITS = 62


def universally_missed(results: DataFrame) -> DataFrame:
    """Ids that every model has and none gets right: (cmplid, n_models, same_answer, answers)."""
    models = sorted(r["model"] for r in results.where("model is not null").select("model").distinct().collect())  # as many as there are models
    words = [models[i : i + MODEL_BITS] for i in range(0, len(models), MODEL_BITS)]
    bit = lambda word: F.coalesce(*[F.when(F.col("model") == m, F.lit(1 << i)) for i, m in enumerate(word)], F.lit(0)).cast("long")
    # One row an id leaves each task: the models seen as bits, and whether any was right.
    seen = [F.bit_or(bit(word)).alias(f"_seen_{i}") for i, word in enumerate(words)]
    by_id = results.groupBy("cmplid").agg(F.max(F.col("correct").cast("int")).alias("_any"), *seen).where("_any = 0")
    n_models = sum((F.bit_count(f"_seen_{i}") for i in range(len(words))), F.lit(0)).cast("long")
    missed = by_id.where(n_models == len(models)).select(F.col("cmplid").alias("_id"), F.lit(len(models)).cast("long").alias("n_models"))
    wrong = results.where(~F.coalesce("correct", F.lit(False))).select("cmplid", "pred").distinct()
    answers = wrong.join(missed, wrong["cmplid"].eqNullSafe(missed["_id"])).groupBy("cmplid", "n_models").agg(F.array_sort(F.collect_set("pred")).alias("answers"))
    return answers.select("cmplid", "n_models", (F.size("answers") == 1).alias("same_answer"), "answers").orderBy(F.desc("same_answer"), "cmplid")


def model_table(results: DataFrame) -> DataFrame:
    """(model, n, accuracy, tokens_in, tokens_out, cost_per_1k, input_cost_share, n_errors), best first."""
    out = results.groupBy("model").agg(
        F.count("*").alias("n"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"),
        F.avg(F.col("tokens_in").cast("double")).alias("tokens_in"),
        F.avg(F.col("tokens_out").cast("double")).alias("tokens_out"),
        (F.avg("cost_usd") * 1000).alias("cost_per_1k"),
        ratio(F.sum("input_cost_usd"), F.sum("cost_usd")).alias("input_cost_share"),
        F.count_if(F.col("error").isNotNull()).alias("n_errors"),
    )
    return out.orderBy(F.col("accuracy").desc_nulls_last(), "model")


def most_common(values: DataFrame, column: str) -> DataFrame:
    """One row: the most frequent value, ties to the smaller one."""
    return values.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(1)
