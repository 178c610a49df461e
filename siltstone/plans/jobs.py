"""Whole jobs over the complaint table, composed of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import FIRE_WORDS, extract_json, fingerprint, fingerprint_hash, mentions, prompt_text, ratio, target_json, top_level
from ..operators import cascade, drift, evaluation, labels, sampling, scoring, sets
from ..operators import census as C
from ..schema import BUCKETED_SYSTEMS, FIRE_SYSTEMS, LABEL_SCHEMA, MERGE_MAP, MODEL_NAMES, PRIMARY_CATEGORIES, RARE_CATEGORIES, UNKNOWN
from ..session import settled
from ..sources import readers, sinks

VEHICLE = "V"
RARE_TOPUP, GOLD_RARE, PER_CLASS, PER_MONTH = 800, 7, 2000, 2000
BLIND = ["cmplid", "make", "model", "year", "narrative", "ldate"]


def vehicles(complaints: DataFrame) -> DataFrame:
    return complaints.where(F.col("PROD_TYPE") == VEHICLE)


def model_columns(complaints: DataFrame) -> DataFrame:
    """Columns under the names that models take."""
    return complaints.withColumnsRenamed(MODEL_NAMES)


def load_data(spark: SparkSession, dump: str, path: str) -> DataFrame:
    """The complaint file as a typed Parquet table, and that table."""
    sinks.write_table(readers.typed(readers.read_complaints(spark, dump)), path)
    return readers.read_columns(spark, path)


def examples(rows: DataFrame, *columns: str) -> DataFrame:
    """(key, example): every row as a JSON object under model names."""
    named = model_columns(rows.select(*columns))
    return named.select(named.columns[0], F.to_json(F.struct(*named.columns)).alias("example"))


def prepare_training_data(complaints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labelled vehicle rows with incident group sizes, and the label coverage table."""
    rows = vehicles(complaints).withColumn("COMPDESC_TOP", top_level(F.col("COMPDESC"), ":", MERGE_MAP))
    coverage = labels.label_coverage(rows.groupBy("COMPDESC_TOP").agg(F.count("*").alias("n")), "COMPDESC_TOP")
    rows = labels.assign_labels(rows, coverage, "COMPDESC_TOP", "COMPDESC_LABEL")
    return labels.group_size(rows, "ODINO", "odino_group_size", "odino_multi_row"), coverage


def build_training_sample(clean: DataFrame, gold_ids: DataFrame, cap: int = PER_CLASS, seed: int = 42) -> DataFrame:
    """At most cap rows of each label, none of them in the answer key."""
    kept = sets.excluding(clean, "CMPLID", gold_ids)
    sets.require_exact_exclusion(sets.exclusion_report(clean, kept, gold_ids, "CMPLID"))
    return sampling.stratified_sample(kept, "COMPDESC_LABEL", cap, "CMPLID", seed)


def build_rare_topup(clean: DataFrame, blocked: list[DataFrame], categories: list[str], cap: int = RARE_TOPUP, seed: int = 42) -> DataFrame:
    kept = sets.excluding(clean, "CMPLID", *blocked).where(F.col("COMPDESC_TOP").isin(*categories))
    return sampling.stratified_sample(kept, "COMPDESC_TOP", cap, "CMPLID", seed)


def merge_rare_topup(main: DataFrame, topup: DataFrame, category: str = "raw_component", label: str = "component_label") -> dict[str, DataFrame]:
    """The union without repeated ids, the repeats, and the report: rows, counts of the rare categories, spread of the primary classes."""
    merged, repeats = sets.merge_without_repeats(main, topup, "cmplid")
    rare = merged.sparkSession.createDataFrame([(c,) for c in RARE_CATEGORIES], f"{category} string")
    change = rare.join(sets.category_change(main, merged, category), category, "left").fillna(0)
    sizes = main.agg(F.count("*").alias("n_main")).join(merged.agg(F.count("*").alias("n_merged"))).join(repeats.agg(F.countDistinct("cmplid").alias("n_repeated")))
    return {"merged": merged, "repeats": repeats, "rare": change, "sizes": sizes, "primary": class_spread(main, merged, label), "unique": sets.is_unique(merged, "cmplid")}


def class_spread(before: DataFrame, after: DataFrame, label: str, classes: tuple[str, ...] = PRIMARY_CATEGORIES) -> DataFrame:
    """(side, least, median, most) of the counts of a closed class list; absent classes count 0, the median is the upper one."""
    known = after.sparkSession.createDataFrame([(c,) for c in classes], f"{label} string")
    counts = known.join(sets.category_change(before, after, label), label, "left").fillna(0)
    sides = counts.select(F.inline(F.array(*[F.struct(F.lit(side).alias("side"), F.col(f"n_{side}").alias("n")) for side in ("before", "after")])))
    ordered = F.array_sort(F.collect_list("n"))  # one number a class
    return sides.groupBy("side").agg(F.min("n").alias("least"), F.get(ordered, F.floor(F.count("*") / 2).cast("int")).alias("median"), F.max("n").alias("most"))


def build_rare_gold(clean: DataFrame, blocked: list[DataFrame], categories: list[str], seed: int = 42) -> DataFrame:
    rows = build_rare_topup(clean, blocked, categories, GOLD_RARE, seed)
    count = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c.lower())
    return rows.select("CMPLID", "MAKETXT", "MODELTXT", "YEARTXT", "CDESCR", "COMPDESC_TOP", "CRASH", "FIRE", count("INJURED"), count("DEATHS"))


#: What an answer-key row takes from the row that it was adjudicated on.
GOLD_FIELDS = ("make", "model", "year", "narrative", "nhtsa_crash", "nhtsa_fire")


def build_gold(adjudications: DataFrame, candidates: DataFrame, extras: DataFrame) -> DataFrame:
    """Adjudicated rows (cmplid, primary, accept, is_hard, note, target_category) with the fields of their candidate, else of the extra row.

    One row an id: of several candidates with it, the one with the smallest fields is taken, and all of its fields, blank ones too.
    """
    one = lambda rows, name: sets.first_per_key(rows.select("cmplid", F.struct(*GOLD_FIELDS).alias(name)), ["cmplid"], [name])
    found = adjudications.join(one(candidates, "_c"), "cmplid", "left").join(one(extras, "_e"), "cmplid", "left")
    source = F.coalesce("_c", "_e")
    target = F.col("target_category")
    return found.select(
        "cmplid", *[source[f].alias(f) for f in GOLD_FIELDS], "accept", "primary", F.lit("adjudicated").alias("truth_source"), "is_hard", F.col("note").alias("adjudication_note"),
        target.alias("target_category_before_review"), (F.col("primary") == target).alias("confirmed_target_category"),
    )


def gold_report(previous: DataFrame, added: DataFrame) -> dict[str, DataFrame]:
    """The answer key with the added rows, its sizes, and how many rows confirmed the category that they were sampled for."""
    whole = previous.unionByName(added, allowMissingColumns=True)
    sizes = whole.agg(F.count("*").alias("n"), F.count_if("is_hard").alias("n_hard"))
    new = added.agg(F.count("*").alias("n_new"), F.count_if("confirmed_target_category").alias("n_confirmed"))
    summary = sizes.join(new).withColumn("confirmation_rate", ratio(F.col("n_confirmed"), F.col("n_new")))
    return {"rows": whole, "summary": summary, "per_category": confirmed_per_category(added)}


def confirmed_per_category(reviewed: DataFrame) -> DataFrame:
    """(category, confirmed) as "k/n"."""
    out = reviewed.groupBy(F.col("target_category_before_review").alias("category")).agg(F.count_if("confirmed_target_category").alias("k"), F.count("*").alias("n"))
    return out.select("category", F.concat(F.col("k").cast("string"), F.lit("/"), F.col("n").cast("string")).alias("confirmed"))


def fewshot_candidates(clean: DataFrame, n: int = 3, seed: int = 42) -> DataFrame:
    """Readable examples of each label, of fires that were put down to a system, and of bucketed systems beside rows of no known system."""
    per_class = sampling.readable_sample(clean, "CDESCR", n, "CMPLID", seed, group="COMPDESC_LABEL").withColumn("kind", F.lit("per_class"))
    fires = clean.where(mentions(F.col("CDESCR"), FIRE_WORDS) & F.col("COMPDESC_LABEL").isin(*FIRE_SYSTEMS))
    fires = sampling.readable_sample(fires, "CDESCR", 2 * n, "CMPLID", seed).withColumn("kind", F.lit("fire"))
    bucketed = sampling.readable_sample(clean.where(F.col("COMPDESC_TOP").isin(*BUCKETED_SYSTEMS)), "CDESCR", 1, "CMPLID", seed, group="COMPDESC_TOP")
    unknown = sampling.readable_sample(clean.where(F.col("COMPDESC_LABEL") == UNKNOWN), "CDESCR", 2, "CMPLID", seed)
    other = bucketed.unionByName(unknown).withColumn("kind", F.lit("other_or_unknown"))
    return per_class.unionByName(fires).unionByName(other)


def training_rows(labelled: DataFrame, valid: list[str], generative: bool = False) -> DataFrame:
    """Rows that can be trained on: a valid component and no error; for generation all fields."""
    ok = F.col("raw_component").isin(*valid) & F.col("error").isNull()
    if generative:
        ok = ok & F.col("crash").isin("Y", "N") & F.col("fire").isin("Y", "N") & F.col("injured").isNotNull() & F.col("deaths").isNotNull()
    return labelled.where(ok)


def sft_examples(labelled: DataFrame) -> DataFrame:
    prompt = prompt_text(F.col("make"), F.col("model"), F.col("year"), F.col("narrative"))
    target = target_json(F.col("raw_component"), F.col("crash"), F.col("fire"), F.col("injured").cast("string"), F.col("deaths").cast("string"))
    return labelled.select("cmplid", prompt.alias("prompt"), target.alias("target"))


def pull(dump: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New vehicle rows of a dump, and the ledger with all of its vehicle fingerprints."""
    rows = vehicles(dump).withColumn("fingerprint", fingerprint(F.col("ODINO"), F.col("CDESCR")))
    return sets.new_rows(rows, ledger, "fingerprint"), sets.ledger_union(ledger.select("fingerprint"), rows.select("fingerprint"))


def nightly(dump: DataFrame, census: DataFrame, totals: DataFrame, seen: DataFrame, cutoff: str, as_of: str) -> dict:
    """One night: months replaced, new rows after the cutoff, hashes seen, and the drift rule."""
    rows = vehicles(dump)
    day, top = F.col("LDATE"), top_level(F.col("COMPDESC"), ":", MERGE_MAP)
    month_c, month_t = drift.from_rows(rows, day, top)
    census, totals = sets.overlay(census, month_c, "ym"), sets.overlay(totals, month_t, "ym")
    late = rows.where(day > cutoff).withColumn("key", fingerprint_hash(F.col("ODINO"), F.col("CDESCR")))
    rule = drift.mix_rule(census, totals, as_of)
    return {"census": census, "totals": totals, "new": sets.new_rows(late, seen, "key"), "seen": sets.ledger_union(seen.select("key"), late.select("key")), "rule": rule}


def retrain_decision(fire: DataFrame, teacher: DataFrame, allow_retrain: bool = False) -> DataFrame:
    """One row: retrain on a fire, with the number of teacher labels received through its month; never promote here."""
    one = fire.agg(F.max("month").alias("fire_month"), F.max("previous_month").alias("previous_month"))
    counted = teacher.join(F.broadcast(one)).agg(F.count_if(F.substring("ldate", 1, 6) <= F.col("fire_month")).alias("n_teacher_through_fire"))
    out = one.join(counted).withColumn("retrain", F.col("fire_month").isNotNull()).withColumn("promote", F.lit(False))
    return out.withColumn("launch", F.col("retrain") & F.lit(allow_retrain))


def loop(dump: DataFrame, ledger: DataFrame, history: DataFrame, teacher: DataFrame, as_of: str, score: Callable[[DataFrame], DataFrame] | None = None, allow_retrain: bool = False, last_n: int = drift.LAST_N, prior_months: int = drift.PRIOR_MONTHS) -> dict:
    """One turn of the loop: pull the new rows of a dump, score them, look for a fire in all rows, decide.

    ``score`` adds pred, confidence and top3; None leaves the step out.  ``history`` holds all rows received, this dump's too.
    """
    new, ledger = pull(dump, ledger)
    scored = None if score is None else settled(score(new), "scored")
    summary = None if scored is None else scoring.incoming_summary(scored.withColumn("_top", top_level(F.col("COMPDESC"), ":", MERGE_MAP)), "LDATE", "_top", UNKNOWN)
    census, totals = drift.from_rows(vehicles(history), F.col("LDATE"), top_level(F.col("COMPDESC"), ":", MERGE_MAP))
    rule = drift.mix_rule(census, totals, as_of, last_n, prior_months)
    return {"new": new, "ledger": ledger, "scored": scored, "score": summary, "rule": rule, "decision": retrain_decision(rule["fire"], teacher, allow_retrain)}


#: How a stage's replies are read: the fields of the answer beside what the call cost.
_ANSWER = ("component", "crash", "fire", "injured", "deaths", "confidence")


def label_stage(rows: DataFrame, call: Callable[[DataFrame], DataFrame], name: str, primary: tuple[str, ...] = PRIMARY_CATEGORIES, rare: tuple[str, ...] = RARE_CATEGORIES, canary: int = cascade.CANARY_ROWS) -> tuple[DataFrame, DataFrame]:
    """Answers (cmplid, the fields, error, cost_usd) and summary of a stage; the canary chunk is called first and must pass its gate.

    ``call`` adds reply, error and cost_usd to rows; its results are written before anything is read of them, so no call is paid twice.
    """

    def answered(part: DataFrame) -> DataFrame:
        done = call(part)
        parsed = extract_json(F.col("reply"), LABEL_SCHEMA)
        done = done.withColumn("_a", F.when(F.col("error").isNull(), parsed))
        error = F.coalesce("error", F.when(F.col("_a.component").isNull(), F.lit("no usable JSON object")))
        return settled(done.select("cmplid", *[F.col(f"_a.{f}").alias(f) for f in _ANSWER], error.alias("error"), "cost_usd"), name)

    first = settled(sampling.uniform_sample(rows, canary, "cmplid", 0), "canary")
    tried = answered(first)
    gate = cascade.canary_gate(cascade.stage_summary(tried, primary, rare)).first()  # one row
    if not gate["passed"]:
        raise cascade.GateClosed(f"{name}: {gate.asDict()}")
    both = tried.unionByName(answered(rows.join(first.select("cmplid"), "cmplid", "left_anti")))
    return both, cascade.stage_summary(both, primary, rare)


def cascade_labels(sample: DataFrame, cheap: Callable[[DataFrame], DataFrame], smart: Callable[[DataFrame], DataFrame], models: tuple[str, str], primary: tuple[str, ...] = PRIMARY_CATEGORIES, rare: tuple[str, ...] = RARE_CATEGORIES, canary: int = cascade.CANARY_ROWS, smart_canary: int = cascade.SMART_CANARY_ROWS) -> dict[str, DataFrame]:
    """Label every row with the cheap model, those of medium confidence with the smart one, and merge: labels, summary of the run, of the first stage.

    A stage whose canary fails stops the run before the rest is called.
    """
    first, first_summary = label_stage(sample, cheap, "cheap-stage", primary, rare, canary)
    sent = settled(cascade.to_escalate(first).select("cmplid"), "escalated")
    if sent.isEmpty():
        second = first.where("false")
    else:
        second, _ = label_stage(sample.join(sent, "cmplid", "left_semi"), smart, "smart-stage", primary, rare, smart_canary)
    merged = cascade.merge_stages(first, second, fields=_ANSWER[:-1])
    labelled = cascade.label_table(merged, primary, rare).withColumn("labeling_model", F.when(F.col("escalated"), F.lit(models[1])).otherwise(F.lit(models[0])))
    rows = settled(sample.join(labelled, "cmplid"), "labels")
    failed = F.count_if(F.col("component_label").isNull())
    totals = rows.agg(F.count("*").alias("n_rows"), failed.alias("n_failed"), F.sum("cost_usd").alias("cost_usd")).join(sent.agg(F.count("*").alias("n_escalated")))
    summary = totals.withColumn("share_escalated", ratio(F.col("n_escalated"), F.col("n_rows"))).withColumn("cost_per_100k", ratio(F.col("cost_usd"), F.col("n_rows")) * 100_000)
    return {"labels": rows, "summary": summary, "first_stage": first_summary}


def evaluate(replies: DataFrame, gold: DataFrame, complaints: DataFrame, published: float, fallback: str = "bucket_primary", primary: tuple[str, ...] = PRIMARY_CATEGORIES, rare: tuple[str, ...] = RARE_CATEGORIES) -> dict[str, DataFrame]:
    """Replies scored against the answer key: slices, macro-F1 with effective truth, the published accuracy, and years received."""
    results = settled(evaluation.score_replies(replies, gold, primary=primary, rare=rare), "results")
    pairs = evaluation.effective_pairs(results, fallback, primary, failures=True)
    report = evaluation.class_report(pairs, "truth", "answer")
    return evaluation.reproduction(results, complaints, published) | {"results": results, "report": report, "macro_f1": evaluation.macro_f1(report)}


def sample_current(incoming: DataFrame, blocked: list[DataFrame], cutoff: str, boosted: list[str], n: int = 150, n_boost: int = 50, seed: int = 20260919) -> dict[str, DataFrame]:
    """A blind labelling queue and its sealed twin: n rows at random, n_boost more of the boosted categories."""
    pool = sets.excluding(vehicles(incoming), "CMPLID", *blocked).where((F.col("LDATE") > cutoff) & (F.length("CDESCR") >= 20))
    pool = pool.withColumn("compdesc_top", top_level(F.col("COMPDESC"), ":"))
    first = sampling.uniform_sample(pool, n, "CMPLID", seed)
    more = sampling.remainder_sample(pool, first, F.col("compdesc_top").isin(*boosted), n_boost, "CMPLID", seed)
    sealed = model_columns(first.unionByName(more)).select(*BLIND, F.col("COMPDESC").alias("compdesc"), "compdesc_top", F.col("ODINO").alias("odino"))
    return {"blind": sealed.select(*BLIND), "sealed": sealed}


def replay_prepare(teacher: DataFrame, complaints: DataFrame, gold_ids: DataFrame, as_of: str, seed: int = 42) -> dict[str, DataFrame]:
    """Dated teacher labels up to a day, and monthly capped samples after it with their labels."""
    dates = complaints.select(F.col("CMPLID").alias("cmplid"), F.col("LDATE").alias("ldate"))
    dated = teacher.join(dates, "cmplid", "left")
    later = sets.excluding(vehicles(complaints).where(F.col("LDATE") > as_of), "CMPLID", gold_ids).withColumn("ym", F.substring("LDATE", 1, 6))
    monthly = sampling.stratified_sample(later, "ym", PER_MONTH, "CMPLID", seed)
    lookup = teacher.select(F.col("cmplid").alias("CMPLID"), F.col("component_label").alias("teacher_label"))
    return {"train": dated.where(F.col("ldate") <= as_of), "missing": dated.where("ldate is null"), "monthly": monthly.join(lookup, "CMPLID", "left")}


def build_census(spark: SparkSession, complaints: DataFrame, source: str, cutoff: str, built_at: str) -> DataFrame:
    census, totals = drift.from_rows(vehicles(complaints), F.col("LDATE"), top_level(F.col("COMPDESC"), ":", MERGE_MAP))
    return C.to_document(census, totals, source, cutoff, built_at)
