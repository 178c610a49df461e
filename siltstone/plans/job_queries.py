"""Registered queries over whole jobs, sources and sinks, each with the SQL that it must agree with.

What a job gets from outside (label calls, a model) is replaced by a function of the row, so that SQL can say what comes out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import census, drift, evaluation, sampling, sets
from ..schema import COMPLAINT_COLUMNS, MERGE_MAP
from ..session import fresh_path
from ..sources import readers, sinks
from . import jobs
from .catalogue import _C, _EVAL, _MACRO, _O, _OS, _STAGE, _WILSON, _WILSON_HI, _YEARS, AS_OF, LAST_N, PRIOR, SEED, _results, _rounded, complaint_file, complaints, r6, shifted, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql.strip()
        return f

    return add


# The loop --------------------------------------------------------------------

_LOOP = f"""{_OS}, cf as (select cast(id as varchar) CMPLID, cast(incident as varchar) ODINO, day, category, status from o), v as (select *, ODINO || '||' || category || ' received on ' || day as fp from cf where status <> 'P'),
known as (select distinct fp from v where day < '20000101'), new as (select * from v where day >= '19990601' and fp not in (select fp from known))"""


def _loop(spark, sf):
    rows = shifted(spark, sf)
    text = F.concat("category", F.lit(" received on "), "day")
    kind = F.when(F.col("status") != "P", "V").otherwise("C")
    history = rows.select(F.col("id").cast("string").alias("CMPLID"), F.col("incident").cast("string").alias("ODINO"), F.col("day").alias("LDATE"), F.col("category").alias("COMPDESC"), text.alias("CDESCR"), kind.alias("PROD_TYPE"))
    _, ledger = jobs.pull(history.where("LDATE < '20000101'"), spark.createDataFrame([], "fingerprint string"))
    score = lambda new: new.withColumns({"pred": F.when(F.col("CMPLID").cast("long") % 3 == 0, "3").otherwise(F.lit("UNKNOWN OR OTHER")), "confidence": F.col("CMPLID").cast("long") % 10 / 10, "top3": F.lit("[]")})
    teacher = complaints(spark, sf).select(F.col("day").alias("ldate"))
    return jobs.loop(history.where("LDATE >= '19990601'"), ledger, history, teacher, AS_OF, score, last_n=LAST_N, prior_months=PRIOR)


_LOOP_RULE = """c as (select left(day, 6) ym, category, count(*) n from v group by 1, 2), t as (select left(day, 6) ym, count(*) n, max(cast(right(day, 2) as int)) max_day from v group by 1),
pool as (select category, sum(n) / cast(sum(sum(n)) over () as double) q from c where ym between '199501' and '199712' group by 1),
pq as (select t.ym, t.n mn, coalesce(c.n, 0) / cast(t.n as double) p, coalesce(pool.q, 0.0) q from t cross join (select distinct category from c) u left join c on c.ym = t.ym and c.category = u.category left join pool on pool.category = u.category),
d as (select ym, sqrt(greatest(0.0, sum(case when p > 0 then 0.5 * p * ln(p / greatest((p + q) / 2, 1e-12)) else 0 end + case when q > 0 then 0.5 * q * ln(q / greatest((p + q) / 2, 1e-12)) else 0 end))) distance from pq group by 1),
line as (select avg(distance) + 2 * stddev_samp(distance) threshold from d where ym between '199801' and '199912'),
w as (select t.ym as month, d.distance > line.threshold trip from t join d using (ym) cross join line where t.ym > '199912' and t.max_day >= 28),
f as (select month, trip, lag(trip) over (order by month) before, lag(month) over (order by month) previous_month from w),
g as (select min(month) fire_month, min_by(previous_month, month) previous_month from f where trip and before)"""


@query(f"""with {_LOOP}, {_LOOP_RULE} select fire_month, previous_month, (select count(*) from orders where strftime(o_orderdate, '%Y%m') <= fire_month) n_teacher_through_fire, fire_month is not null retrain, false promote, false launch from g""")
def job_loop_decision(spark, sf):
    return _loop(spark, sf)["decision"]


@query(f"""with {_LOOP}, s as (select *, case when cast(CMPLID as bigint) % 3 = 0 then '3' else 'UNKNOWN OR OTHER' end pred, cast(CMPLID as bigint) % 10 / 10 confidence from new)
select count(*) n, min(day) first_day, max(day) last_day, round(median(confidence), 6) median_confidence, round(count(*) filter (pred = 'UNKNOWN OR OTHER') / count(*)::double, 6) unknown_rate, round(count(*) filter (confidence < 0.5) / count(*)::double, 6) low_rate, round(count(*) filter (pred = category) / count(*)::double, 6) agree_rate from s""")
def job_loop_score(spark, sf):
    return _rounded(_loop(spark, sf)["score"], "median_confidence", "unknown_rate", "low_rate", "agree_rate")


@query(f"with {_LOOP} select distinct fp as fingerprint from v where day >= '19990601' or fp in (select fp from known)")
def job_pull_ledger(spark, sf):
    return _loop(spark, sf)["ledger"]


@query(None)
def drift_slide(spark, sf):
    """Fires one after the other, each anchored at the one before (a loop, which SQL cannot say; tests hold it against the rule run by hand)."""
    census, totals = drift.from_rows(shifted(spark, sf), F.col("day"), F.col("category"))
    fires = drift.slide(census, totals, AS_OF, LAST_N, PRIOR)
    return spark.createDataFrame([tuple(f.values()) for f in fires], "as_of string, month string, previous_month string")  # one a fire


# Cascade labelling -----------------------------------------------------------

_CASCADE = """s as (select cast(o_orderkey as varchar) cmplid, o_orderkey % 50 + 1 as q, o_orderkey % 9 / 100 tax, case o_orderkey % 3 when 0 then 'A' when 1 then 'N' else 'R' end flag, o_orderstatus status, o_custkey % 7 + 1 line from orders),
a as (select *, case when q > 1 then flag end c1, case when q <= 1 then 'no usable JSON object' end e1, q > 12 and q <= 30 sent, (tax > 0.07 and line = 7) failed from s),
m as (select *, sent and not failed escalated, case when sent and not failed then status else c1 end component from a)"""


def _cascade(spark, sf):
    k = F.col("o_orderkey")
    flag = F.when(k % 3 == 0, "A").when(k % 3 == 1, "N").otherwise("R")
    sample = table(spark, sf, "orders").select(k.cast("string").alias("cmplid"), (k % 50 + 1).alias("q"), (k % 9 / 100).alias("tax"), flag.alias("flag"), F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 7 + 1).alias("line"))
    sure = F.when(F.col("q") > 30, "high").when(F.col("q") > 12, "medium").otherwise("low")

    def cheap(rows):
        reply = F.concat(F.lit('So: {"component": "'), "flag", F.lit('", "confidence": "'), sure, F.lit('"}'))
        return rows.withColumn("reply", F.when(F.col("q") > 1, reply).otherwise(F.lit("cannot say"))).withColumn("error", F.lit(None).cast("string")).withColumn("cost_usd", F.col("q") / 1e6)

    def smart(rows):
        failed = (F.col("tax") > 0.07) & (F.col("line") == 7)
        reply = F.concat(F.lit('{"component": "'), "status", F.lit('", "confidence": "high"}'))
        return rows.withColumn("reply", F.when(~failed, reply)).withColumn("error", F.when(failed, F.lit("timeout"))).withColumn("cost_usd", (F.col("tax") + 1) / 1e3)

    return jobs.cascade_labels(sample, cheap, smart, ("cheap", "smart"), ("A", "N"), ("R",))


@query(f"""with {_CASCADE} select cmplid, component, case when component in ('A', 'N') then component when component is not null then 'OTHER' end component_label, component not in ('A', 'N', 'R') off_list, case when escalated then null else e1 end as error, escalated,
 case when escalated then 'smart' else 'cheap' end labeling_model, round(q / 1e6 + case when escalated then (tax + 1) / 1e3 else 0 end, 9) cost_usd from m""")
def job_cascade_labels(spark, sf):
    found = _cascade(spark, sf)["labels"]
    return found.select("cmplid", "component", "component_label", "off_list", "error", "escalated", "labeling_model", F.round("cost_usd", 9).alias("cost_usd"))


@query(f"""with {_CASCADE} select count(*) n_rows, count(*) filter (component is null) n_failed, count(*) filter (sent) n_escalated, round(count(*) filter (sent) / count(*)::double, 6) share_escalated, round(sum(q / 1e6 + case when escalated then (tax + 1) / 1e3 else 0 end) / count(*) * 100000, 4) cost_per_100k from m""")
def job_cascade_summary(spark, sf):
    found = _cascade(spark, sf)["summary"]
    return found.select("n_rows", "n_failed", "n_escalated", r6("share_escalated").alias("share_escalated"), F.round("cost_per_100k", 4).alias("cost_per_100k"))


@query(f"with {_STAGE} select cmplid, component, case when component in ('A', 'N') then component when component is not null then 'OTHER' end component_label, component not in ('A', 'N') off_list from a")
def cascade_label_table(spark, sf):
    from ..operators import cascade
    from .catalogue import _stages

    return cascade.label_table(_stages(spark, sf)[0], ("A", "N"), ()).select("cmplid", "component", "component_label", "off_list")


# Evaluation ------------------------------------------------------------------

_DATED = f"{_EVAL}, dated as (select e.*, o_orderkey is not null found, cast(strftime(o_orderdate, '%Y') as int) y from e left join orders on o_orderkey = doc_id + 12)"


def _reproduction(spark, sf):
    results = _results(spark, sf).withColumn("cmplid", F.col("doc_id") + 12)
    dates = table(spark, sf, "orders").select(F.col("o_orderkey").alias("cmplid"), F.date_format("o_orderdate", "yyyyMMdd").alias("ldate"))
    return evaluation.reproduction(results, dates.unionByName(dates), 0.5, _YEARS)


@query(f"""with {_DATED}, c as (select case when y between 1995 and 1996 then '1995-1996' when y between 1997 and 1998 then '1997-1998' when y between 1999 and 2000 then '1999-2000' when y is null then 'unknown' else 'other' end bucket, count(*) n, cast(count(*) filter (correct) as double) k from dated group by 1)
select bucket, n, cast(k as bigint) k, round(k/n, 6) accuracy, round(n / cast(sum(n) over () as double), 6) share, round({_WILSON}, 6) lo, round({_WILSON_HI}, 6) hi from c""")
def job_evaluate_by_year(spark, sf):
    return _rounded(_reproduction(spark, sf)["by_year"], "accuracy", "share", "lo", "hi")


@query(f"with {_DATED} select count(*) filter (not found) n_missing from dated")
def job_evaluate_missing_dates(spark, sf):
    return _reproduction(spark, sf)["missing"]


@query(f"with {_EVAL}, a as (select count(*) filter (correct) / count(*)::double accuracy from e) select round(accuracy, 6) accuracy, 0.5::double published, round(accuracy, 3) = 0.5 passed, round(abs(accuracy - 0.5), 6) abs_diff from a")
def job_evaluate_published(spark, sf):
    return _rounded(_reproduction(spark, sf)["check"], "accuracy", "abs_diff")


_EFFECTIVE = f"""{_EVAL}, s as (select case when pred = 'xx' then null else pred end raw, lang from e), b as (select *, case when raw in ('en', 'es') then raw when raw is not null then 'OTHER' end bucket, case when lang in ('en', 'es') then lang else 'OTHER' end truth0 from s),
p as (select case when coalesce(raw = lang or bucket = lang, false) then case when raw = lang then raw else bucket end else truth0 end truth, coalesce(case when raw = lang then raw else bucket end, 'PARSE_FAILURE') answer from b),
u as (select truth as label, 1 t, 0 p, cast(truth = answer as int) tp from p union all select answer, 0, 1, 0 from p), q as (select label, sum(tp) tp, sum(t) t, sum(p) p from u group by 1),
rep as (select label, case when p = 0 then 0.0 else tp / cast(p as double) end as precision, case when t = 0 then 0.0 else tp / cast(t as double) end recall, case when t + p = 0 then 0.0 else 2 * tp / cast(t + p as double) end f1, t support from q)"""


def _evaluated(spark, sf):
    e = _results(spark, sf)
    reply = F.when(F.col("pred") == "xx", "cannot tell").otherwise(F.concat(F.lit('{"component": "'), F.col("pred"), F.lit('"}')))
    gold = e.select(F.col("doc_id").alias("cmplid"), F.array("lang").alias("accept"), F.col("lang").alias("primary"), "is_hard")
    dates = table(spark, sf, "orders").select(F.col("o_orderkey").alias("cmplid"), F.date_format("o_orderdate", "yyyyMMdd").alias("ldate"))
    return jobs.evaluate(e.select(F.col("doc_id").alias("cmplid"), reply.alias("reply")), gold, dates, 0.5, primary=("en", "es"), rare=("de",))


@query(f"with {_EFFECTIVE} select {_MACRO} from rep")
def macro_f1_effective(spark, sf):
    return _rounded(_evaluated(spark, sf)["macro_f1"], "macro_f1", "macro_precision", "macro_recall", "weighted_f1")


@query(f"with {_EFFECTIVE} select label, round(precision, 6) as precision, round(recall, 6) recall, round(f1, 6) f1, cast(support as bigint) support from rep")
def class_report_effective(spark, sf):
    return _rounded(_evaluated(spark, sf)["report"], "precision", "recall", "f1")


# Answer key, few-shot, training rows ---------------------------------------------

_GOLD = """d as (select d.*, quality from documents d join labels using (doc_id)), c as (select doc_id, source make, lang model, cast(n_chars as varchar) as year, left(text, 40) narrative, 'Y' nhtsa_crash, 'N' nhtsa_fire from d where doc_id % 3 <> 0),
g as (select doc_id cmplid, coalesce(make, 'extra') make, case when c.doc_id is null then 'm' else model end model, narrative, lang as primary, quality = 0 is_hard, case when d.doc_id % 2 = 0 then 'en' else lang end target, d.lang from d left join c using (doc_id))"""


def _gold(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    fields = lambda make, model, year, text: [make.alias("make"), model.alias("model"), year.alias("year"), text.alias("narrative"), F.lit("Y").alias("nhtsa_crash"), F.lit("N").alias("nhtsa_fire")]
    key = F.col("doc_id").alias("cmplid")
    found = d.where("doc_id % 3 <> 0").select(key, *fields(F.col("source"), F.col("lang"), F.col("n_chars").cast("string"), F.left("text", F.lit(40))))
    twice = found.unionByName(found.withColumn("make", F.lit("~ later")))
    extras = d.select(key, *fields(F.lit("extra"), F.lit("m"), F.lit("2020"), F.lit(None).cast("string")))
    judged = d.select(key, F.col("lang").alias("primary"), F.array("lang").alias("accept"), (F.col("quality") == 0).alias("is_hard"), F.lit("note").alias("note"), F.when(F.col("doc_id") % 2 == 0, "en").otherwise(F.col("lang")).alias("target_category"))
    return jobs.build_gold(judged, twice, extras)


@query(f"with {_GOLD} select cmplid, make, model, narrative, is_hard, coalesce(\"primary\" = target, false) confirmed from g")
def job_build_gold(spark, sf):
    return _gold(spark, sf).select("cmplid", "make", "model", "narrative", "is_hard", F.coalesce("confirmed_target_category", F.lit(False)).alias("confirmed"))


@query(f"with {_GOLD} select target category, count(*) filter (\"primary\" = target) || '/' || count(*) confirmed from g group by 1")
def job_gold_confirmed(spark, sf):
    return jobs.gold_report(_gold(spark, sf), _gold(spark, sf))["per_category"]


@query(f"with {_GOLD} select 2 * count(*) n, 2 * count(*) filter (is_hard) n_hard, count(*) n_new, count(*) filter (\"primary\" = target) n_confirmed, round(count(*) filter (\"primary\" = target) / count(*)::double, 6) confirmation_rate from g")
def job_gold_summary(spark, sf):
    return _rounded(jobs.gold_report(_gold(spark, sf), _gold(spark, sf))["summary"], "confirmation_rate")


_TOP = "case lang when 'en' then 'ENGINE' when 'de' then 'TRAILER HITCHES' when 'fr' then 'UNKNOWN OR OTHER' else 'AIR BAGS' end"
_TEXTS = f"""d as (select cast(doc_id as varchar) CMPLID, case when doc_id % 7 = 0 then text || ' and a fire' else text end t, {_TOP} as top, case when lang = 'de' then 'OTHER' else {_TOP} end as label from documents),
r as (select *, coalesce(length(t) between 150 and 450, false) readable, md5(concat(CMPLID, '|42')) h from d),
a as (select *, count(*) filter (readable) over (partition by label) >= 3 enough from r), b as (select *, count(*) filter (readable) over () >= 6 enough from r where regexp_matches(t, '(?i)\\b(fire|flame|caught on fire|smoke|burn(?:ed|ing)?)\\b') and label in ('ENGINE', 'AIR BAGS')),
c as (select *, count(*) filter (readable) over () >= 1 enough from r where top = 'TRAILER HITCHES'), e as (select *, count(*) filter (readable) over () >= 2 enough from r where label = 'UNKNOWN OR OTHER')"""
_PICK = "where (readable or not enough) qualify row_number() over ({} order by h, CMPLID) <= {}"


def text_file(spark, sf):
    """documents under the complaint file's column names."""
    d = table(spark, sf, "documents")
    top = F.when(F.col("lang") == "en", "ENGINE").when(F.col("lang") == "de", "TRAILER HITCHES").when(F.col("lang") == "fr", "UNKNOWN OR OTHER").otherwise("AIR BAGS")
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" and a fire"))).otherwise(F.col("text"))
    label = F.when(F.col("lang") == "de", "OTHER").otherwise(top)
    flag = lambda n: F.when(F.col("doc_id") % n == 0, "Y").otherwise("N")
    return d.select(
        F.col("doc_id").cast("string").alias("CMPLID"), text.alias("CDESCR"), top.alias("COMPDESC_TOP"), label.alias("COMPDESC_LABEL"), F.col("source").alias("MAKETXT"), F.col("lang").alias("MODELTXT"), F.lit("2020").alias("YEARTXT"),
        flag(4).alias("CRASH"), flag(5).alias("FIRE"), (F.col("doc_id") % 3).cast("string").alias("INJURED"), F.lit("x").alias("DEATHS"),
    )


@query(f"""with {_TEXTS} select CMPLID, 'per_class' kind from (select * from a {_PICK.format("partition by label", 3)}) union all select CMPLID, 'fire' from (select * from b {_PICK.format("", 6)})
union all select CMPLID, 'other_or_unknown' from (select * from c {_PICK.format("", 1)}) union all select CMPLID, 'other_or_unknown' from (select * from e {_PICK.format("", 2)})""")
def job_fewshot(spark, sf):
    return jobs.fewshot_candidates(text_file(spark, sf)).select("CMPLID", "kind")


@query("""select cast(doc_id as varchar) cmplid, '{"cmplid":"' || doc_id || '","make":"' || source || '","crash":"' || case when doc_id % 4 = 0 then 'Y' else 'N' end || '"}' example from documents where source is not null""")
def row_to_example(spark, sf):
    rows = text_file(spark, sf).where("MAKETXT is not null").withColumnRenamed("CRASH", "crash")
    return jobs.examples(rows, "CMPLID", "MAKETXT", "crash")


_LABELLED = """l as (select cast(doc_id as varchar) cmplid, case when lang = 'fr' then 'NO SUCH' else lang end raw, case when doc_id % 11 = 0 then 'timeout' end as error, case when doc_id % 4 = 0 then 'Y' when doc_id % 4 = 1 then 'N' end crash, 'N' fire, case when doc_id % 3 <> 0 then doc_id % 3 end injured, 0 deaths, source, lang, text from documents)"""


def _labelled(spark, sf):
    d = table(spark, sf, "documents")
    n = F.col("doc_id")
    return d.select(
        n.cast("string").alias("cmplid"), F.when(F.col("lang") == "fr", "NO SUCH").otherwise(F.col("lang")).alias("raw_component"), F.when(n % 11 == 0, "timeout").alias("error"), F.when(n % 4 == 0, "Y").when(n % 4 == 1, "N").alias("crash"), F.lit("N").alias("fire"),
        F.when(n % 3 != 0, n % 3).alias("injured"), F.lit(0).alias("deaths"), F.col("source").alias("make"), F.col("lang").alias("model"), F.lit("2020").alias("year"), F.col("text").alias("narrative"),
    )


@query(f"with {_LABELLED} select cmplid from l where raw in ('en', 'de', 'es') and error is null")
def training_rows_encoder(spark, sf):
    return jobs.training_rows(_labelled(spark, sf), ["en", "de", "es"]).select("cmplid")


@query(f"with {_LABELLED} select cmplid from l where raw in ('en', 'de', 'es') and error is null and crash in ('Y', 'N') and injured is not null")
def training_rows_generative(spark, sf):
    return jobs.training_rows(_labelled(spark, sf), ["en", "de", "es"], generative=True).select("cmplid")


@query(f"""with {_LABELLED} select cmplid, sha256('Make/Model/Year: ' || source || ' ' || lang || ' 2020' || chr(10) || 'Narrative: ' || text) prompt, '{{"component":"' || raw || '","crash":"' || crash || '","fire":"N","injured":' || injured || ',"deaths":0}}' target from l where raw in ('en', 'de', 'es') and error is null and crash in ('Y', 'N') and injured is not null""")
def sft_examples(spark, sf):
    found = jobs.sft_examples(jobs.training_rows(_labelled(spark, sf), ["en", "de", "es"], generative=True))
    return found.select("cmplid", F.sha2("prompt", 256).alias("prompt"), "target")


@query(f"""with {_TEXTS} select CMPLID from d where top in ('TRAILER HITCHES', 'AIR BAGS') and CMPLID not in (select cast(doc_id as varchar) from labels) qualify row_number() over (partition by top order by md5(concat(CMPLID, '|42')), CMPLID) <= 800""")
def job_rare_topup(spark, sf):
    blocked = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return jobs.build_rare_topup(text_file(spark, sf), [blocked], ["TRAILER HITCHES", "AIR BAGS"]).select("CMPLID")


@query(f"""with {_TEXTS} select CMPLID, cast(CMPLID as bigint) % 3 injured, 0 deaths from d where top = 'TRAILER HITCHES' and CMPLID not in (select cast(doc_id as varchar) from labels) qualify row_number() over (partition by top order by md5(concat(CMPLID, '|42')), CMPLID) <= 7""")
def job_rare_gold(spark, sf):
    blocked = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    rows = text_file(spark, sf).withColumn("DEATHS", F.lit(None).cast("string"))
    return jobs.build_rare_gold(rows, [blocked], ["TRAILER HITCHES"]).select("CMPLID", "injured", "deaths")


_KINDS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW", "none")


@query(f"""with {_O}, k as (select unnest(['{"', '".join(_KINDS)}']) code), m as (select k.code, count(o.id) filter (status <> 'P') b, count(o.id) n from k left join o using (code) group by 1), s as (select 'before' side, b n from m union all select 'after', n from m)
select side, min(n) least, list_sort(list(n))[3] median, max(n) most from s group by 1""")
def job_merge_spread(spark, sf):
    rows = complaints(spark, sf).select("id", "code")
    return jobs.class_spread(complaints(spark, sf).where("status <> 'P'").select("id", "code"), rows, "code", _KINDS)


_TOPUP = """m as (select cast(doc_id as varchar) cmplid, case when doc_id % 2 = 0 then 'COMMUNICATION' else 'ENGINE' end raw from documents where doc_id % 5 <> 0), t as (select cast(doc_id as varchar) cmplid, 'CHILD SEAT' raw from documents where doc_id % 5 < 2),
u as (select * from m union all select * from t where cmplid not in (select cmplid from m))"""


def _topup(spark, sf):
    d = table(spark, sf, "documents")
    row = lambda raw: [F.col("doc_id").cast("string").alias("cmplid"), raw.alias("raw_component"), F.lit("ENGINE").alias("component_label")]
    main = d.where("doc_id % 5 <> 0").select(*row(F.when(F.col("doc_id") % 2 == 0, "COMMUNICATION").otherwise("ENGINE")))
    return jobs.merge_rare_topup(main, d.where("doc_id % 5 < 2").select(*row(F.lit("CHILD SEAT"))))


@query(f"with {_TOPUP} select (select count(*) from m) n_main, (select count(*) from u) n_merged, (select count(*) from t where cmplid in (select cmplid from m)) n_repeated")
def job_merge_sizes(spark, sf):
    return _topup(spark, sf)["sizes"]


@query(f"with {_TOPUP} select raw raw_component, (select count(*) from m where m.raw = u.raw) n_before, count(*) n_after from u where raw <> 'ENGINE' group by 1")
def job_merge_rare(spark, sf):
    return _topup(spark, sf)["rare"].where("n_after > 0")


@query(f"with {_C}, p as (select * from cf where PROD_TYPE = 'V' and LDATE > '19971231' and CMPLID not in (select cast(doc_id as varchar) from labels)) select CMPLID cmplid, LDATE ldate from p order by md5(concat(CMPLID, '|{SEED}')), CMPLID limit 150")
def job_blind_queue(spark, sf):
    blocked = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return jobs.sample_current(complaint_file(spark, sf), [blocked], "19971231", [])["blind"].select("cmplid", "ldate")


@query("select doc_id, case when lang = 'en' then 'ELECTRONIC STABILITY CONTROL' when lang = 'de' then 'COMMUNICATION' else lang end category from documents")
def recode_merges(spark, sf):
    code = F.when(F.col("lang") == "en", "ELECTRONIC STABILITY CONTROL (ESC):X").when(F.col("lang") == "de", "COMMUNICATIONS : Y").otherwise(F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", X.top_level(code, ":", MERGE_MAP).alias("category"))


@query("select l_orderkey, l_linenumber, round(l_discount, 3) = round(l_tax, 3) same from lineitem")
def same_to_three_decimals(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.same_to_3dp(F.col("l_discount"), F.col("l_tax")).alias("same"))


@query(f"select row_number() over (order by md5(concat(o_orderkey, '|{SEED}')), o_orderkey) as position, o_orderkey from orders")
def full_shuffle(spark, sf):
    """The order of a full shuffle, as positions; they are given per piece of the hash range."""
    rows = table(spark, sf, "orders").select("o_orderkey", X.hash_order(F.col("o_orderkey"), SEED).alias("h"))
    return sampling.positions(rows, ["h", "o_orderkey"], F.substring("h", 1, 2)).select("position", "o_orderkey")


# Sources and sinks, written and read again -----------------------------------------


@query("select n_nationkey, n_name from nation")
def scan_json_envelope(spark, sf):
    path = fresh_path(spark, "envelope")
    whole = table(spark, sf, "nation").agg(F.lit("s").alias("source"), F.collect_list(F.struct("n_nationkey", "n_name")).alias("rows"))  # 25 rows
    sinks.replace_folder(whole, lambda df, to: df.write.json(to), path)
    return readers.read_envelope(spark, path)


@query("select 'openai/' || case when n_regionkey < 2 then 'a' else 'b' end model_key, cast(n_nationkey as varchar) cmplid, n_nationkey * 10 as tokens from nation where n_nationkey % 4 <> 0")
def scan_eval_results(spark, sf):
    """One document a model, read through a glob; rows without usage are left out."""
    path = fresh_path(spark, "results")
    n = F.col("n_nationkey")
    rows = table(spark, sf, "nation").select(F.when(F.col("n_regionkey") < 2, "a").otherwise("b").alias("model"), n.cast("string").alias("cmplid"), F.when(n % 4 != 0, F.struct((n * 10).alias("input_tokens"))).alias("usage"))
    whole = rows.groupBy("model").agg(F.lit("openai").alias("provider"), F.lit(1.5).alias("elapsed_s"), F.collect_list(F.struct("cmplid", "usage")).alias("results"))
    for name in ("a", "b"):
        whole.where(F.col("model") == name).coalesce(1).write.mode("append").json(path)
    return readers.read_eval_results(spark, f"{path}/*.json").select("model_key", "cmplid", F.col("usage.input_tokens").alias("tokens"))


@query("select distinct trim(source) as key from documents where source is not null and trim(source) <> ''")
def scan_line_set(spark, sf):
    path = fresh_path(spark, "lines")
    sinks.write_sorted_lines(table(spark, sf, "documents").select(F.col("source").alias("key")), path)
    return readers.read_lines(spark, path)


@query("select cast(c_custkey as varchar) cmplid, case when c_custkey % 3 = 0 then 'new' else c_mktsegment end as label from customer union all select 'added', 'new'")
def upsert_label_log(spark, sf):
    """A log of JSON lines, replaced in place by what was read from it and an update."""
    path = fresh_path(spark, "log")
    log = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("cmplid"), F.col("c_mktsegment").alias("label"))
    sinks.upsert_json_lines(log, log.where("false"), path)
    added = spark.range(1).select(F.lit("added").alias("cmplid"), F.lit("new").alias("label"))
    update = log.where("cmplid % 3 = 0").withColumn("label", F.lit("new")).unionByName(added)
    sinks.upsert_json_lines(readers.read_json_lines(spark, path, "cmplid string, label string"), update, path)
    return readers.read_json_lines(spark, path, "cmplid string, label string")


@query("select s_suppkey, s_name from supplier")
def dated_copy(spark, sf):
    """A dated copy, found again through the name of the latest one; a source that is not there is empty."""
    folder = fresh_path(spark, "dated")
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    sinks.write_dated(rows.limit(0), folder, "20240101")
    sinks.write_dated(rows, folder, "20240201")
    latest = spark.read.text(f"{folder}/latest").first()[0]  # one line
    none = readers.read_if_exists(spark, f"{folder}/20230101", rows.schema)
    return readers.read_columns(spark, f"{folder}/{latest}", ["s_suppkey", "s_name"]).unionByName(none)


@query(f"with {_C} select CMPLID, LDATE, cast(incident % 4 as double) INJURED, case when incident % 2 = 0 then cast(incident as double) end MILES from cf")
def load_complaint_file(spark, sf):
    """A delimited dump, written with two broken lines, as a typed table: numbers as such, the over-long line dropped."""
    path = fresh_path(spark, "dump")
    number = F.col("ODINO").cast("long")
    rows = complaint_file(spark, sf).withColumn("INJURED", (number % 4).cast("string")).withColumn("MILES", F.when(number % 2 == 0, F.col("ODINO")).otherwise(F.lit("none")))
    fields = [F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit("") for c in COMPLAINT_COLUMNS]
    lines = rows.select(F.concat_ws("\t", *fields).alias("value"))
    broken = spark.range(1).select(F.repeat(F.lit("x\t"), len(COMPLAINT_COLUMNS)).alias("value"))
    lines.unionByName(broken).write.text(path)
    return jobs.load_data(spark, path, fresh_path(spark, "complaints")).select("CMPLID", "LDATE", "INJURED", "MILES")


@query("select c_custkey from customer where c_custkey not in (select doc_id from labels)")
def excluding_optional_ids(spark, sf):
    """Ids of an optional table block rows; a table that is not there blocks none."""
    path = fresh_path(spark, "ids")
    table(spark, sf, "labels").select(F.col("doc_id").alias("CMPLID")).write.parquet(path)
    found = [readers.read_ids(spark, path), readers.read_ids(spark, path + "-none")]
    return sets.excluding(table(spark, sf, "customer").select("c_custkey"), "c_custkey", *found)


@query(f"with {_C} select left(LDATE, 6) ym, trim(split_part(COMPDESC, ':', 1)) category, count(*) n from cf where PROD_TYPE = 'V' group by 1, 2")
def job_build_census(spark, sf):
    """The whole job: vehicle rows of the file to the nested document, read back as rows."""
    return census.from_document(jobs.build_census(spark, complaint_file(spark, sf), "orders", "20010801", "2001-08-01T00:00:00"))[0]
