"""Registered queries over the driver's tables, each with the SQL that it must agree with.

Stand-ins: ``orders`` plays the complaint file (order date: day received, priority: hierarchical
code, status: product type, customer: incident), ``documents`` the narratives,
``labels`` the answer key, ``embeddings`` class scores, ``events`` live rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import cascade, census, compare, drift, evaluation, labels, sampling, scoring, sets
from ..schema import PRICES
from . import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SEED = 20260919
MERGE = {"4": "5"}
AS_OF, LAST_N, PRIOR = "199912", 24, 36
WIDE = "\\b(the|und|est|que)\\b"


def query(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql.strip()
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def complaints(spark: SparkSession, sf: str) -> DataFrame:
    """orders as complaints: id, incident, day, ym, dd, code, category, status, price."""
    o = table(spark, sf, "orders")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("incident"), day.alias("day"), X.month_of(day).alias("ym"), X.day_of(day).alias("dd"), F.col("o_orderpriority").alias("code"),
        X.top_level(F.col("o_orderpriority"), "-", MERGE).alias("category"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"),
    )


_O = """o as (select o_orderkey id, o_custkey incident, strftime(o_orderdate, '%Y%m%d') as day, strftime(o_orderdate, '%Y%m') as ym, cast(strftime(o_orderdate, '%d') as int) dd,
 o_orderpriority code, case trim(split_part(o_orderpriority, '-', 1)) when '4' then '5' else trim(split_part(o_orderpriority, '-', 1)) end category, o_orderstatus status, o_totalprice price from orders)"""


# Labels --------------------------------------------------------------------


@query(f"with {_O} select category, count(*) n from o where status = 'F' group by 1")
def label_histogram(spark, sf):
    return labels.histogram(complaints(spark, sf).where("status = 'F'"), "category")


_COVER = f"""{_O}, h as (select code, count(*) n from o group by 1),
c as (select code, n, row_number() over (order by n desc, code) as rank, sum(n) over (order by n desc, code rows unbounded preceding) / cast(sum(n) over () as double) cum from h),
k as (select *, rank <= least(35, (select count(*) from c where cum < 0.7) + 1) kept from c)"""


def _coverage(spark, sf):
    counts = complaints(spark, sf).groupBy("code").agg(F.count("*").alias("n"))
    return labels.label_coverage(counts, "code", 0.7)


@query(f"with {_COVER} select code, n, rank, round(cum, 6) cum, kept from k")
def label_coverage(spark, sf):
    return _coverage(spark, sf).select("code", "n", "rank", r6("cum").alias("cum"), "kept")


@query(f"with {_COVER} select o.id, case when k.kept then o.code else 'OTHER' end as label from o join k using (code)")
def label_assign(spark, sf):
    return labels.assign_labels(complaints(spark, sf), _coverage(spark, sf), "code").select("id", "label")


@query("select l_orderkey, l_linenumber, count(*) over (partition by l_orderkey) as group_size, count(*) over (partition by l_orderkey) > 1 as multi_row from lineitem")
def incident_group_size(spark, sf):
    return labels.group_size(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey").select("l_orderkey", "l_linenumber", "group_size", "multi_row")


@query("with c as (select l_orderkey, count(*) n from lineitem group by 1) select cast(sum(n) as bigint) n_rows, cast(sum(case when n > 1 then n else 0 end) as bigint) n_multi, round(sum(case when n > 1 then n else 0 end) / cast(sum(n) as double), 6) multi_share from c")
def multi_row_share(spark, sf):
    return labels.multi_row_share(table(spark, sf, "lineitem"), "l_orderkey").select("n_rows", "n_multi", r6("multi_share").alias("multi_share"))


@query(f"""with {_O}, c as (select code, count(*) n from o where status <> 'P' group by 1), u as (select distinct code from o)
select u.code, coalesce(n, 0) n, round(coalesce((select sum(n) from c) / cast((select count(*) from c) * n as double), 1.0), 6) weight from u left join c using (code)""")
def class_weights(spark, sf):
    rows = complaints(spark, sf)
    return labels.class_weights(rows.where("status <> 'P'"), "code", rows.select("code")).select("code", "n", r6("weight").alias("weight"))


@query("with s as (select l_returnflag, l_quantity q, row_number() over (partition by l_returnflag order by l_quantity) - 1 i, count(*) over (partition by l_returnflag) n from lineitem) select l_returnflag, q upper_median from s where i = n // 2")
def upper_median(spark, sf):
    return labels.upper_median(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity")


# Census --------------------------------------------------------------------


@query(f"with {_O} select ym, category, count(*) n from o group by 1, 2")
def month_census(spark, sf):
    return census.month_census(complaints(spark, sf))


@query("select strftime(l_shipdate, '%Y%m') as ym, l_returnflag category, count(*) n, max(cast(strftime(l_shipdate, '%d') as int)) max_day, grouping(l_returnflag) = 1 is_total from lineitem group by grouping sets ((strftime(l_shipdate, '%Y%m'), l_returnflag), (strftime(l_shipdate, '%Y%m')))")
def month_census_grouping_sets(spark, sf):
    day = F.date_format("l_shipdate", "yyyyMMdd")
    rows = table(spark, sf, "lineitem").select(X.month_of(day).alias("ym"), X.day_of(day).alias("day"), F.col("l_returnflag").alias("category"))
    return census.census_grouping_sets(rows).select("ym", "category", "n", "max_day", "is_total")


@query(f"with {_O} select ym, count(*) n, max(dd) max_day, max(dd) >= 28 complete from o group by 1")
def month_completeness(spark, sf):
    return census.month_totals(complaints(spark, sf), day="dd")


@query(f"""with {_O}, b as (select ym, category, count(*) n from o where status <> 'O' group by 1, 2), i as (select ym, category, count(*) n from o where status = 'P' group by 1, 2)
select * from b where ym not in (select ym from i) union all select * from i""")
def month_overlay(spark, sf):
    rows = complaints(spark, sf)
    return sets.overlay(census.month_census(rows.where("status <> 'O'")), census.month_census(rows.where("status = 'P'")), "ym")


@query(f"with {_O} select ym, category, count(*) n from o group by 1, 2")
def census_json_round_trip(spark, sf):
    rows = complaints(spark, sf)
    totals = census.month_totals(rows, day="dd")
    document = census.to_document(census.month_census(rows), totals, "orders", "20010801", "2001-08-01T00:00:00")
    return census.from_document(document)[0]


@query(f"with {_O} select distinct category from o")
def category_universe(spark, sf):
    return census.universe(census.month_census(complaints(spark, sf)))


# Drift -----------------------------------------------------------------------

_D = f"""{_O}, c as (select ym, category, count(*) n from o group by 1, 2), t as (select ym, count(*) n, max(dd) max_day from o group by 1),
pool as (select category, sum(n) pool_n, sum(n) / cast(sum(sum(n)) over () as double) q from c where ym between '199501' and '199712' group by 1),
pq as (select t.ym, t.n mn, coalesce(c.n, 0) / cast(t.n as double) p, coalesce(pool.q, 0.0) q from t cross join (select distinct category from c) u left join c on c.ym = t.ym and c.category = u.category left join pool on pool.category = u.category),
d as (select ym, max(mn) n, sqrt(greatest(0.0, sum(case when p > 0 then 0.5 * p * ln(p / greatest((p + q) / 2, 1e-12)) else 0 end + case when q > 0 then 0.5 * q * ln(q / greatest((p + q) / 2, 1e-12)) else 0 end))) distance from pq group by 1),
line as (select avg(distance) mean, stddev_samp(distance) sd, avg(distance) + 2 * stddev_samp(distance) threshold from d where ym between '199801' and '199912'),
w as (select t.ym as month, t.n, d.distance, t.max_day, t.max_day >= 28 complete, d.distance > line.threshold trip from t join d using (ym) cross join line where t.ym > '199912'),
f as (select month, trip, lag(trip) over (order by month) before, lag(month) over (order by month) previous_month from w where complete)"""


#: The same rows with everything put down to one category from a month on, and a month after it that is cut short.
_OS = _O.replace("o as (", "o0 as (", 1) + ", o as (select * replace (case when ym >= '200006' then '3' else category end as category) from o0 where not (ym = '200007' and dd >= 28))"
_DS = _D.replace(_O, _OS)


def shifted(spark, sf):
    rows = complaints(spark, sf).where("not (ym = '200007' and dd >= 28)")
    return rows.withColumn("category", F.when(F.col("ym") >= "200006", F.lit("3")).otherwise(F.col("category")))


def _rule(spark, sf, rows=None):
    rows = complaints(spark, sf) if rows is None else rows
    return drift.mix_rule(census.month_census(rows), census.month_totals(rows, day="dd"), AS_OF, LAST_N, PRIOR)


@query(f"with {_D} select category, cast(pool_n as bigint) pool_n, round(q, 6) q from pool")
def drift_pool_mix(spark, sf):
    return _rule(spark, sf)["pool"].select("category", "pool_n", r6("q").alias("q"))


@query(f"with {_D} select ym, n, round(distance, 6) distance from d")
def drift_distance(spark, sf):
    return _rule(spark, sf)["distances"].select("ym", "n", r6("distance").alias("distance"))


@query(f"with {_D} select round(mean, 6) mean, round(sd, 6) sd, round(threshold, 6) threshold from line")
def drift_threshold(spark, sf):
    return _rule(spark, sf)["line"].select(r6("mean").alias("mean"), r6("sd").alias("sd"), r6("threshold").alias("threshold"))


@query(f"with {_D} select month, n, round(distance, 6) distance, max_day, complete, trip from w")
def drift_walk(spark, sf):
    return _rule(spark, sf)["walk"].select("month", "n", r6("distance").alias("distance"), "max_day", "complete", "trip")


@query(f"with {_DS} select month, previous_month from f where trip and before order by month limit 1")
def drift_first_fire(spark, sf):
    return _rule(spark, sf, shifted(spark, sf))["fire"]


@query(f"with {_DS} select count(*) filter (trip) n_over, count(*) filter (trip and complete) n_over_complete, count(*) filter (trip and not complete) n_partial from w")
def drift_summary(spark, sf):
    return _rule(spark, sf, shifted(spark, sf))["summary"]


@query(f"with {_D} select month, previous_month from f where trip and before order by month limit 1")
def drift_no_fire(spark, sf):
    return _rule(spark, sf)["fire"]


@query(f"with {_DS}, g as (select min(month) fire_month, min_by(previous_month, month) previous_month from f where trip and before) select fire_month, previous_month, (select count(*) from o where fire_month is not null and ym <= fire_month) n_teacher_through_fire, fire_month is not null retrain, false promote, false launch from g")
def retrain_decision(spark, sf):
    rows = shifted(spark, sf)
    return jobs.retrain_decision(_rule(spark, sf, rows)["fire"], rows.select(F.col("day").alias("ldate")))


@query(f"with {_O}, m as (select distinct ym from o) select ym, strftime(strptime(ym, '%Y%m') - to_months(1), '%Y%m') as before, strftime(strptime(ym, '%Y%m') + to_months(13), '%Y%m') as later, cast(date_diff('month', strptime((select min(ym) from m), '%Y%m'), strptime(ym, '%Y%m')) + 1 as int) as n_since from m")
def month_arithmetic(spark, sf):
    """Months before and after each month of the table, and how many the series since its first month has."""
    months = complaints(spark, sf).select("ym").distinct()
    first = months.agg(F.min("ym").alias("first"))  # one row
    since = F.size(X.month_series(F.col("first"), F.col("ym")))
    return months.join(F.broadcast(first)).select("ym", X.add_months(F.col("ym"), -1).alias("before"), X.add_months(F.col("ym"), 13).alias("later"), since.alias("n_since"))


# Fingerprints and ledgers ------------------------------------------------------

_FP = r"concat(source, '||', left(trim(regexp_replace(text, '[ \t\n\f\r]+', ' ', 'g')), 400))"


def _prints(spark, sf):
    d = table(spark, sf, "documents")
    return d.withColumn("fp", X.fingerprint(F.col("source"), F.col("text")))


@query(f"select doc_id, {_FP} fp from documents")
def fingerprint(spark, sf):
    return _prints(spark, sf).select("doc_id", "fp")


@query(f"select doc_id, sha256({_FP}) as key from documents")
def fingerprint_sha256(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.fingerprint_hash(F.col("source"), F.col("text")).alias("key"))


_LEDGER = f"d as (select *, {_FP} fp from documents), known as (select distinct fp from d where doc_id in (select doc_id from labels))"


def _ledger(spark, sf):
    rows = _prints(spark, sf)
    return rows, rows.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("fp").distinct()


@query(f"with {_LEDGER} select doc_id from d where fp not in (select fp from known)")
def new_rows_anti(spark, sf):
    rows, known = _ledger(spark, sf)
    return sets.new_rows(rows, known, "fp").select("doc_id")


@query(f"with {_LEDGER} select sha256(fp) as key from known union select sha256(fp) from d")
def ledger_union(spark, sf):
    rows, known = _ledger(spark, sf)
    return sets.ledger_union(known, rows.select("fp")).select(F.sha2("fp", 256).alias("key"))


@query(f"with {_LEDGER}, n as (select * from d where fp not in (select fp from known)) select sha256(fp) as key, count(*) copies from n group by fp having count(*) > 1")
def ledger_dupes_kept(spark, sf):
    rows, known = _ledger(spark, sf)
    new = sets.new_rows(rows, known, "fp").groupBy("fp").agg(F.count("*").alias("copies"))
    return new.where("copies > 1").select(F.sha2("fp", 256).alias("key"), "copies")


# Dump comparison ---------------------------------------------------------------

_DUMPS = f"{_O}, old as (select * from o where status <> 'P'), new as (select id, day, case when status = 'O' and category = '5' then '5-LATE' else code end code, price from o where status <> 'F')"


def _dumps(spark, sf):
    rows = complaints(spark, sf)
    late = F.when((F.col("status") == "O") & (F.col("category") == "5"), F.lit("5-LATE")).otherwise(F.col("code"))
    return rows.where("status <> 'F'").select("id", "day", late.alias("code"), "price"), rows.where("status <> 'P'")


@query(f"""with {_DUMPS}, b as (select min(day) lo, max(day) hi from new), ow as (select id from old, b where day between lo and hi)
select (select count(*) from new) n_new, (select count(*) from ow) n_old_window, (select count(*) from new where id not in (select id from old)) n_added,
 (select count(*) from ow where id not in (select id from new)) n_removed, (select count(*) from ow where id in (select id from new)) n_common""")
def dump_compare(spark, sf):
    new, old = _dumps(spark, sf)
    return compare.id_sets(new, old, "id", "day")


@query(f"""with {_DUMPS} select 'code' field, count(*) filter (n.code is distinct from p.code) n_changed from new n join old p using (id)
union all select 'price', count(*) filter (n.price is distinct from p.price) from new n join old p using (id)""")
def dump_field_changes(spark, sf):
    new, old = _dumps(spark, sf)
    return compare.field_changes(new, old, "id", ["code", "price"])


@query(f"with {_DUMPS} select id, n.code new_value, p.code old_value from new n join old p using (id) where n.code is distinct from p.code order by id limit 8")
def dump_change_examples(spark, sf):
    new, old = _dumps(spark, sf)
    return compare.change_examples(new, old, "id", "code")


_AUDIT = f"""d as (select *, {_FP} fp from documents), a as (select * from d where lang <> 'de' qualify row_number() over (partition by fp order by doc_id) = 1),
b as (select * from d where lang <> 'fr' qualify row_number() over (partition by fp order by doc_id desc) = 1)"""


@query(f"""with {_AUDIT} select count(*) filter (a.fp is not null and b.fp is not null) n_common, count(*) filter (b.fp is null) n_only_new, count(*) filter (a.fp is null) n_only_old,
 count(*) filter (a.fp is not null and b.fp is not null and a.doc_id is distinct from b.doc_id) n_changed_doc_id, count(*) filter (a.fp is not null and b.fp is not null and a.lang is distinct from b.lang) n_changed_lang from a full join b on a.fp = b.fp""")
def revision_audit(spark, sf):
    rows = _prints(spark, sf).select("fp", "doc_id", "lang")
    old = sets.last_per_key(rows.where("lang <> 'fr'"), ["fp"], ["doc_id"])
    return compare.revision_audit(rows.where("lang <> 'de'"), old, "fp", ["doc_id"], ["doc_id", "lang"])


@query(f"with {_AUDIT} select sha256(a.fp) as key, b.doc_id old_value, a.doc_id new_value, left(b.text, 180) as text from a join b on a.fp = b.fp where a.doc_id <> b.doc_id order by a.fp limit 6")
def revision_examples(spark, sf):
    rows = _prints(spark, sf)
    old = sets.last_per_key(rows.where("lang <> 'fr'"), ["fp"], ["doc_id"])
    found = compare.revision_examples(rows.where("lang <> 'de'"), old, "fp", ["doc_id"], "doc_id", "text")
    return found.select(F.sha2("fp", 256).alias("key"), "old_value", "new_value", F.left("text", F.lit(180)).alias("text"))


@query("select min(strftime(o_orderdate, '%Y%m%d')) first_day, max(strftime(o_orderdate, '%Y%m%d')) last_day from orders")
def date_range(spark, sf):
    return compare.date_range(complaints(spark, sf), "day")


# Leakage -------------------------------------------------------------------------


@query("select doc_id from documents where cast(doc_id as varchar) not in (select cast(doc_id as varchar) from labels)")
def leakage_exclusion(spark, sf):
    return sets.excluding(table(spark, sf, "documents"), "doc_id", table(spark, sf, "labels"), blocked_column="doc_id").select("doc_id")


@query("""select (select count(*) from documents) n_before, (select count(*) from documents where doc_id not in (select doc_id from labels)) n_after, (select count(distinct doc_id) from labels) n_blocked,
 (select count(*) from documents where doc_id in (select doc_id from labels)) n_found, true exact""")
def leakage_assert(spark, sf):
    docs, blocked = table(spark, sf, "documents"), table(spark, sf, "labels")
    kept = sets.excluding(docs, "doc_id", blocked, blocked_column="doc_id")
    return sets.exclusion_report(docs, kept, blocked, "doc_id", "doc_id").select("n_before", "n_after", "n_blocked", "n_found", "exact")


@query("select count(*) n_rows, count(distinct doc_id) n_keys, count(*) = count(distinct doc_id) is_unique from documents")
def id_uniqueness(spark, sf):
    return sets.is_unique(table(spark, sf, "documents"), "doc_id")


# Sampling --------------------------------------------------------------------------


@query(f"with {_O} select id from o order by md5(concat(id, '|{SEED}')), id limit 150")
def uniform_sample(spark, sf):
    return sampling.uniform_sample(complaints(spark, sf), 150, "id", SEED).select("id")


@query(f"with {_O} select id, ym from o qualify row_number() over (partition by ym order by md5(concat(id, '|{SEED}')), id) <= 7")
def stratified_sample(spark, sf):
    return sampling.stratified_sample(complaints(spark, sf), "ym", 7, "id", SEED).select("id", "ym")


@query(f"with {_O} select id, category from o qualify row_number() over (partition by category order by md5(concat(id, '|{SEED}')), id) <= 2000")
def stratified_sample_large_cap(spark, sf):
    return sampling.stratified_sample(complaints(spark, sf), "category", 2000, "id", SEED).select("id", "category")


@query(f"""with {_O}, s as (select id from o order by md5(concat(id, '|{SEED}')), id limit 150)
select id from o where category = '1' and id not in (select id from s) order by md5(concat(id, '|{SEED}')), id limit 50""")
def oversample_remainder(spark, sf):
    rows = complaints(spark, sf)
    taken = sampling.uniform_sample(rows, 150, "id", SEED)
    return sampling.remainder_sample(rows, taken, F.col("category") == "1", 50, "id", SEED).select("id")


@query(f"""with {_O} select id, case when count(*) over (partition by code) > 1 and row_number() over (partition by code order by md5(concat(id, '|{SEED}')), id) <= ceil(count(*) over (partition by code) * cast(0.15 as double)) then 'val' else 'train' end split from o""")
def train_val_split(spark, sf):
    return sampling.train_val_split(complaints(spark, sf), "code", "id", SEED).select("id", "split")


@query(f"with {_O}, p as (select id, row_number() over (order by day, id) position from o) select id, position, cast(case when position <= 250 then 0 else (position - 251) // 4000 + 1 end as int) chunk from p")
def canary_chunks(spark, sf):
    return sampling.canary_chunks(complaints(spark, sf), ["day", "id"], F.col("ym")).select("id", "position", "chunk")


@query(r"select doc_id, coalesce(regexp_matches(text, '(?i)(^|[^\pL\pN_])(the|und|est|que)($|[^\pL\pN_])'), false) found from documents")
def keyword_filter(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.mentions(F.col("text"), "(?iU)" + WIDE).alias("found"))


@query(f"""with p as (select *, coalesce(length(text) between 150 and 450, false) readable from documents), e as (select *, sum(cast(readable as int)) over (partition by lang) >= 7 enough from p)
select doc_id, lang from e where readable or not enough qualify row_number() over (partition by lang order by md5(concat(doc_id, '|{SEED}')), doc_id) <= 7""")
def readable_sample_fallback(spark, sf):
    return sampling.readable_sample(table(spark, sf, "documents"), "text", 7, "doc_id", SEED, group="lang").select("doc_id", "lang")


# Merges -----------------------------------------------------------------------------

_MERGE = f"{_O}, a as (select id, code from o where status <> 'P'), b as (select id, code from o where status <> 'F')"


def _halves(spark, sf):
    rows = complaints(spark, sf)
    return rows.where("status <> 'P'").select("id", "code"), rows.where("status <> 'F'").select("id", "code")


@query(f"with {_MERGE} select * from a union all select * from b where id not in (select id from a)")
def merge_labels_dedupe(spark, sf):
    return sets.merge_without_repeats(*_halves(spark, sf), "id")[0]


@query(f"with {_MERGE}, m as (select * from a union all select * from b where id not in (select id from a)) select m.code, count(a.id) n_before, count(*) n_after from m left join a using (id) group by 1")
def before_after_counts(spark, sf):
    a, b = _halves(spark, sf)
    merged = sets.merge_without_repeats(a, b, "id")[0]
    return sets.category_change(a, merged, "code")


@query(f"with {_O} select c.c_custkey, o.id, o.day, c.c_mktsegment from customer c left join o on o.incident = c.c_custkey and o.day <= '19991231'")
def teacher_date_left_join(spark, sf):
    dated = complaints(spark, sf).where("day <= '19991231'").select("incident", "id", "day")
    people = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return people.join(dated, people["c_custkey"] == dated["incident"], "left").select("c_custkey", "id", "day", "c_mktsegment")


@query(f"with {_O} select id, ym from o where day <= '19991231' and price between 50000 and 150000")
def asof_slice(spark, sf):
    return complaints(spark, sf).where("day <= '19991231' and price between 50000 and 150000").select("id", "ym")


@query(f"""with {_O}, s as (select * from o where day > '19991231' qualify row_number() over (partition by ym order by md5(concat(id, '|{SEED}')), id) <= 20)
select s.id, s.ym, c.c_mktsegment teacher_label from s left join customer c on c.c_custkey = s.incident and c.c_acctbal > 0""")
def monthly_sample_with_labels(spark, sf):
    sample = sampling.stratified_sample(complaints(spark, sf).where("day > '19991231'"), "ym", 20, "id", SEED)
    known = table(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey", F.col("c_mktsegment").alias("teacher_label"))
    return sample.join(known, sample["incident"] == known["c_custkey"], "left").select("id", "ym", "teacher_label")


# Evaluation ---------------------------------------------------------------------------

_EVAL = r"""e as (select d.doc_id, l.quality, l.toxic, d.lang, d.n_chars, (d.n_chars > 1500) = (l.quality = 1) correct, d.n_chars > 3000 is_hard,
 case when d.n_chars > 4000 then 'high' when d.n_chars > 1500 then 'medium' when d.n_chars > 300 then 'low' end confidence,
 case when d.n_chars > 2500 then 'Y' when d.n_chars > 500 then 'N' end pred_flag, case when l.toxic = 1 then 'Y' else 'N' end true_flag,
 case when regexp_matches(d.text, '(^|[^\pL\pN_])(the)($|[^\pL\pN_])') then 'en' when regexp_matches(d.text, '(^|[^\pL\pN_])(und)($|[^\pL\pN_])') then 'de' when regexp_matches(d.text, '(^|[^\pL\pN_])(que)($|[^\pL\pN_])') then 'es' else 'xx' end pred
 from documents d join labels l using (doc_id))"""
_WILSON = "greatest(0.0, (k/n + 3.8416/(2*n) - 1.96*sqrt((k/n*(1-k/n) + 3.8416/(4*n))/n)) / (1 + 3.8416/n))"
_WILSON_HI = "least(1.0, (k/n + 3.8416/(2*n) + 1.96*sqrt((k/n*(1-k/n) + 3.8416/(4*n))/n)) / (1 + 3.8416/n))"


def _results(spark, sf):
    d, n = table(spark, sf, "documents"), F.col("n_chars")
    rows = d.join(table(spark, sf, "labels"), "doc_id")
    has = lambda w: F.coalesce(F.col("text").rlike(rf"(?U)\b({w})\b"), F.lit(False))
    return rows.select(
        "doc_id", "quality", "toxic", "lang", "n_chars", ((n > 1500) == (F.col("quality") == 1)).alias("correct"), (n > 3000).alias("is_hard"),
        F.when(n > 4000, "high").when(n > 1500, "medium").when(n > 300, "low").alias("confidence"),
        F.when(n > 2500, "Y").when(n > 500, "N").alias("pred_flag"), F.when(F.col("toxic") == 1, "Y").otherwise("N").alias("true_flag"),
        F.when(has("the"), "en").when(has("und"), "de").when(has("que"), "es").otherwise("xx").alias("pred"),
    )


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


@query(f"""with {_EVAL}, s as (select 'all' slice, * from e union all select case when is_hard then 'hard' when not is_hard then 'easy' else 'missing' end, * from e), c as (select slice, count(*) n, cast(count(*) filter (correct) as double) k from s group by 1)
select slice, n, cast(k as bigint) k, round(k/n, 6) accuracy, round({_WILSON}, 6) lo, round({_WILSON_HI}, 6) hi from c""")
def accuracy_slices(spark, sf):
    return _rounded(evaluation.accuracy_slices(_results(spark, sf)), "accuracy", "lo", "hi")


@query(f"""with {_EVAL}, c as (select coalesce(confidence, 'missing') confidence, count(*) n, cast(count(*) filter (correct) as double) k from e group by 1)
select confidence, n, cast(k as bigint) k, round(k/n, 6) accuracy, round(n / cast(sum(n) over () as double), 6) share, round({_WILSON}, 6) lo, round({_WILSON_HI}, 6) hi from c""")
def accuracy_by_confidence(spark, sf):
    return _rounded(evaluation.accuracy_by(_results(spark, sf), F.col("confidence"), "confidence"), "accuracy", "lo", "hi", "share")


@query(f"with {_EVAL} select count(*) filter (pred_flag in ('Y', 'N')) n_eligible, count(*) filter (pred_flag = true_flag) n_agree, round(count(*) filter (pred_flag = true_flag) / cast(count(*) filter (pred_flag in ('Y', 'N')) as double), 6) agreement from e")
def flag_agreement(spark, sf):
    return _rounded(evaluation.flag_agreement(_results(spark, sf), "pred_flag", "true_flag"), "agreement")


_REPORT = f"""{_EVAL}, u as (select lang as label, 1 t, 0 p, cast(lang = pred as int) tp from e union all select pred, 0, 1, 0 from e), q as (select label, sum(tp) tp, sum(t) t, sum(p) p from u group by 1),
rep as (select label, case when p = 0 then 0.0 else tp / cast(p as double) end as precision, case when t = 0 then 0.0 else tp / cast(t as double) end recall, case when t + p = 0 then 0.0 else 2 * tp / cast(t + p as double) end f1, t support from q)"""


@query(f"with {_REPORT} select label, round(precision, 6) as precision, round(recall, 6) recall, round(f1, 6) f1, cast(support as bigint) support from rep")
def class_report(spark, sf):
    return _rounded(evaluation.class_report(_results(spark, sf), "lang", "pred"), "precision", "recall", "f1")


_MACRO = "count(*) n_labels, round(avg(f1), 6) macro_f1, round(avg(precision), 6) macro_precision, round(avg(recall), 6) macro_recall, round(sum(f1 * support) / sum(support), 6) weighted_f1"


@query(f"with {_REPORT} select {_MACRO} from rep")
def macro_f1_observed(spark, sf):
    found = evaluation.macro_f1(evaluation.class_report(_results(spark, sf), "lang", "pred"))
    return _rounded(found, "macro_f1", "macro_precision", "macro_recall", "weighted_f1")


@query(f"with {_REPORT}, fixed as (select unnest(['en', 'fr', 'de', 'es', 'it', 'pt']) as label), rep2 as (select fixed.label, coalesce(precision, 0) as precision, coalesce(recall, 0) recall, coalesce(f1, 0) f1, coalesce(support, 0) support from fixed left join rep using (label)) select {_MACRO} from rep2")
def macro_f1_fixed(spark, sf):
    universe = spark.createDataFrame([(v,) for v in ("en", "fr", "de", "es", "it", "pt")], "label string")
    found = evaluation.macro_f1(evaluation.class_report(_results(spark, sf), "lang", "pred", universe))
    return _rounded(found, "macro_f1", "macro_precision", "macro_recall", "weighted_f1")


_YEARS = (("1995-1996", 1995, 1996), ("1997-1998", 1997, 1998), ("1999-2000", 1999, 2000))


@query(f"""with {_O}, c as (select case when y between 1995 and 1996 then '1995-1996' when y between 1997 and 1998 then '1997-1998' when y between 1999 and 2000 then '1999-2000' else 'other' end bucket, count(*) n, cast(count(*) filter (price > 100000) as double) k from (select *, cast(left(day, 4) as int) y from o) group by 1)
select bucket, n, cast(k as bigint) k, round(k/n, 6) accuracy, round(n / cast(sum(n) over () as double), 6) share, round({_WILSON}, 6) lo, round({_WILSON_HI}, 6) hi from c""")
def year_bucket_accuracy(spark, sf):
    rows = complaints(spark, sf).select(F.substring("day", 1, 4).cast("int").alias("year"), (F.col("price") > 100000).alias("correct"))
    return _rounded(evaluation.year_bucket_accuracy(rows, "year", buckets=_YEARS), "accuracy", "lo", "hi", "share")


@query(f"""with {_EVAL}, a as (select count(*) filter (correct) a, count(*) n, count(*) filter (correct and is_hard) ah, count(*) filter (is_hard) nh, count(*) filter (quality = 1) b, count(*) filter (quality = 1 and is_hard) bh, count(*) filter (correct and lang = 'en') al, count(*) filter (quality = 1 and lang = 'en') bl, count(*) filter (lang = 'en') nl from e),
i as (select *, a/n::double ca, b/n::double cb, ah/nh::double ha, bh/nh::double hb, al/nl::double la, bl/nl::double lb from a),
v as (select *, (ca + 3.8416/(2*n) - 1.96*sqrt((ca*(1-ca) + 3.8416/(4*n))/n)) / (1 + 3.8416/n) alo, (ca + 3.8416/(2*n) + 1.96*sqrt((ca*(1-ca) + 3.8416/(4*n))/n)) / (1 + 3.8416/n) ahi,
 (cb + 3.8416/(2*n) - 1.96*sqrt((cb*(1-cb) + 3.8416/(4*n))/n)) / (1 + 3.8416/n) blo, (cb + 3.8416/(2*n) + 1.96*sqrt((cb*(1-cb) + 3.8416/(4*n))/n)) / (1 + 3.8416/n) bhi from i)
select cb > ca better, la - lb <= 0.02 legacy_ok, ha - hb <= 0.03 hard_ok, ahi < blo or bhi < alo intervals_apart, cb > ca and la - lb <= 0.02 and ha - hb <= 0.03 and (ahi < blo or bhi < alo) promote from v""")
def promotion_gate(spark, sf):
    e, hard, old = _results(spark, sf), F.col("is_hard"), F.col("lang") == "en"
    good = F.col("quality") == 1
    counts = e.agg(F.count_if("correct").alias("a"), F.count("*").alias("n"), F.count_if(F.col("correct") & hard).alias("ah"), F.count_if(hard).alias("nh"), F.count_if(good).alias("b"), F.count_if(good & hard).alias("bh"), F.count_if(F.col("correct") & old).alias("al"), F.count_if(good & old).alias("bl"), F.count_if(old).alias("nl"))
    row = lambda key, a, b, n: F.struct(F.lit(key).alias("key"), F.col(a).alias("champion_k"), F.col(n).alias("champion_n"), F.col(b).alias("challenger_k"), F.col(n).alias("challenger_n"))
    return evaluation.promotion_gate(counts.select(F.inline(F.array(row("current", "a", "b", "n"), row("legacy", "al", "bl", "nl"), row("hard", "ah", "bh", "nh")))))


@query(f"""with {_EVAL}, s as (select lang, count(*) n, count(*) filter (correct) k, count(*) filter (toxic = 1) / cast(count(*) as double) tox from e group by 1)
select lang, tox > 0.08 mix_alert, tox - 0.05 >= 0.05 unknown_alert, coalesce(((k/n::double + 3.8416/(2*n) + 1.96*sqrt((k/n::double*(1-k/n::double) + 3.8416/(4*n))/n)) / (1 + 3.8416/n)) < 0.9 - 0.05, false) check_alert from s""")
def alert_rules(spark, sf):
    s = _results(spark, sf).groupBy("lang").agg(F.count("*").alias("check_n"), F.count_if("correct").alias("check_k"), F.avg((F.col("toxic") == 1).cast("double")).alias("js"))
    zero = F.lit(0.0)
    signals = s.select("lang", "js", "check_n", "check_k", F.col("js").alias("unknown_rate"), F.lit(0.05).alias("unknown_base"), zero.alias("confidence"), zero.alias("confidence_base"), zero.alias("agreement"), zero.alias("agreement_base"), F.lit(0).alias("agreement_days"), zero.alias("disagreement"), zero.alias("disagreement_base"), F.lit(0.9).alias("champion_accuracy"))
    return evaluation.alerts(signals).select("lang", "mix_alert", "unknown_alert", "check_alert")


@query(f"""with {_EVAL}, s as (select doc_id, case when pred = 'xx' then null else pred end raw, lang from e), b as (select *, case when raw in ('en', 'es') then raw else 'OTHER' end bucket from s)
select doc_id cmplid, raw raw_component, case when raw is null then null when raw = lang then raw else bucket end pred, coalesce(raw is not null and (raw = lang or bucket = lang), false) correct, coalesce(raw not in ('en', 'es', 'de'), false) off_list from b""")
def gold_scoring(spark, sf):
    e = _results(spark, sf)
    reply = F.when(F.col("pred") == "xx", "cannot tell").otherwise(F.concat(F.lit('Answer: {"component": "'), F.col("pred"), F.lit('"} done')))
    gold = e.select(F.col("doc_id").alias("cmplid"), F.array("lang").alias("accept"))
    found = evaluation.score_replies(e.select(F.col("doc_id").alias("cmplid"), reply.alias("reply")), gold, primary=("en", "es"), rare=("de",))
    return found.select("cmplid", "raw_component", "pred", "correct", F.coalesce("off_list", F.lit(False)).alias("off_list"))


# Cascade --------------------------------------------------------------------------------

_RES = """m as (select l_orderkey || '-' || l_linenumber cmplid, unnest([{'m': 'cheap-a', 'c': l_quantity > 10, 't': 900, 'o': 60}, {'m': 'cheap-b', 'c': l_discount > 0.03, 't': 700, 'o': 50}, {'m': 'smart', 'c': l_quantity > 4, 't': 1500, 'o': 200}]) r, case when l_quantity > 30 then 'high' when l_quantity > 12 then 'medium' else 'low' end confidence, l_returnflag pred from lineitem),
r as (select cmplid, r.m model, r.c correct, confidence, pred, (r.t * 2.0 + r.o * 10.0) / 1e6 cost_usd, r.t * 2.0 / 1e6 input_cost_usd, r.t tokens_in, r.o tokens_out from m)"""


def _models(spark, sf):
    li, q = table(spark, sf, "lineitem"), F.col("l_quantity")
    answer = lambda name, ok, t, o: F.struct(F.lit(name).alias("model"), ok.alias("correct"), F.lit(t).alias("tokens_in"), F.lit(o).alias("tokens_out"))
    rows = li.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("cmplid"), F.when(q > 30, "high").when(q > 12, "medium").otherwise("low").alias("confidence"), F.col("l_returnflag").alias("pred"),
        F.inline(F.array(answer("cheap-a", q > 10, 900, 60), answer("cheap-b", F.col("l_discount") > 0.03, 700, 50), answer("smart", q > 4, 1500, 200))),
    )
    cost = F.col("tokens_in") * F.lit(2.0) / 1e6
    return rows.withColumn("cost_usd", cost + F.col("tokens_out") * F.lit(10.0) / 1e6).withColumn("input_cost_usd", cost).withColumn("error", F.lit(None).cast("string"))


@query(f"""with {_RES}, p as (select a.model cheap, b.model smart, x.policy, (x.policy = 'medium' and a.confidence = 'medium') or (x.policy = 'low_and_medium' and a.confidence in ('low', 'medium')) up, a.correct ca, b.correct cb, a.cost_usd ka, b.cost_usd kb from r a join r b using (cmplid) cross join (select unnest(['medium', 'low_and_medium']) policy) x where a.model in ('cheap-a', 'cheap-b') and b.model in ('smart', 'cheap-b') and a.model <> b.model),
g as (select cheap, smart, policy, count(*) n, avg(up::int) escalated, avg((case when up then cb else ca end)::int) accuracy, avg(ka + case when up then kb else 0 end) c from p group by all)
select cheap, smart, policy, n, round(escalated, 6) escalated, round(accuracy, 6) accuracy, round(sqrt(accuracy * (1 - accuracy) / n), 6) se, round(c * 100000, 4) cost_per_100k from g""")
def cascade_backtest_grid(spark, sf):
    found = cascade.backtest(_models(spark, sf), ["cheap-a", "cheap-b"], ["smart", "cheap-b"])
    return _rounded(found, "escalated", "accuracy", "se").withColumn("cost_per_100k", F.round("cost_per_100k", 4))


@query(f"with {_RES} select model, count(*) n, round(avg(correct::int), 6) accuracy, round(sqrt(avg(correct::int) * (1 - avg(correct::int)) / count(*)), 6) se, round(avg(cost_usd) * 100000, 4) cost_per_100k from r group by 1")
def cascade_solo(spark, sf):
    return _rounded(cascade.solo(_models(spark, sf)), "accuracy", "se").withColumn("cost_per_100k", F.round("cost_per_100k", 4))


_STAGE = """a as (select l_orderkey || '-' || l_linenumber cmplid, case when l_quantity > 2 then l_returnflag end component, case when l_quantity > 30 then 'high' when l_quantity > 12 then 'medium' else 'low' end confidence, case when l_quantity <= 2 then 'parse' end as error, l_quantity / 1e6 cost_usd from lineitem),
b as (select l_orderkey || '-' || l_linenumber cmplid, l_linestatus component, case when l_tax > 0.06 then 'timeout' end as error, l_tax / 1e3 cost_usd from lineitem where l_quantity > 12 and l_quantity <= 30)"""


def _stages(spark, sf):
    li, q = table(spark, sf, "lineitem"), F.col("l_quantity")
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("cmplid")
    a = li.select(key, F.when(q > 2, F.col("l_returnflag")).alias("component"), F.when(q > 30, "high").when(q > 12, "medium").otherwise("low").alias("confidence"), F.when(q <= 2, "parse").alias("error"), (q / 1e6).alias("cost_usd"))
    b = li.where((q > 12) & (q <= 30)).select(key, F.col("l_linestatus").alias("component"), F.when(F.col("l_tax") > 0.06, "timeout").alias("error"), (F.col("l_tax") / 1e3).alias("cost_usd"))
    return a, b


@query(f"with {_STAGE} select a.cmplid, case when b.cmplid is not null and b.error is null then b.component else a.component end component, a.confidence, case when b.cmplid is not null and b.error is null then null else a.error end as error, b.cmplid is not null and b.error is null escalated, round(a.cost_usd + case when b.cmplid is not null and b.error is null then b.cost_usd else 0 end, 9) cost_usd from a left join b using (cmplid)")
def cascade_merge(spark, sf):
    return cascade.merge_stages(*_stages(spark, sf)).withColumn("cost_usd", F.round("cost_usd", 9))


@query(f"with {_STAGE} select count(*) n, count(*) filter (component is not null and error is null) n_parsed, count(error) n_errors, count(*) filter (component is not null and error is null and component not in ('A', 'N')) n_off_list, round(sum(cost_usd), 6) cost_usd, round(count(error) / count(*)::double, 6) error_rate, round(count(*) filter (component is not null and error is null) / count(*)::double, 6) parse_rate, round(count(*) filter (component is not null and error is null and component not in ('A', 'N')) / count(*) filter (component is not null and error is null)::double, 6) off_list_rate, count(error) / count(*)::double <= 0.05 and count(*) filter (component is not null and error is null) / count(*)::double >= 0.95 and sum(cost_usd) > 0 passed from a")
def canary_gate(spark, sf):
    summary = cascade.stage_summary(_stages(spark, sf)[0], ("A",), ("N",))
    return _rounded(cascade.canary_gate(summary), "cost_usd", "error_rate", "parse_rate", "off_list_rate")


@query(f"with {_STAGE} select cmplid from a where error is null and confidence = 'medium'")
def cascade_to_escalate(spark, sf):
    return cascade.to_escalate(_stages(spark, sf)[0]).select("cmplid")


@query(f"with {_RES} select cmplid, count(distinct model) n_models, count(distinct pred) = 1 same_answer, min(pred) answer from r group by 1 having count(distinct model) = 3 and not bool_or(correct)")
def universally_missed(spark, sf):
    return cascade.universally_missed(_models(spark, sf)).select("cmplid", "n_models", "same_answer", F.get("answers", 0).alias("answer"))


@query(f"with {_RES} select model, count(*) n, round(avg(correct::int), 6) accuracy, avg(tokens_in) tokens_in, avg(tokens_out) tokens_out, round(avg(cost_usd) * 1000, 6) cost_per_1k, round(sum(input_cost_usd) / sum(cost_usd), 6) input_cost_share, count(*) filter (model = 'smart' and confidence = 'low') n_errors from r group by 1")
def model_table(spark, sf):
    failed = F.when((F.col("model") == "smart") & (F.col("confidence") == "low"), F.lit("timeout"))
    return _rounded(cascade.model_table(_models(spark, sf).withColumn("error", failed)), "accuracy", "cost_per_1k", "input_cost_share")


_VALUES = ", ".join(f"('{p}', '{m}', {a}::double, {b}::double, {c}::double)" for p, m, a, b, c in PRICES)
_CALLS = "calls as (select l_orderkey, l_linenumber, case l_linenumber % 4 when 0 then 'openai' when 1 then 'openai' when 2 then 'anthropic' else 'anthropic' end provider, case l_linenumber % 4 when 0 then 'gpt-5.4-mini-2026-03-17' when 1 then 'gpt-5.4' when 2 then 'claude-haiku-4-5' else 'nobody' end model, l_quantity uncached, l_tax * 100 cached, l_discount * 1000 as output, l_linenumber written, l_returnflag = 'A' batch from lineitem)"


def _calls(spark, sf):
    li = table(spark, sf, "lineitem")
    kind = F.col("l_linenumber") % 4
    model = F.when(kind == 0, "gpt-5.4-mini-2026-03-17").when(kind == 1, "gpt-5.4").when(kind == 2, "claude-haiku-4-5").otherwise("nobody")
    return li.select("l_orderkey", "l_linenumber", F.when(kind < 2, "openai").otherwise("anthropic").alias("provider"), model.alias("model"), F.col("l_quantity").alias("uncached"), (F.col("l_tax") * 100).alias("cached"), (F.col("l_discount") * 1000).alias("output"), F.col("l_linenumber").alias("written"), (F.col("l_returnflag") == "A").alias("batch"))


_PRICED = f"{_CALLS}, prices(provider, name, i, c, o) as (values {_VALUES}), pm as (select distinct provider, model from calls), best as (select pm.provider, pm.model, name priced_as, i, c, o from pm left join prices p on p.provider = pm.provider and (pm.model = name or starts_with(pm.model, name || '-')) qualify row_number() over (partition by pm.provider, pm.model order by length(name) desc nulls last, name) = 1)"


@query(f"with {_PRICED} select provider, model, priced_as, i rate_in, c rate_cached, o rate_out from best")
def price_prefix_join(spark, sf):
    return cascade.price_of(_calls(spark, sf), cascade.prices(spark))


@query(f"with {_PRICED} select l_orderkey, l_linenumber, round((uncached * i + cached * c + written * i * case when provider = 'anthropic' then 1.25::double else 1 end + output * o) / 1e6 * case when batch then 0.5::double else 1 end, 12) cost_usd from calls join best using (provider, model)")
def token_cost(spark, sf):
    found = cascade.with_cost(_calls(spark, sf), cascade.prices(spark))
    return found.select("l_orderkey", "l_linenumber", F.round("cost_usd", 12).alias("cost_usd"))


@query("select o_orderpriority, count(*) n from orders group by 1 order by 2 desc, 1 limit 1")
def most_common_value(spark, sf):
    return cascade.most_common(table(spark, sf, "orders"), "o_orderpriority")


# Text, JSON, vectors -------------------------------------------------------------------


@query("select event_id, cast(json_extract(regexp_extract('reply: ' || props || ' .', '(?s)\\{.*\\}'), '$.k') as bigint) k from events")
def json_extract_label(spark, sf):
    reply = F.concat(F.lit("reply: "), F.col("props"), F.lit(" ."))
    return table(spark, sf, "events").select("event_id", X.extract_json(reply, "k bigint")["k"].alias("k"))


@query("""with p as (select vec_id, unnest(embedding)::double v, generate_subscripts(embedding, 1) - 1 i from embeddings), s as (select vec_id, i, v, exp(v - max(v) over (partition by vec_id)) e from p), q as (select vec_id, i, v, e / sum(e) over (partition by vec_id) p, row_number() over (partition by vec_id order by v desc, i) rn from s)
select vec_id, cast(rn as int) as rank, cast(i as int) as label, round(p, 6) p from q where rn <= 3""")
def topk_probs(spark, sf):
    best = X.top_k(X.softmax(F.col("embedding")), 3)
    rows = table(spark, sf, "embeddings").select("vec_id", F.posexplode(best).alias("i", "t"))
    return rows.select("vec_id", (F.col("i") + 1).alias("rank"), F.col("t.label").cast("int").alias("label"), r6("t.p").alias("p"))


@query("select vec_id, cast(list_position(embedding, list_max(embedding)) - 1 as int) pred from embeddings")
def argmax_label(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", X.argmax(F.col("embedding")).alias("pred"))


@query("select doc_id, sha256('Make/Model/Year: ' || source || ' ' || lang || ' ' || n_chars || chr(10) || 'Narrative: ' || text) prompt from documents")
def prompt_text(spark, sf):
    text = X.prompt_text(F.col("source"), F.col("lang"), F.col("n_chars").cast("string"), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(text, 256).alias("prompt"))


@query("""select doc_id, '{"component":"' || lang || '","crash":"' || case when toxic = 1 then 'Y' else 'N' end || '","fire":"N","injured":' || quality || ',"deaths":0}' target from documents join labels using (doc_id)""")
def target_json(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    target = X.target_json(F.col("lang"), F.when(F.col("toxic") == 1, "Y").otherwise("N"), F.lit("N"), F.col("quality").cast("string"), F.lit("x"))
    return rows.select("doc_id", target.alias("target"))


@query("select conv_id, max(turn) turn, max_by(role, turn) as role, max_by(text, turn) as text from conversations group by 1")
def label_log_upsert(spark, sf):
    return sets.last_per_key(table(spark, sf, "conversations"), ["conv_id"], ["turn"]).select("conv_id", "turn", "role", "text")


@query("select (select count(distinct doc_id) from labels) n_done, (select count(distinct doc_id) from documents) n_total")
def queue_progress(spark, sf):
    done = table(spark, sf, "labels").agg(F.countDistinct("doc_id").alias("n_done"))
    return done.join(table(spark, sf, "documents").agg(F.countDistinct("doc_id").alias("n_total")))


@query("""select count(*) n, min(strftime(ts, '%Y%m%d')) first_day, max(strftime(ts, '%Y%m%d')) last_day, round(median(value / 1000), 6) median_confidence, round(count(*) filter (event_type = 'click') / count(*)::double, 6) unknown_rate, round(count(*) filter (value / 1000 < 0.05) / count(*)::double, 6) low_rate, round(count(*) filter (event_type = 'view') / count(*)::double, 6) agree_rate from events""")
def incoming_summary(spark, sf):
    e = table(spark, sf, "events").select(F.date_format("ts", "yyyyMMdd").alias("day"), F.col("event_type").alias("pred"), (F.col("value") / 1000).alias("confidence"), F.lit("view").alias("field"))
    return _rounded(scoring.incoming_summary(e, "day", "field", "click", 0.05), "median_confidence", "unknown_rate", "low_rate", "agree_rate")


@query("select doc_id, trim(split_part(source, 'c', 2)) suffix, case when length(text) > 100 then left(text, 100) || '...' else text end shown, translate(source || '/' || lang || ':x', '/:', '__') file, concat_ws(' ', nullif(lang, 'en'), nullif(source, '')) joined from documents")
def text_helpers(spark, sf):
    d = table(spark, sf, "documents")
    file = X.safe_filename(F.concat("source", F.lit("/"), "lang", F.lit(":x")))
    joined = X.join_non_empty(F.nullif("lang", F.lit("en")), F.col("source"))
    return d.select("doc_id", X.after_last(F.col("source"), "c").alias("suffix"), X.shortened(F.col("text"), 100, "...").alias("shown"), file.alias("file"), joined.alias("joined"))


# Whole jobs -----------------------------------------------------------------------------


def complaint_file(spark: SparkSession, sf: str) -> DataFrame:
    """orders under the complaint file's column names, all strings."""
    o = complaints(spark, sf)
    text = F.concat(F.col("code"), F.lit(" received on "), F.col("day"))
    kind = F.when(F.col("status") == "F", "V").otherwise("C")
    return o.select(
        F.col("id").cast("string").alias("CMPLID"), F.col("incident").cast("string").alias("ODINO"), F.col("day").alias("LDATE"), F.col("code").alias("COMPDESC"), text.alias("CDESCR"), kind.alias("PROD_TYPE"),
        F.lit("m").alias("MAKETXT"), F.col("status").alias("MODELTXT"), F.substring("day", 1, 4).alias("YEARTXT"),
    )


_C = f"{_O}, cf as (select cast(id as varchar) CMPLID, cast(incident as varchar) ODINO, day LDATE, code COMPDESC, code || ' received on ' || day CDESCR, case when status = 'F' then 'V' else 'C' end PROD_TYPE, status, incident from o)"
_KEY = "sha256(ODINO || '||' || CDESCR)"


@query(f"""with {_C}, v as (select * from cf where PROD_TYPE = 'V'), h as (select COMPDESC, count(*) n from v group by 1), c as (select *, row_number() over (order by n desc, COMPDESC) r, sum(n) over (order by n desc, COMPDESC rows unbounded preceding) / cast(sum(n) over () as double) cum from h)
select CMPLID, case when r <= least(35, (select count(*) from c where cum < 0.99) + 1) then v.COMPDESC else 'OTHER' end COMPDESC_LABEL, count(*) over (partition by ODINO) odino_group_size, count(*) over (partition by ODINO) > 1 odino_multi_row from v join c using (COMPDESC)""")
def job_prepare(spark, sf):
    clean, _ = jobs.prepare_training_data(complaint_file(spark, sf))
    return clean.select("CMPLID", "COMPDESC_LABEL", "odino_group_size", "odino_multi_row")


@query(f"""with {_C}, gold as (select cast(doc_id as varchar) id from labels), k as (select * from cf where PROD_TYPE = 'V' and CMPLID not in (select id from gold))
select CMPLID, COMPDESC from k qualify row_number() over (partition by COMPDESC order by md5(concat(CMPLID, '|42')), CMPLID) <= 40""")
def job_training_sample(spark, sf):
    clean, _ = jobs.prepare_training_data(complaint_file(spark, sf))
    gold = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return jobs.build_training_sample(clean, gold, cap=40).select("CMPLID", "COMPDESC")


@query(f"""with {_C}, v as (select *, {_KEY} as key from cf where PROD_TYPE = 'V'), seen as (select distinct v.key from v join customer on c_custkey = incident where c_acctbal > 5000)
select CMPLID from v where LDATE > '19991231' and key not in (select key from seen)""")
def job_nightly_new(spark, sf):
    dump = complaint_file(spark, sf)
    known = table(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").cast("string").alias("ODINO"))
    seen = jobs.vehicles(dump).join(known, "ODINO", "left_semi").select(X.fingerprint_hash(F.col("ODINO"), F.col("CDESCR")).alias("key")).distinct()
    none = census.month_census(complaints(spark, sf)).where("false")
    totals = census.month_totals(complaints(spark, sf), day="dd").where("false")
    return jobs.nightly(dump, none, totals, seen, "19991231", AS_OF)["new"].select("CMPLID")


@query(f"""with {_C}, p as (select * from cf where PROD_TYPE = 'V' and LDATE > '19971231' and length(CDESCR) >= 20 and CMPLID not in (select cast(doc_id as varchar) from labels)),
a as (select * from p order by md5(concat(CMPLID, '|{SEED}')), CMPLID limit 150), b as (select * from p where COMPDESC like '1-%' and CMPLID not in (select CMPLID from a) order by md5(concat(CMPLID, '|{SEED}')), CMPLID limit 50)
select CMPLID cmplid, LDATE ldate, COMPDESC compdesc, ODINO odino from (select * from a union all select * from b)""")
def job_current_sample(spark, sf):
    blocked = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    dump = complaint_file(spark, sf)
    boosted = [r[0] for r in dump.where(F.col("COMPDESC").startswith("1-")).select("COMPDESC").distinct().collect()]  # a handful of codes
    return jobs.sample_current(dump, [blocked], "19971231", boosted)["sealed"].select("cmplid", "ldate", "compdesc", "odino")


@query(f"""with {_C}, l as (select * from cf where PROD_TYPE = 'V' and LDATE > '19971231' and CMPLID not in (select cast(doc_id as varchar) from labels))
select l.CMPLID, left(LDATE, 6) ym, t.c_mktsegment teacher_label from l left join (select cast(c_custkey as varchar) CMPLID, c_mktsegment from customer) t using (CMPLID)
qualify row_number() over (partition by left(LDATE, 6) order by md5(concat(l.CMPLID, '|42')), l.CMPLID) <= 2000""")
def job_replay_monthly(spark, sf):
    teacher = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("cmplid"), F.col("c_mktsegment").alias("component_label"))
    gold = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return jobs.replay_prepare(teacher, complaint_file(spark, sf), gold, "19971231")["monthly"].select("CMPLID", "ym", "teacher_label")


# Streams and models ----------------------------------------------------------------------


@query(f"with {_O} select ym, category, count(*) n from o where ym >= '200006' or id % 3 <> 0 group by 1, 2")
def stream_month_census(spark, sf):
    """Two dumps: a thinned one of everything, then all rows of the last months, which replace theirs."""
    from ..streaming.replay import replay_census

    rows = complaints(spark, sf).select("id", "ym", F.col("dd").alias("day"), "category")
    return replay_census([rows.where("id % 3 <> 0").drop("id"), rows.where("ym >= '200006'").drop("id")])[0]


@query("""with e as (select event_id, event_type || '|' || user_id as key, user_id from events), a as (select * from e where user_id % 3 <> 1)
select event_id, 0 batch from a union all select event_id, 1 from e where key not in (select key from a) union all select event_id, 2 from e where false""")
def stream_ledger(spark, sf):
    """Three dumps with repeated keys: some users, all users, some again."""
    from ..streaming.replay import replay_ledger

    rows = table(spark, sf, "events").select("event_id", "user_id", F.concat_ws("|", "event_type", F.col("user_id").cast("string")).alias("key"))
    return replay_ledger([rows.where("user_id % 3 <> 1"), rows, rows.where("user_id % 5 = 0")], "key").select("event_id", F.col("batch").cast("int").alias("batch"))


@query("select event_id from events where user_id % 2 = 0 and ts >= timestamp '2024-01-15'")
def stream_ledger_since(spark, sf):
    """The lower bound of the state: what lies before it is neither new nor remembered."""
    from ..streaming.replay import replay_ledger

    rows = table(spark, sf, "events").select("event_id", "user_id", "ts", F.col("event_id").cast("string").alias("key")).where("user_id % 2 = 0")
    return replay_ledger([rows.where("event_id % 4 = 0"), rows], "key", F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")).select("event_id")


@query(f"with {_DS} select 1 as batch, month, previous_month from (select * from f where trip and before order by month limit 1)")
def stream_first_fire(spark, sf):
    """The rule after each of two dumps: nothing fires after the first, which ends before the shift."""
    from ..streaming.replay import replay_fire

    rows = shifted(spark, sf).select("ym", F.col("dd").alias("day"), "category")
    fires = replay_fire([rows.where("ym < '200006'"), rows.where("ym >= '200006'")], AS_OF, LAST_N, PRIOR)
    found = [(i, f["month"], f["previous_month"]) for i, f in enumerate(fires) if f]  # one a dump
    return spark.createDataFrame(found, "batch int, month string, previous_month string")


@query("select date_trunc('day', ts) as day, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2")
def stream_daily_counts(spark, sf):
    from ..streaming.replay import replay_counts

    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    out = replay_counts(e, "ts", "event_type")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""with n as (select count(distinct quality) k from labels) select doc_id, cast(k as int) n_top, true as sorted, true as first_is_pred, true as shares from documents, n""")
def ml_score_shape(spark, sf):
    """What must hold of every scored row: up to three labels, best first, the first being the prediction, shares that add up to 1 at most."""
    scored = _ml_scored(spark, sf)
    top = F.from_json("top3", "array<struct<label: string, p: double>>")
    p = F.transform(top, lambda x: x["p"])
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    shares = (F.array_min(p) >= 0) & (total <= 1 + 1e-6) & (F.abs(F.col("confidence") - F.array_max(p)) < 1e-6)
    return scored.select("doc_id", F.size(top).alias("n_top"), (F.sort_array(p, asc=False) == p).alias("sorted"), (F.get(top, 0)["label"] == F.col("pred")).alias("first_is_pred"), shares.alias("shares"))


@query("select count(*) n, true as better_than_chance from documents join labels using (doc_id)")
def ml_score_training_fit(spark, sf):
    """Over the rows it was trained on, the classifier is right at least as often as the commonest label."""
    rows = _ml_scored(spark, sf).where("label is not null")
    most = rows.groupBy("label").count().agg(F.max("count").alias("most"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("label")).alias("k")).join(most).select("n", (F.col("k") >= F.col("most")).alias("better_than_chance"))


def _ml_scored(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", "text", F.col("quality").cast("string").alias("label"))
    return scoring.classify(rows, scoring.train_text_classifier(rows))


@query(None)
def ml_score(spark, sf):
    return _ml_scored(spark, sf).select("doc_id", "label", "pred", r6("confidence").alias("confidence"), "top3")
