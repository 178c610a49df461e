"""Registered queries over keyed state, selection, projected scans, feeds, bucketed dumps, sketches and SQL functions, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql as sql_functions
from ..operators import compare, quantiles, sets, sketches
from ..schema import COMPLAINT_COLUMNS
from ..session import fresh_path, settled
from ..sources import delimited, feed, readers, sinks
from ..streaming import replay
from ..streaming.state import MixRule
from .catalogue import _AUDIT, _DS, _DUMPS, _LEDGER, _O, AS_OF, LAST_N, PRIOR, SEED, _dumps, _ledger, _prints, complaints, r6, shifted, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BUCKETS = 16


def query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql.strip()
        return f

    return add


# State -----------------------------------------------------------------------


@query("""with e as (select event_id, event_type || '|' || user_id as key, user_id from events), a as (select * from e where user_id % 3 <> 1)
select event_id, 0 batch from a union all select event_id, 1 from e where key not in (select key from a)""")
def stream_keyed_ledger(spark, sf):
    """stream_ledger with the keys in the state store."""
    rows = table(spark, sf, "events").select("event_id", "user_id", F.concat_ws("|", "event_type", F.col("user_id").cast("string")).alias("key"))
    found = replay.replay_keyed_ledger([rows.where("user_id % 3 <> 1"), rows, rows.where("user_id % 5 = 0")], "key")
    return found.select("event_id", F.col("batch").cast("int").alias("batch"))


@query("select event_id from events where user_id % 2 = 0 and ts >= timestamp '2024-01-15'")
def stream_keyed_ledger_since(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts", F.col("event_id").cast("string").alias("key")).where("user_id % 2 = 0")
    return replay.replay_keyed_ledger([rows.where("event_id % 4 = 0"), rows], "key", F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")).select("event_id")


@query(f"with {_DS} select 1 as batch, 'all' as series, month, previous_month from (select * from f where trip and before order by month limit 1)")
def stream_state_machine(spark, sf):
    """stream_first_fire as a state machine: months, pool and line are state, and a dump touches its own months."""
    rows = shifted(spark, sf).select("ym", F.col("dd").alias("day"), "category")
    fires = replay.replay_mix_rule([rows.where("ym < '200006'"), rows.where("ym >= '200006'")], MixRule(AS_OF, LAST_N, PRIOR), F.lit("all"))
    return fires.withColumn("batch", F.col("batch").cast("int"))


@query(f"with {_O}, a as (select ym, category, count(*) n from o where id % 3 <> 0 group by 1, 2), b as (select ym, category, count(*) n from o where ym >= '200006' group by 1, 2) select * from a where ym < '200006' union all select * from b")
def stream_census_in_place(spark, sf):
    """stream_month_census on a table partitioned by month, whose last months a second dump replaces."""
    rows = complaints(spark, sf).select("id", "ym", F.col("dd").alias("day"), "category")
    return replay.replay_census_in_place([rows.where("id % 3 <> 0").drop("id"), rows.where("ym >= '200006'").drop("id")])[0]


# Selection -------------------------------------------------------------------


@query("select l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.5), 6) as median_price from lineitem group by 1, 2")
def median_by_group(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("l_extendedprice", F.col("l_extendedprice").cast("double"))
    found = quantiles.exact_median(rows, "l_extendedprice", ["l_returnflag", "l_linestatus"], "median_price", most=200)
    return found.withColumn("median_price", r6("median_price"))


@query("select round(quantile_cont(o_totalprice, 0.9), 6) as quantile from orders")
def upper_decile(spark, sf):
    rows = table(spark, sf, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("double"))
    return quantiles.exact_quantile(rows, "o_totalprice", 0.9, most=500).select(r6("quantile").alias("quantile"))


# Delimited scans and feeds -----------------------------------------------------


def dump_lines(spark, sf):
    """orders as lines of a dump, with over-long and short ones."""
    rows = complaints(spark, sf)
    at = {"CMPLID": F.col("id").cast("string"), "ODINO": F.col("incident").cast("string"), "LDATE": F.col("day"), "COMPDESC": F.concat(F.col("code"), F.lit("é"))}
    whole = F.concat_ws("\t", *[at.get(c, F.lit("")) for c in COMPLAINT_COLUMNS])
    line = F.when(F.col("id") % 7 == 0, F.concat(whole, F.lit("\tmore"))).when(F.col("id") % 11 == 0, F.concat(F.col("id").cast("string"), F.lit("\t"), F.col("incident").cast("string"))).otherwise(whole)
    return rows.select(F.decode(F.encode(line, "ISO-8859-1"), "ISO-8859-1").alias("value"))


def _dump_file(spark, sf):
    path = fresh_path(spark, "dump")
    dump_lines(spark, sf).write.option("encoding", "UTF-8").text(path)
    return path


_SCANNED = f"{_O}, s as (select *, id % 7 = 0 as long, id % 7 <> 0 and id % 11 = 0 as short from o)"


@query(f"with {_SCANNED} select cast(id as varchar) CMPLID, case when short then '' else day end LDATE from s where not long")
def projected_scan(spark, sf):
    """Two of 51 columns of a delimited dump; over-long lines go, short ones are padded."""
    return delimited.scan_fields(spark, _dump_file(spark, sf), ["CMPLID", "LDATE"])


@query(f"with {_SCANNED} select case when long then 'long' when short then 'short' else 'fit' end as kind, count(*) n from s group by 1")
def broken_line_report(spark, sf):
    return delimited.broken_lines(spark, _dump_file(spark, sf))


@query(f"with {_O} select count(*) n_rows, count(distinct id) n_ids, 2 n_batches, count(*) filter (day >= '19980101') n_later from o")
def feed_of_dumps(spark, sf):
    """A dump is published, read, read again unchanged, and replaced: two batches, the second with what the first lacked too."""
    feed.register(spark)
    folder = fresh_path(spark, "feed")
    days = complaints(spark, sf).select("id", "day").withColumn("line", F.concat_ws("\t", "id", "day"))
    for upto in ("19980101", "19980101", "99991231"):
        if upto != "19980101" or not readers.path_exists(spark, f"{folder}/published"):
            sinks.replace_folder(days.where(F.col("day") < upto).select("line").coalesce(1), lambda df, to: df.write.text(to), f"{folder}/published")
        path = spark.read.text(f"{folder}/published").inputFiles()[0]
        # The source's address must be one file, whose name Spark chooses: a copy under a fixed name, with its own date.
        sinks.copy_if_other(spark, path, f"{folder}/dump.txt")
        stream = spark.readStream.format("dump_feed").option("url", f"{folder}/dump.txt").option("range_bytes", 1 << 16).load()
        keep = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows").select("batch", F.split("line", "\t").alias("f")).select("batch", F.col("f")[0].alias("id"), F.col("f")[1].alias("day"))
    last = rows.where(F.col("batch") == F.lit(rows.agg(F.max("batch")).first()[0]))
    return last.agg(F.count("*").alias("n_rows"), F.countDistinct("id").alias("n_ids"), F.lit(rows.select("batch").distinct().count()).alias("n_batches"), F.count_if(F.col("day") >= "19980101").alias("n_later"))


@query("select doc_id, n_chars, lang, doc_id % 10 = 3 as broken from (select case when doc_id % 10 = 3 then null else doc_id end doc_id, case when doc_id % 10 <> 3 then n_chars end n_chars, case when doc_id % 10 <> 3 and doc_id % 4 <> 1 then lang end lang, doc_id as d from documents) t(doc_id, n_chars, lang, d)".replace("doc_id % 10 = 3 as broken", "d % 10 = 3 as broken"))
def mixed_json(spark, sf):
    """Documents whose fields differ by row: numbers as text, a field under another name, lines that are cut off."""
    d = table(spark, sf, "documents")
    number = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('"'), F.col("n_chars").cast("string"), F.lit('"'))).otherwise(F.col("n_chars").cast("string"))
    lang = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(', "meta": {"lang": "'), "lang", F.lit('"}'))).when(F.col("doc_id") % 4 != 1, F.concat(F.lit(', "lang": "'), "lang", F.lit('"'))).otherwise(F.lit(""))
    whole = F.concat(F.lit('{"id": '), F.col("doc_id").cast("string"), F.lit(', "n": '), F.coalesce(number, F.lit("null")), F.coalesce(lang, F.lit("")), F.lit("}"))
    path = fresh_path(spark, "mixed")
    d.select(F.when(F.col("doc_id") % 10 == 3, F.lit('{"id": 12, "n')).otherwise(whole).alias("value")).write.text(path)
    return readers.read_mixed_json(spark, path, {"doc_id": ("bigint", ["$.id"]), "n_chars": ("bigint", ["$.n"]), "lang": ("string", ["$.lang", "$.meta.lang"])})


# Dumps without a shuffle ---------------------------------------------------------


@query(f"""with {_DUMPS}, b as (select min(day) lo, max(day) hi from new), ow as (select id from old, b where day between lo and hi)
select (select count(*) from new) n_new, (select count(*) from ow) n_old_window, (select count(*) from new where id not in (select id from old)) n_added,
 (select count(*) from ow where id not in (select id from new)) n_removed, (select count(*) from ow where id in (select id from new)) n_common""")
def bucketed_dump_compare(spark, sf):
    """dump_compare on dumps that were stored bucketed by id."""
    new, old = (sinks.write_bucketed(d.select("id", "day"), "id", BUCKETS, "dump") for d in _dumps(spark, sf))
    return settled(compare.id_sets(new, old, "id", "day"), "dump-compare")


@query(f"""with {_AUDIT} select count(*) filter (a.fp is not null and b.fp is not null) n_common, count(*) filter (b.fp is null) n_only_new, count(*) filter (a.fp is null) n_only_old,
 count(*) filter (a.fp is not null and b.fp is not null and a.doc_id is distinct from b.doc_id) n_changed_doc_id, count(*) filter (a.fp is not null and b.fp is not null and a.lang is distinct from b.lang) n_changed_lang from a full join b on a.fp = b.fp""")
def bucketed_revision_audit(spark, sf):
    rows = _prints(spark, sf).select(F.sha2("fp", 256).alias("fp"), "doc_id", "lang")
    old = sets.last_per_key(rows.where("lang <> 'fr'"), ["fp"], ["doc_id"])
    new, old = (sinks.write_bucketed(d, "fp", BUCKETS, "audit") for d in (rows.where("lang <> 'de'"), old))
    return settled(compare.revision_audit(new, old, "fp", ["doc_id"], ["doc_id", "lang"], hashed=True), "audit")


# Sketches ------------------------------------------------------------------------


@query(f"with {_LEDGER} select doc_id from d where fp not in (select fp from known)")
def new_rows_by_sketch(spark, sf):
    """new_rows_anti where a filter beside the ledger, merged from two batches', spares most rows the join."""
    rows, known = _ledger(spark, sf)
    keyed, ledger = rows.select("doc_id", F.sha2("fp", 256).alias("fp")), known.select(F.sha2("fp", 256).alias("fp"))
    blocks = sketches.block_count(ledger.count())
    halves = [sketches.bloom_filter(ledger.where(F.pmod(F.crc32(F.col("fp").cast("binary")), F.lit(2)) == i), "fp", blocks) for i in (0, 1)]
    return sketches.new_rows_by_sketch(keyed, ledger, "fp", settled(sketches.merged(*halves), "filter"), blocks).select("doc_id")


@query(f"with {_O} select id from o order by md5(concat(id, '|{SEED}')), id limit 150")
def merged_monthly_samples(spark, sf):
    """uniform_sample from the samples of two runs of months, each taken by itself."""
    rows = complaints(spark, sf)
    parts = [settled(sketches.bottom_k(p, "ym", 150, "id", SEED).select("id", "ym"), "sample") for p in (rows.where("ym < '199601'"), rows.where("ym >= '199601'"))]
    return sketches.merged_sample(parts, 150, "id", SEED).select("id")


@query("with d as (select doc_id, lang, row_number() over () as row from documents) select lang, min_by(doc_id, row) as doc_id from d group by 1")
def first_in_file_order(spark, sf):
    """The first document of each language as the file has them, however the scan is dealt."""
    rows = readers.read_in_file_order(spark, f"{sf}/documents.parquet").select("lang", "doc_id", "_ordinal").repartition(7)
    return sets.first_per_key(rows, ["lang"], ["_ordinal"]).select("lang", "doc_id")


# SQL functions, rounding -----------------------------------------------------------

_WILSON = """with c as (select event_type, count(*) n, count(*) filter (value > 50) k from events group by 1), w as (select *, k / cast(n as double) p, 1.96::double z from c)
select event_type, n, k, round(greatest(0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 9) lo, round(least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 9) hi from w"""


@query(_WILSON)
def sql_wilson(spark, sf):
    sql_functions.register(spark)
    table(spark, sf, "events").createOrReplaceTempView("siltstone_events")
    return spark.sql("with c as (select event_type, count(*) n, count_if(value > 50) k from siltstone_events group by 1) select event_type, n, k, round(wilson_lo(k, n), 9) lo, round(wilson_hi(k, n), 9) hi from c")


@query(f"""with {_O}, c as (select ym, category, count(*) n from o group by 1, 2), t as (select ym, sum(n) n from c group by 1), u as (select category, sum(n) / cast((select count(*) from o) as double) q from c group by 1),
pq as (select t.ym, coalesce(c.n, 0) / cast(t.n as double) p, q from t cross join u left join c on c.ym = t.ym and c.category = u.category)
select ym, round(sqrt(greatest(0.0, sum(case when p > 0 then 0.5 * p * ln(p / greatest((p + q) / 2, 1e-12)) else 0 end + case when q > 0 then 0.5 * q * ln(q / greatest((p + q) / 2, 1e-12)) else 0 end))), 6) distance from pq where ym between '199503' and '199702' group by 1""")
def sql_divergence(spark, sf):
    """The distance of each month's mix to that of all months, by spark.sql alone: a scalar and a table function."""
    sql_functions.register(spark)
    complaints(spark, sf).createOrReplaceTempView("siltstone_complaints")
    return spark.sql("""with c as (select ym, category, count(*) n from siltstone_complaints group by 1, 2), t as (select ym, sum(n) n from c group by 1),
        u as (select category, sum(n) / cast(sum(sum(n)) over () as double) q from c group by 1), m as (select t.ym, t.n from months('199503', '199702') w join t on t.ym = w.ym),
        pq as (select m.ym, coalesce(c.n, 0) / cast(m.n as double) p, q from m cross join u left join c on c.ym = m.ym and c.category = u.category)
        select ym, round(sqrt(greatest(0D, sum(js_term(p, q)))), 6) distance from pq group by 1""")


@query("select o_orderkey, round_even(cast(o_orderkey % 1000 as double) / 8, 2) share from orders")
def rounded_half_even(spark, sf):
    """Halves go to the even neighbour, as the published figures have it; eighths are exact, so halves are met."""
    return table(spark, sf, "orders").select("o_orderkey", F.bround((F.col("o_orderkey") % 1000).cast("double") / 8, 2).alias("share"))
