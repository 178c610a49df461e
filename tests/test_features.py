"""Keyed state, exact selection, projected scans, the dump feed, bucketed dumps, months in place, sketches, file order and mixed JSON."""

import functools
import http.server
import json
import math
import os
import random
import threading
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import exprs as X
from siltstone.functions import sql as sql_functions
from siltstone.operators import compare, quantiles, sampling, sets, sketches
from siltstone.schema import COMPLAINT_COLUMNS
from siltstone.sources import delimited, feed, readers, sinks
from siltstone.streaming import incremental, state


# State -----------------------------------------------------------------------


def keep(folder):
    return lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def ledger_step(spark, tmp_path, rows):
    spark.createDataFrame(rows, "key string, n int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
    stream = spark.readStream.schema("key string, n int").parquet(f"{tmp_path}/feed")
    state.run_keyed_ledger(stream, "key", keep(f"{tmp_path}/new"), f"{tmp_path}/checkpoint").awaitTermination()


def test_keys_stay_known_over_restarts(spark, tmp_path):
    ledger_step(spark, tmp_path, [("a", 1), ("a", 2), ("b", 3), (None, 4), (None, 5)])
    ledger_step(spark, tmp_path, [("a", 6), ("c", 7), ("c", 8), (None, 9)])
    ledger_step(spark, tmp_path, [("b", 10)])
    found = spark.read.parquet(f"{tmp_path}/new")
    assert sorted((r["batch"], r["n"]) for r in found.collect()) == [(0, 1), (0, 2), (0, 3), (0, 4), (0, 5), (1, 7), (1, 8)]
    assert not any("ledger" in name for name in os.listdir(tmp_path))  # no table of keys


def census_rows(ym, odd, day=30, series="s"):
    return [(series, ym, "x", 100 - odd, day), (series, ym, "y", odd, day)]


def rule_step(spark, tmp_path, rows, **options):
    spark.createDataFrame(rows, "series string, ym string, category string, n long, max_day int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
    stream = spark.readStream.schema("series string, ym string, category string, n long, max_day int").parquet(f"{tmp_path}/feed")
    rule = state.MixRule("202012", last_n=6, prior_months=6, **options)
    state.run_mix_rule(stream, rule, keep(f"{tmp_path}/fires"), f"{tmp_path}/checkpoint").awaitTermination()


def fires(spark, tmp_path):
    return sorted((r["batch"], r["series"], r["month"], r["previous_month"]) for r in spark.read.parquet(f"{tmp_path}/fires").collect())


def test_rule_needs_two_complete_months_in_a_row(spark, tmp_path):
    history = [r for s in ("s", "t") for m in range(1, 13) for r in census_rows(f"2020{m:02d}", 50 + m % 3, series=s)]
    rule_step(spark, tmp_path, history)
    rule_step(spark, tmp_path, census_rows("202101", 90) + census_rows("202102", 50) + census_rows("202103", 95, day=20))  # one trip; a month cut short
    assert fires(spark, tmp_path) == []
    rule_step(spark, tmp_path, census_rows("202103", 95) + census_rows("202104", 93))  # the month is whole now
    rule_step(spark, tmp_path, census_rows("202105", 94))  # silent after a fire
    assert fires(spark, tmp_path) == [(2, "s", "202104", "202103")]


def test_rule_is_armed_again_by_its_timer(spark, tmp_path):
    history = [r for m in range(1, 13) for r in census_rows(f"2020{m:02d}", 50 + m % 3)]
    rule_step(spark, tmp_path, history + census_rows("202101", 90) + census_rows("202102", 90), rearm_ms=1)
    time.sleep(0.1)
    rule_step(spark, tmp_path, census_rows("202103", 91), rearm_ms=1)  # the timer goes off in this batch, after its rows
    time.sleep(0.1)
    rule_step(spark, tmp_path, census_rows("202104", 91), rearm_ms=1)
    assert [f[2:] for f in fires(spark, tmp_path)] == [("202102", "202101"), ("202104", "202103")]


def test_months_are_replaced_in_place(spark, tmp_path):
    census = incremental.MonthTable(spark, f"{tmp_path}/census", incremental.CENSUS_SCHEMA)
    census.replace(spark.createDataFrame([("202001", "x", 1), ("202001", "y", 2), ("202002", "x", 3)], "ym string, category string, n long"))
    files = {f: os.stat(f"{tmp_path}/census/ym=202001/{f}").st_mtime_ns for f in os.listdir(f"{tmp_path}/census/ym=202001")}
    late = spark.createDataFrame([("202002", "y", 9), ("202003", "x", 4)], "ym string, category string, n long")
    for _ in range(2):  # a batch that runs again changes nothing
        census.replace(late)
        assert sorted(map(tuple, census.current().select("ym", "category", "n").collect())) == [("202001", "x", 1), ("202001", "y", 2), ("202002", "y", 9), ("202003", "x", 4)]
    assert files == {f: os.stat(f"{tmp_path}/census/ym=202001/{f}").st_mtime_ns for f in os.listdir(f"{tmp_path}/census/ym=202001")}


# Selection -------------------------------------------------------------------


@pytest.mark.parametrize("share", [0.5, 0.99])
def test_quantiles_of_uneven_groups(spark, share):
    rng = random.Random(8)
    rows = [("even", rng.gauss(0, 1)) for _ in range(3001)] + [("two", v) for v in [1.0] * 900 + [2.0] * 900] + [("hot", rng.choice([5.0] * 9 + [rng.random()])) for _ in range(2000)]
    rows += [("ties", float(rng.randrange(40))) for _ in range(1000)] + [("one", 4.0), ("none", None), (None, 1.0), (None, 3.0), ("inf", math.inf), ("inf", 1.0), ("inf", 2.0)]
    found = quantiles.exact_quantile(spark.createDataFrame(rows, "g string, v double").repartition(4), "v", share, ["g"], most=40)
    by = {}
    for g, v in rows:
        by.setdefault(g, []).extend([] if v is None else [v])
    got = {r["g"]: r["quantile"] for r in found.collect()}
    assert got.keys() == by.keys()
    for g, values in by.items():
        if g == "inf":
            assert got[g] == (math.inf if share > 0.5 else 2.0)
        else:
            assert (got[g] is None) if not values else got[g] == pytest.approx(float(np.quantile(values, share)), abs=1e-12)


def test_median_of_everything_and_of_nothing(spark):
    values = spark.range(10_001).select((F.col("id") * 7919 % 10_007).cast("double").alias("v"))
    assert quantiles.exact_median(values, "v", most=50).first()[0] == np.median([i * 7919 % 10_007 for i in range(10_001)])
    assert quantiles.exact_median(values.where("false"), "v").first()[0] is None


# Delimited scans ---------------------------------------------------------------


def test_projected_scan_is_the_whole_readers(spark, tmp_path):
    rng = random.Random(2)
    lines = ["\t".join(rng.choice(["", "a", "é\xff", ' "q', "1.5"]) for _ in range(rng.choice([1, 3, 50, 51, 51, 51, 51, 52, 60]))) for _ in range(300)] + [""]
    (tmp_path / "dump.txt").write_bytes("\n".join(lines).encode("latin-1"))
    wanted = ["LDATE", "CMPLID", COMPLAINT_COLUMNS[-1], "CDESCR"]
    found = delimited.scan_fields(spark, str(tmp_path / "dump.txt"), wanted)
    expected = []
    for line in lines:
        f = line.split("\t")
        if line and len(f) <= 51:
            f += [""] * 51
            expected.append(tuple(f[COMPLAINT_COLUMNS.index(w)] for w in wanted))
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    kinds = {r["kind"]: r["n"] for r in delimited.broken_lines(spark, str(tmp_path / "dump.txt")).collect()}
    assert sum(kinds.values()) == sum(bool(x) for x in lines) and kinds["fit"] == sum(x.count("\t") == 50 for x in lines)


def test_projected_scan_splits_no_further_than_needed(spark, tmp_path):
    (tmp_path / "d.txt").write_text("a\tb\n")
    plan = delimited.scan_fields(spark, str(tmp_path / "d.txt"), ["ODINO"])._jdf.queryExecution().optimizedPlan().toString()
    assert f", {COMPLAINT_COLUMNS.index('ODINO') + 2})" in plan and "csv" not in plan.lower()


# The feed ------------------------------------------------------------------------


@pytest.fixture
def web(tmp_path):
    folder = tmp_path / "web"
    folder.mkdir()
    quiet = type("Quiet", (http.server.SimpleHTTPRequestHandler,), {"log_message": lambda *_: None})
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(quiet, directory=str(folder)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield folder, f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def feed_step(spark, tmp_path, url, **options):
    seen = []
    stream = spark.readStream.format("dump_feed").options(url=url, **options).load()
    stream.writeStream.foreachBatch(lambda rows, _: seen.append(sorted(r["line"] for r in rows.collect()))).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return [s for s in seen if s]


def test_an_unchanged_dump_makes_no_batch_and_a_changed_one_makes_one(spark, tmp_path, web):
    folder, base = web
    feed.register(spark)
    lines = [f"{i}\tline é {'x' * (i % 50)}" for i in range(500)]
    (folder / "dump.txt").write_bytes("\n".join(lines).encode("latin-1"))
    os.utime(folder / "dump.txt", (1_600_000_000, 1_600_000_000))
    url = f"{base}/dump.txt"
    assert feed_step(spark, tmp_path, url, range_bytes=997) == [sorted(lines)]
    assert feed_step(spark, tmp_path, url, range_bytes=997) == []
    (folder / "dump.txt").write_bytes("\n".join([*lines, "more"]).encode("latin-1"))
    os.utime(folder / "dump.txt", (1_700_000_000, 1_700_000_000))
    assert feed_step(spark, tmp_path, url, range_bytes=997) == [sorted([*lines, "more"])]
    (folder / "dump.txt").unlink()  # a probe that fails is no change
    assert feed_step(spark, tmp_path, url, range_bytes=997) == []


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 1000])
def test_ranges_give_every_line_once(tmp_path, size):
    raw = b"a\n\nbcd\nef\n\n\nghijklm\n" + b"n" * 20
    path = tmp_path / "x.txt"
    path.write_bytes(raw)
    access = feed._Access({"url": path.as_uri(), "range_bytes": size})
    found = [line for part in access.ranges(access.mark()) for batch in access.lines(part) for line in batch.column(0).to_pylist()]
    assert found == raw.decode().split("\n")


def test_archives_and_batch_reads(spark, web):
    folder, base = web
    feed.register(spark)
    with zipfile.ZipFile(folder / "FLAT.zip", "w") as z:
        z.writestr("FLAT.txt", "1\tO1\r\n2\tO2\n")
    rows = spark.read.format("dump_feed").option("url", f"{base}/FLAT.zip").load().collect()
    assert sorted(r["line"] for r in rows) == ["1\tO1", "2\tO2"] and json.loads(rows[0]["source"])[2] == (folder / "FLAT.zip").stat().st_size


# Bucketed dumps ----------------------------------------------------------------------


def test_bucketed_dumps_are_compared_without_a_shuffle(spark):
    rows = [spark.range(2000).select("id", F.lit("20200101").alias("day"), (F.col("id") % m).alias("x")) for m in (5, 7)]
    new, old = (sinks.write_bucketed(d, "id", 4, "test-bucketed") for d in rows)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for found in (compare.id_sets(new, old, "id", "day"), compare.field_changes(new, old, "id", ["x"]), compare.revision_audit(new, old, "id", ["x"], ["x"], hashed=True)):
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning" not in plan and "SortMergeJoin" in plan
        plain = compare.id_sets(*rows, "id", "day")
        assert compare.id_sets(new, old, "id", "day").collect() == plain.collect()
        assert "hashpartitioning" in plain._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sinks.drop_bucketed(spark, "test-bucketed") == 2


# Sketches -----------------------------------------------------------------------------


@pytest.mark.parametrize("broadcast", [True, False])
def test_filters_lose_no_key_and_take_few_strangers(spark, monkeypatch, broadcast):
    monkeypatch.setattr(sketches, "BROADCAST_BLOCKS", 1000 if broadcast else 0)
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    blocks = sketches.block_count(20_000)
    halves = [sketches.bloom_filter(keys.where(F.crc32(F.col("key").cast("binary")) % 2 == i), "key", blocks) for i in (0, 1)]
    known = sketches.merged(*halves)
    assert sketches.probed(keys, "key", known, blocks).where("not maybe").isEmpty()
    assert {(r["bucket"], bytes(r["bits"])) for r in known.collect()} == {(r["bucket"], bytes(r["bits"])) for r in sketches.bloom_filter(keys, "key", blocks).collect()}
    row = sketches.false_positive_rate(spark.range(20_000).select(F.concat(F.lit("s"), "id").alias("key")), "key", known, blocks).first()
    assert row["n_strangers"] == 20_000 and row["n_taken"] < 0.02 * 20_000


def test_new_rows_by_sketch_are_new_rows(spark):
    ledger = spark.createDataFrame([(f"k{i}",) for i in range(0, 300, 2)], "key string")
    batch = spark.createDataFrame([(f"k{i % 200}", i) for i in range(400)] + [(None, 900), (None, 901)], "key string, bits int")
    blocks = sketches.block_count(150)
    found = sketches.new_rows_by_sketch(batch, ledger, "key", sketches.bloom_filter(ledger, "key", blocks), blocks)
    assert found.columns == batch.columns
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, sets.new_rows(batch, ledger, "key").select(*batch.columns).collect()), key=repr)


def test_samples_of_months_merge(spark):
    rows = spark.range(3000).select("id", F.concat(F.lit("20200"), F.col("id") % 5 + 1).alias("ym"))
    parts = [sketches.bottom_k(rows.where(F.col("ym") == f"20200{m}"), "ym", 40, "id", 3) for m in range(1, 6)]
    assert sorted(map(tuple, sketches.merged_sample(parts, 40, "id", 3).collect())) == sorted(map(tuple, sampling.uniform_sample(rows, 40, "id", 3).collect()))


# Readers and functions -------------------------------------------------------------------


def test_file_order_does_not_depend_on_partitions(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.createDataFrame([(i % 5, i) for i in range(1000)], "k int, n int").coalesce(1).write.option("parquet.block.size", 1024).parquet(path)
    for parts in (1, 9):
        rows = readers.read_in_file_order(spark, path).repartition(parts)
        assert sorted(map(tuple, sets.first_per_key(rows, ["k"], ["_ordinal"]).select("k", "n").collect())) == [(i, i) for i in range(5)]


def test_mixed_json(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"a": 1, "b": "x"}\n\n{"a": "2", "c": {"b": "y"}}\n{"a": [3]}\n{"a": 4.5, "b": null\nnot json\n{"a": null, "b": 7}\n')
    found = readers.read_mixed_json(spark, str(tmp_path / "m.json"), {"a": ("int", ["$.a"]), "b": ("string", ["$.b", "$.c.b"])})
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(1, "x", False), (2, "y", False), (None, None, False), (None, None, True), (None, None, True), (None, "7", False)], key=repr)


def test_sql_functions_agree_with_the_columns(spark):
    sql_functions.register(spark)
    rows = spark.createDataFrame([(0, 0), (0, 5), (5, 5), (3, 10), (None, 4)], "k long, n long")
    rows.createOrReplaceTempView("sql_function_rows")
    both = spark.sql("select k, n, wilson_lo(k, n) lo, wilson_hi(k, n) hi from sql_function_rows").withColumn("w", X.wilson(F.col("k"), F.col("n")))
    for r in both.collect():
        assert (r["lo"], r["hi"]) == ((None, None) if r["w"] is None else (pytest.approx(r["w"]["lo"], abs=1e-12), pytest.approx(r["w"]["hi"], abs=1e-12)))
    assert [r["ym"] for r in spark.sql("select ym from months('201911', '202002') order by 1").collect()] == ["201911", "201912", "202001", "202002"]
