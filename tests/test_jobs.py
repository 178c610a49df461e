import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import census as C
from siltstone.operators import drift, sampling, scoring, sets
from siltstone.plans import jobs
from siltstone.schema import COMPLAINT_COLUMNS
from siltstone.sources import readers, sinks
from siltstone.streaming.incremental import CENSUS_SCHEMA, TOTALS_SCHEMA, AppendedKeys, VersionedTable, run_census, run_ledger


def line(**values):
    return "\t".join(values.get(c, "") for c in COMPLAINT_COLUMNS)


def complaint(i, odino="O1", day="20250110", code="AIR BAGS:FRONT", text="some narrative that is long enough", kind="V"):
    return line(CMPLID=str(i), ODINO=odino, LDATE=day, COMPDESC=code, CDESCR=text, PROD_TYPE=kind, INJURED="1")


@pytest.fixture
def dump(spark, tmp_path):
    def make(*lines, name="FLAT_CMPL.txt"):
        path = tmp_path / name
        path.write_bytes("\n".join(lines).encode("latin-1") + b"\n")
        return readers.read_complaints(spark, str(path))

    return make


def test_complaint_file(spark, dump, tmp_path):
    lines = [complaint(1, text='an unbalanced " quote'), complaint(2, text="caf\xe9 \x92"), "3\tO9", complaint(4) + "\textra", line(CMPLID="5", INJURED="x", PROD_TYPE="C")]
    got = {r["CMPLID"]: r for r in readers.typed(dump(*lines)).collect()}
    assert set(got) == {"1", "2", "3", "5"}
    assert got["1"]["CDESCR"] == 'an unbalanced " quote' and got["2"]["CDESCR"] == "caf\xe9 \x92"
    assert got["3"]["ODINO"] == "O9" and got["3"]["CDESCR"] == "" and got["5"]["INJURED"] is None and got["1"]["INJURED"] == 1.0
    assert readers.pick_text_file(str(tmp_path)).endswith("FLAT_CMPL.txt")


def test_optional_sources(spark, tmp_path):
    assert readers.read_lines(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "seen.txt").write_text("b\n\n a \nb\n")
    assert {r[0] for r in readers.read_lines(spark, str(tmp_path / "seen.txt")).collect()} == {"a", "b"}
    assert readers.read_ids(spark, str(tmp_path / "none")).columns == ["id"]
    spark.range(2).withColumnRenamed("id", "CMPLID").write.parquet(str(tmp_path / "ids"))
    assert {r[0] for r in readers.read_ids(spark, str(tmp_path / "ids")).collect()} == {"0", "1"}
    assert readers.unchanged({"last_modified": "x"}, {"last_modified": "x"}) and not readers.unchanged({"last_modified": "x"}, {"last_modified": "x"}, force=True)
    assert readers.probe("http://127.0.0.1:9/none", 0.2)["error"]


def test_sinks(spark, tmp_path):
    keys = spark.createDataFrame([("b",), ("a",), ("b",)], "key string")
    sinks.write_sorted_lines(keys, str(tmp_path / "lines"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "lines")).collect()] == ["a", "b"]
    path = sinks.write_dated(keys, str(tmp_path / "dated"), "20250101")
    assert spark.read.parquet(path).count() == 3
    sinks.write_summary({"n": 3}, str(tmp_path / "s" / "summary.json"))
    log = spark.createDataFrame([("1", "x"), ("2", "y")], "cmplid string, label string")
    merged = sinks.upsert_json_lines(log, spark.createDataFrame([("2", "z")], "cmplid string, label string"), str(tmp_path / "log"))
    assert {tuple(r) for r in merged.select("cmplid", "label").collect()} == {("1", "x"), ("2", "z")}
    # The log as it is on disk, replaced in place; a write that fails leaves it as it was.
    again = sinks.upsert_json_lines(merged, spark.createDataFrame([("3", "w")], "cmplid string, label string"), str(tmp_path / "log"))
    assert again.count() == 3
    fails = spark.createDataFrame([("4", "v")], "cmplid string, label string").withColumn("label", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        sinks.upsert_json_lines(again, fails, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 3


def test_prepare_and_samples(spark, dump):
    rows = dump(*[complaint(i, odino=f"O{i // 2}", code=("ENGINE" if i % 3 else "COMMUNICATIONS:X")) for i in range(30)], complaint(99, kind="C"))
    clean, coverage = jobs.prepare_training_data(rows)
    assert clean.count() == 30 and {r["COMPDESC_TOP"] for r in coverage.collect()} == {"ENGINE", "COMMUNICATION"}
    assert clean.where("odino_multi_row and odino_group_size = 2").count() == 30
    gold = spark.createDataFrame([(3,), (4,)], "id int")
    sample = jobs.build_training_sample(clean, gold, cap=5)
    assert sample.count() == 10 and sample.where("CMPLID in ('3', '4')").count() == 0
    split = sampling.train_val_split(clean, "COMPDESC_LABEL", "CMPLID", 1)
    assert split.where("split = 'val'").count() == math.ceil(20 * 0.15) + math.ceil(10 * 0.15)


def test_exclusion_does_not_leak(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "cmplid int")
    blocked = spark.createDataFrame([("1",), (None,)], "id string")
    kept = sets.excluding(rows, "cmplid", blocked)
    assert {r[0] for r in kept.collect()} == {2, None}
    with pytest.raises(AssertionError):
        sets.require_exact_exclusion(sets.exclusion_report(rows, rows, blocked, "cmplid"))


def months(spark, spec):
    census = spark.createDataFrame([(ym, c, n) for ym, c, n, _ in spec], "ym string, category string, n long")
    totals = spark.createDataFrame([(ym, n, d, d >= 28) for ym, _, n, d in spec], TOTALS_SCHEMA)
    return census, totals


def steady():
    from siltstone.functions.exprs import shift_month

    return [(shift_month("200312", i), "AIR BAGS", 100, 28) for i in range(36)] + [(shift_month("202312", i), "AIR BAGS", 100, 28) for i in range(24)]


def test_two_complete_months_fire(spark):
    rule = drift.mix_rule(*months(spark, [*steady(), ("202512", "STEERING", 100, 31), ("202601", "STEERING", 100, 31)]), "202511")
    assert tuple(rule["fire"].first()) == ("202601", "202512")
    walk = rule["walk"].orderBy("month").collect()
    assert [r["distance"] for r in walk] == pytest.approx([math.sqrt(math.log(2))] * 2) and rule["line"].first()["threshold"] == 0


def test_partial_month_cannot_fire(spark):
    rule = drift.mix_rule(*months(spark, [*steady(), ("202512", "STEERING", 100, 31), ("202601", "STEERING", 40, 12)]), "202511")
    assert rule["fire"].first() is None and tuple(rule["summary"].first()) == (2, 1, 1)
    assert not rule["walk"].where("month = '202601'").first()["complete"]


def test_gap_between_complete_months_fires(spark):
    rule = drift.mix_rule(*months(spark, [*steady(), ("202512", "STEERING", 9, 31), ("202601", "STEERING", 9, 5), ("202602", "STEERING", 9, 30)]), "202511")
    assert tuple(rule["fire"].first()) == ("202602", "202512")


def test_empty_pool_and_missing_months(spark):
    rule = drift.mix_rule(*months(spark, [("202601", "A", 5, 30), ("202603", "A", 5, 30)]), "202511")
    walk = rule["walk"].orderBy("month").collect()
    assert [(r["month"], r["n"], r["distance"]) for r in walk] == [("202512", 0, None), ("202601", 5, 0.0), ("202602", 0, None), ("202603", 5, 0.0)]


def test_overlay_replaces_months(spark):
    base = spark.createDataFrame([("202401", "AIR BAGS", 10), ("202501", "AIR BAGS", 5)], CENSUS_SCHEMA)
    incoming = spark.createDataFrame([("202501", "STEERING", 20)], CENSUS_SCHEMA)
    once = sets.overlay(base, incoming, "ym")
    want = {("202401", "AIR BAGS", 10), ("202501", "STEERING", 20)}
    assert {tuple(r) for r in once.collect()} == want == {tuple(r) for r in sets.overlay(once, incoming, "ym").collect()}


def test_census_document(spark):
    census, totals = months(spark, [("202401", "A", 3, 28), ("202402", "B", 4, 9)])
    back, back_totals = C.from_document(C.to_document(census, totals, "s", "c", "t"))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in census.collect()}
    assert {tuple(r) for r in back_totals.collect()} == {tuple(r) for r in totals.collect()}


def test_nightly(spark, dump):
    rows = dump(complaint(1, text="known one"), complaint(2, "O2", text="new one"), complaint(3, "O2", text="new one"), complaint(4, day="20240101"), complaint(5, kind="C"))
    empty_census, empty_totals = spark.createDataFrame([], CENSUS_SCHEMA), spark.createDataFrame([], TOTALS_SCHEMA)
    first = jobs.nightly(dump(complaint(1, text="known one"), name="a.txt"), empty_census, empty_totals, spark.createDataFrame([], "key string"), "20240601", "202411")
    out = jobs.nightly(rows, first["census"], first["totals"], first["seen"], "20240601", "202411")
    assert {r["CMPLID"] for r in out["new"].collect()} == {"2", "3"} and out["seen"].count() == 2
    assert {tuple(r) for r in out["census"].collect()} == {("202501", "AIR BAGS", 3), ("202401", "AIR BAGS", 1)}
    new, ledger = jobs.pull(rows, spark.createDataFrame([], "fingerprint string"))
    assert new.count() == 4 and ledger.count() == 3


def test_ledger_and_census_stream_like_batch(spark, tmp_path):
    random.seed(3)
    rows = [(f"k{random.randint(0, 30)}", f"2025{m:02d}", random.randint(1, 28), random.choice("AB")) for m in (1, 2, 3) for _ in range(20)]
    schema = "key string, ym string, day int, category string"
    for i, part in enumerate((rows[:20], rows[20:40], rows[20:60])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    ledger = AppendedKeys(spark, str(tmp_path / "ledger"), "key")
    sink = lambda new, b: new.write.mode("overwrite").parquet(str(tmp_path / "new" / f"batch={b}"))
    run_ledger(stream, "key", ledger, sink, str(tmp_path / "c1")).awaitTermination()
    assert sorted(r[0] for r in ledger.current().collect()) == sorted({r[0] for r in rows})  # each key is kept once
    first = {}
    for b in sorted((tmp_path / "new").glob("batch=*")):
        for r in spark.read.parquet(str(b)).collect():
            assert first.setdefault(r["key"], b.name) == b.name
    census, totals = VersionedTable(spark, str(tmp_path / "c"), CENSUS_SCHEMA), VersionedTable(spark, str(tmp_path / "t"), TOTALS_SCHEMA)
    run_census(stream, census, totals, str(tmp_path / "c2")).awaitTermination()
    assert len(list((tmp_path / "c").glob("v-*"))) == 2
    want = C.month_census(spark.createDataFrame(rows, schema))
    assert {tuple(r) for r in census.current().collect()} == {tuple(r) for r in want.collect()}


def test_chunks_resume_and_canary_gate(spark, tmp_path):
    from siltstone.streaming.incremental import run_chunks

    schema = "text string"
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    label = lambda rows: rows.withColumn("label", F.upper("text"))
    for i in range(2):
        spark.createDataFrame([(f"t{i}",)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"c{i}"))
    run_chunks(read(), label, lambda d: True, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([("t2",)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "c2"))
    run_chunks(read(), label, lambda d: True, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r["label"] for r in got} == {"T0", "T1", "T2"} and len({r["chunk"] for r in got}) == 3
    with pytest.raises(Exception, match="GateClosed"):
        run_chunks(read(), label, lambda d: False, str(tmp_path / "out2"), str(tmp_path / "cp2")).awaitTermination()
    assert len(list((tmp_path / "out2").glob("chunk=*"))) == 1


def test_current_sample_and_decision(spark, dump):
    rows = dump(*[complaint(i, day="20260901", code=("TIRES" if i < 10 else "SEATS")) for i in range(40)])
    out = jobs.sample_current(rows, [spark.createDataFrame([("0",)], "id string")], "20260826", ["TIRES"], n=5, n_boost=3)
    assert out["blind"].columns == jobs.BLIND and out["sealed"].count() == 8 and out["sealed"].select("cmplid").distinct().count() == 8
    fire = spark.createDataFrame([("202511", "202510")], "month string, previous_month string")
    r = jobs.retrain_decision(fire, spark.createDataFrame([("20250101",), ("20260101",)], "ldate string")).first()
    assert r["retrain"] and not r["promote"] and not r["launch"] and r["n_teacher_through_fire"] == 1
    assert not jobs.retrain_decision(fire.where("false"), spark.createDataFrame([("20250101",)], "ldate string")).first()["retrain"]


def test_label_calls(spark):
    def client(texts):
        if "boom" in texts:
            raise RuntimeError("down")
        return [t.upper() for t in texts]

    rows = spark.createDataFrame([("a",), ("boom",)], "text string").repartition(2, "text")
    got = {r["text"]: (r["reply"], r["error"]) for r in scoring.call_labeller(rows, client, "text", retries=2, batch=1).collect()}
    assert got == {"a": ("A", None), "boom": (None, "RuntimeError: down")}


def test_windowed_counts_batch(spark):
    from siltstone.streaming.incremental import windowed_counts

    rows = spark.createDataFrame([(datetime.datetime(2024, 1, 1, h), "a", 1.0) for h in (1, 2)], "ts timestamp, kind string, value double")
    assert windowed_counts(rows, "ts", "kind").first()["n"] == 2


def test_positions(spark):
    rows = spark.range(30).select("id", (F.col("id") / 7).cast("int").alias("b"))
    got = sampling.canary_chunks(rows, ["id"], F.col("b"), canary=5, chunk=10).orderBy("id").collect()
    assert [r["position"] for r in got] == list(range(1, 31)) and [r["chunk"] for r in got] == [0] * 5 + [1] * 10 + [2] * 10 + [3] * 5


def test_label_calls_with_too_few_answers(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "text string").coalesce(1)
    got = scoring.call_labeller(rows, lambda texts: ["one"], "text", retries=2, pause=0.01).collect()
    assert {(r["reply"], r["error"]) for r in got} == {(None, "ValueError: 1 answers to 2 texts")}


def test_any_batch_model(spark):
    def load():
        return lambda texts: [[0.2, 0.3, 0.5] if "x" in t else [0.6, 0.3, 0.1] for t in texts]

    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, text string")
    got = {r["id"]: r for r in scoring.score_batches(rows, load, ["a", "b", "c"], batch=2).collect()}
    assert [(got[i]["pred"], got[i]["confidence"]) for i in (1, 2, 3)] == [("c", 0.5), ("a", 0.6), ("a", 0.6)]
    assert got[1]["top3"] == '[{"label":"c","p":0.5},{"label":"b","p":0.3},{"label":"a","p":0.2}]' and got[3]["text"] is None


@pytest.mark.parametrize("cap", [3, 1200])
def test_stratified_sample_whatever_the_cap(spark, cap):
    import hashlib

    rows = spark.range(4000).select("id", F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise(F.col("id") % 4).alias("g"))
    got = sampling.stratified_sample(rows, "g", cap, "id", 5)
    assert got.columns == ["id", "g"]
    found = {}
    for r in got.collect():
        found.setdefault(r["g"], set()).add(r["id"])
    for g in (None, 1, 2, 3):
        ids = sorted((i for i in range(4000) if (i % 4 or None) == g), key=lambda i: (hashlib.md5(f"{i}|5".encode()).hexdigest(), i))
        assert found[g] == set(ids[:cap])


def test_slide_anchors_at_each_fire(spark):
    spec = [*steady(), *[(m, "STEERING", 100, 31) for m in ("202512", "202601", "202602")]]
    census, totals = months(spark, spec)
    fires = drift.slide(census, totals, "202511")
    by_hand, as_of = [], "202511"
    while (row := drift.mix_rule(census, totals, as_of)["fire"].first()) is not None:
        by_hand.append({"as_of": as_of, **row.asDict()})
        as_of = row["month"]
    assert fires == by_hand and fires[0] == {"as_of": "202511", "month": "202601", "previous_month": "202512"}


def replies(spark, bad):
    def call(rows):
        return rows.withColumn("reply", F.when(F.col("cmplid") % bad != 0, F.lit('{"component": "TIRES", "confidence": "medium"}'))).withColumn("error", F.when(F.col("cmplid") % bad == 0, F.lit("down"))).withColumn("cost_usd", F.lit(0.001))

    return call


def test_cascade_stops_at_a_failed_canary(spark):
    from siltstone.operators.cascade import GateClosed

    sample = spark.range(400).select(F.col("id").cast("string").alias("cmplid"))
    called = []

    def dear(rows):
        called.append(1)
        return replies(spark, 2)(rows)

    with pytest.raises(GateClosed, match="cheap-stage"):
        jobs.cascade_labels(sample, dear, dear, ("a", "b"), canary=50)
    assert called == [1]  # only the canary was paid for
    with pytest.raises(GateClosed, match="smart-stage"):
        jobs.cascade_labels(sample, replies(spark, 1000), dear, ("a", "b"), canary=50)
    out = jobs.cascade_labels(sample, replies(spark, 1000), replies(spark, 1000), ("a", "b"), canary=50)
    row = out["summary"].first()
    assert (row["n_rows"], row["n_escalated"], row["n_failed"]) == (400, 399, 1) and out["labels"].where("labeling_model = 'b'").count() == 399


def test_loop_without_scoring(spark, dump):
    rows = dump(*[complaint(i, odino=f"O{i}", day=f"2025{1 + i % 3:02d}28") for i in range(9)])
    out = jobs.loop(rows, spark.createDataFrame([("O1||some narrative that is long enough",)], "fingerprint string"), rows, spark.createDataFrame([("20250101",)], "ldate string"), "202411")
    assert out["new"].count() == 8 and out["score"] is None and not out["decision"].first()["retrain"]


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from siltstone.session import shared_dir

    context = SimpleNamespace(master="spark://host:7077", applicationId="a")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))
    assert shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: "hdfs://x/"), sparkContext=context)) == "hdfs://x/siltstone-a"


def test_null_hardness_is_a_slice_of_its_own(spark):
    from siltstone.operators.evaluation import accuracy_slices

    rows = spark.createDataFrame([(True, True), (False, False), (None, True)], "is_hard boolean, correct boolean")
    assert {(r["slice"], r["n"], r["k"]) for r in accuracy_slices(rows).collect()} == {("all", 3, 2), ("hard", 1, 1), ("easy", 1, 0), ("missing", 1, 1)}


def test_probe_and_download(tmp_path):
    import functools
    import http.server
    import threading
    import zipfile

    (tmp_path / "web").mkdir()
    with zipfile.ZipFile(tmp_path / "web" / "FLAT_X.zip", "w") as z:
        z.writestr("FLAT_X.txt", "1\tO1\n")
    quiet = type("Quiet", (http.server.SimpleHTTPRequestHandler,), {"log_message": lambda *_: None})
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(quiet, directory=str(tmp_path / "web")))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/FLAT_X.zip"
    try:
        head = readers.probe(url)
        meta = readers.download(url, str(tmp_path / "in"))
    finally:
        server.shutdown()
    assert head["status"] == 200 and head["error"] is None and readers.unchanged(head, meta)
    assert meta["bytes"] == (tmp_path / "web" / "FLAT_X.zip").stat().st_size and not list((tmp_path / "in").glob("*.part"))
    assert readers.pick_text_file(str(tmp_path / "in")).endswith("FLAT_X.txt")
