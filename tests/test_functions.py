import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import exprs as X
from siltstone.operators import cascade, evaluation, labels, sampling
from siltstone.schema import COMPLAINT_COLUMNS, PRIMARY_CATEGORIES, RARE_CATEGORIES


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


@pytest.mark.parametrize(
    ("k", "n", "lo", "hi"),
    [(453, 551, 0.7880143690738753, 0.8518078792939471), (222, 303, 0.68016, 0.77937), (231, 248, 0.89298, 0.95677), (132, 147, 0.838, 0.937), (62, 147, 0.345, 0.503)],
)
def test_wilson_published(spark, k, n, lo, hi):
    w = one(spark, w=X.wilson(F.lit(k), F.lit(n)))["w"]
    assert (w["lo"], w["hi"]) == (pytest.approx(lo, abs=6e-4), pytest.approx(hi, abs=6e-4))
    assert one(spark, w=X.wilson(F.lit(0), F.lit(0)))["w"] is None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 500), st.integers(1, 500)).map(lambda t: (min(t), max(t))), min_size=1, max_size=20))
def test_wilson_bounds(spark, pairs):
    rows = spark.createDataFrame(pairs, "k int, n int").select("k", "n", X.wilson(F.col("k"), F.col("n")).alias("w")).collect()
    for r in rows:
        assert 0 <= r["w"]["lo"] <= r["k"] / r["n"] + 1e-12 and r["k"] / r["n"] - 1e-12 <= r["w"]["hi"] <= 1


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 99), st.integers(0, 99)), min_size=1, max_size=8))
def test_js_distance_symmetric_and_bounded(spark, counts):
    p, q = sum(a for a, _ in counts) or 1, sum(b for _, b in counts) or 1
    rows = spark.createDataFrame([(a / p, b / q) for a, b in counts], "p double, q double")
    d = rows.agg(X.js_distance(F.col("p"), F.col("q")).alias("a"), X.js_distance(F.col("q"), F.col("p")).alias("b")).first()
    assert d["a"] == pytest.approx(d["b"]) and 0 <= d["a"] <= math.sqrt(math.log(2)) + 1e-9


def test_label_sets():
    assert len(COMPLAINT_COLUMNS) == 51 and len(PRIMARY_CATEGORIES) == 30 and len(RARE_CATEGORIES) == 10
    assert len(set(PRIMARY_CATEGORIES) | set(RARE_CATEGORIES)) == 40


def test_fingerprint(spark):
    text = "  the  brake\tpedal\nwent " + "x" * 500
    r = one(spark, fp=X.fingerprint(F.lit("123"), F.lit(text)), h=X.fingerprint_hash(F.lit("123"), F.lit("the brake pedal went to the floor")))
    assert r["fp"].startswith("123||the brake pedal went xxx") and len(r["fp"]) == 5 + 400
    import hashlib

    assert r["h"] == hashlib.sha256(b"123||the brake pedal went to the floor").hexdigest()
    assert one(spark, a=X.fingerprint(F.lit("1"), F.lit("a b"), X.WS_UNICODE))["a"] == "1||a b"


def test_codes_and_dates(spark):
    r = one(
        spark,
        a=X.top_level(F.lit("A : B"), ":", {"A": "Z"}), b=X.top_level(F.lit("")), c=X.keep_or_other(F.lit("STEERING")), d=X.keep_or_other(F.lit("CHILD SEAT")), e=X.keep_or_other(F.lit(None).cast("string")),
        f=X.day_of(F.lit("2025")), g=X.month_of(F.lit("20250131")), h=X.add_months(F.lit("202401"), -1), i=X.month_series(F.lit("202311"), F.lit("202402")), j=X.month_series(F.lit("202402"), F.lit("202401")), k=X.to_number(F.lit("x")),
    )
    assert tuple(r) == ("Z", "", "STEERING", "OTHER", "OTHER", 0, "202501", "202312", ["202311", "202312", "202401", "202402"], [], None)


def test_windows():
    assert X.windows_at("201912") == {"last_start": "201801", "last_end": "201912", "pool_start": "199801", "pool_end": "201712"}
    assert X.windows_at("202511") == {"last_start": "202312", "last_end": "202511", "pool_start": "200312", "pool_end": "202311"}


def test_texts_and_json(spark):
    r = one(
        spark,
        a=X.prompt_text(F.lit("M"), F.lit(""), F.lit("2020"), F.lit("n")), b=X.target_json(F.lit("TIRES"), F.lit("Y"), F.lit("N"), F.lit("2"), F.lit(None).cast("string")), c=X.extract_json(F.lit('so {"k": 1} ok'), "k int")["k"],
        d=X.extract_json(F.lit("none"), "k int"), e=X.mentions(F.lit("It BURNED down")), f=X.mentions(F.lit("fireplace")), g=X.mentions(F.lit(None).cast("string")), h=X.join_non_empty(F.lit("a"), F.lit(""), F.lit("b")), i=X.safe_filename(F.lit("a/b:c")), j=X.after_last(F.lit("x-1-22")),
    )
    assert tuple(r) == ("Make/Model/Year: M  2020\nNarrative: n", '{"component":"TIRES","crash":"Y","fire":"N","injured":2,"deaths":0}', 1, None, True, False, False, "a b", "a_b_c", "22")


def test_vectors(spark):
    v = F.array(*[F.lit(x) for x in (0.1, 2.0, 2.0, -1.0)])
    r = one(spark, a=X.argmax(v), t=X.top_k(v, 3), s=X.softmax(v))
    assert r["a"] == 1 and [x["label"] for x in r["t"]] == [1, 2, 0] and sum(r["s"]) == pytest.approx(1)


def test_binomial_se(spark):
    assert one(spark, a=X.binomial_se(F.lit(0.8835341365), F.lit(498)))["a"] == pytest.approx(0.01437461828, abs=1e-9)


def test_prices(spark):
    calls = [("openai", "gpt-5.4-mini-2026-03-17", 100, 0, 10, 0, False), ("openai", "nobody", 1, 1, 1, 1, False), ("anthropic", "claude-haiku-4-5", 1000, 100, 10, 40, True)]
    table = spark.createDataFrame(calls, "provider string, model string, uncached long, cached long, output long, written long, batch boolean")
    got = {r["model"]: r for r in cascade.with_cost(table, cascade.prices(spark)).collect()}
    assert got["gpt-5.4-mini-2026-03-17"]["priced_as"] == "gpt-5.4-mini"
    assert got["gpt-5.4-mini-2026-03-17"]["cost_usd"] == pytest.approx((100 * 0.75 + 10 * 4.5) / 1e6)
    assert got["nobody"]["cost_usd"] is None
    assert got["claude-haiku-4-5"]["cost_usd"] == pytest.approx((1000 * 1 + 100 * 0.1 + 40 * 1.25 + 10 * 5) / 1e6 * 0.5)


def test_published_label_coverage(spark):
    # Published class counts in order, the bucket last.
    counts = [247804, 217760, 168418, 156232, 143803, 120804, 116653, 106754, 103855, 89423, 85066, 78584, 62646, 62131, 56025, 52959, 41874, 38935, 28728, 28121, 24356, 24042, 21617, 21601, 20639, 8175, 7828, 5910, 4919, 4520]
    tail = 17614
    rows = [(f"c{i:02d}", n) for i, n in enumerate(counts)] + [(f"t{i:02d}", tail // 20 + (i < tail % 20)) for i in range(20)]
    found = labels.label_coverage(spark.createDataFrame(rows, "label string, n long"), "label").where("kept").orderBy("rank").collect()
    assert len(found) == 30 and found[-1]["cum"] == pytest.approx(0.991875, abs=1e-6) and found[-2]["cum"] == pytest.approx(0.98979, abs=1e-5)


@pytest.mark.parametrize(("k", "m", "n"), [(132, 134, 147), (94, 106, 131), (346, 345, 420)])
def test_promotion_gate_overlapping_intervals(spark, k, m, n):
    rows = [(key, k, n, m, n) for key in ("current", "legacy", "hard")]
    table = spark.createDataFrame(rows, "key string, champion_k long, champion_n long, challenger_k long, challenger_n long")
    r = evaluation.promotion_gate(table).first()
    assert not r["promote"] and not r["intervals_apart"]


def test_promotion_gate_promotes(spark):
    rows = [("current", 500, 1000, 700, 1000), ("legacy", 800, 1000, 790, 1000), ("hard", 300, 500, 290, 500)]
    table = spark.createDataFrame(rows, "key string, champion_k long, champion_n long, challenger_k long, challenger_n long")
    assert evaluation.promotion_gate(table).first()["promote"]


def test_score_replies(spark):
    replies = spark.createDataFrame([("1", '{"component": "TIRES"}'), ("2", '{"component": "CHILD SEAT"}'), ("3", "no idea"), ("4", '{"component": "Wheels?"}')], "cmplid string, reply string")
    gold = spark.createDataFrame([("1", ["TIRES", "WHEELS"]), ("2", ["OTHER"]), ("3", ["TIRES"]), ("4", ["WHEELS"])], "cmplid string, accept array<string>")
    got = {r["cmplid"]: (r["pred"], r["correct"], r["off_list"], r["error"] is not None) for r in evaluation.score_replies(replies, gold).collect()}
    assert got == {"1": ("TIRES", True, False, False), "2": ("OTHER", True, False, False), "3": (None, False, None, True), "4": ("OTHER", False, True, False)}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_universally_missed_sends_one_row_an_id(spark):
    rows = [(f"m{i}", "a", False, "x") for i in range(70)] + [(f"m{i}", None, None if i else False, "y" if i % 2 else None) for i in range(70)]
    rows += [(f"m{i}", "b", i == 3, "x") for i in range(70)] + [(f"m{i}", "c", False, "x") for i in range(69)] + [("m0", "c", False, "z"), (None, "a", False, "w")]
    rows += [(f"m{i}", "d", None, "x") for i in range(70)]  # never judged: not missed
    found = cascade.universally_missed(spark.createDataFrame(rows, "model string, cmplid string, correct boolean, pred string").repartition(3))
    assert [tuple(r) for r in found.collect()] == [(None, 70, True, ["y"]), ("a", 70, False, ["w", "x"])]
    plan = _plan(found)
    assert "count(distinct" not in plan and "bit_or" in plan


def test_readable_sample_by_group_moves_no_whole_table(spark):
    rows = [(i, "k" if i % 2 else None, "x" * (200 if i % 10 in (1, 2, 3) and i < 14 else 5)) for i in range(60)]
    table = spark.createDataFrame(rows, "id long, g string, text string").repartition(3)
    found = sampling.readable_sample(table, "text", 4, "id", 7, group="g")
    assert found.columns == ["id", "g", "text"] and "Join" not in _plan(found)
    for g in ("k", None):
        own = table.where(F.col("g").eqNullSafe(F.lit(g)))
        readable = own.where("length(text) = 200")
        pool = readable if readable.count() >= 4 else own
        assert {r["id"] for r in found.where(F.col("g").eqNullSafe(F.lit(g))).collect()} == {r["id"] for r in sampling.uniform_sample(pool, 4, "id", 7).collect()}
    assert sampling.readable_sample(table.where("false"), "text", 4, "id", 7, group="g").count() == 0
