"""The corpus pipeline against brute force on a small corpus, and the queries that SQL can express."""

import glob
import os

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from test_near_duplicates import slow_components
from test_texts import ITEMS, PATH, SCHEMA_TEXTS, key, slow_contamination, slow_lines
from tokenizers import Tokenizer

from siltstone.llm import langid, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def corpus(spark, texts, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    boiler = "\nall rights of this page are reserved by the owner alone"
    rows = [(i, (t[1] or "") + boiler if t[1] else t[1], "en", "s", 0) for i, t in enumerate(texts)]
    rows += [(900, "before the quick brown fox jumps over the lazy dog again and again today", "en", "s", 0), (901, boiler.strip(), "en", "s", 0)]
    spark.createDataFrame(rows, SCHEMA_TEXTS).repartition(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([i for i in ITEMS if i[0] != 2], "item_id int, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows


def test_stages_against_brute_force(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, want = docs.columns, [(d, t) for d, t, *_ in rows]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "decontaminate", "bpe"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        path = f"{folder}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if name == "language_id":
            want = [(d, t) for d, t in want if langid.features(t) is not None]
        elif name == "line_dedup":
            before = dict(want)
            want = [(d[1], t) for d, t in slow_lines(want)]
            want = [(d, t) for d, t in want if t == before[d] or t.strip()]
        elif name == "near_dedup":
            keep = {c for _, _, c in slow_components(want)}
            want = [(d, t) for d, t in want if d in keep]
        elif name == "decontaminate":
            dirty = {d[1] for d, _, n, _ in slow_contamination(want, [i for i in ITEMS if i[0] != 2]) if n}
            assert 900 in dirty
            want = [(d, t) for d, t in want if d not in dirty]
        else:
            library = Tokenizer.from_file(PATH)
            ids = {d: library.encode(t or "", add_special_tokens=False).ids for d, t in want}
            got = {r["doc_id"]: (r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) for r in docs.collect()}
            assert got == {d: (len(i), i) for d, i in ids.items()}
            break
        assert docs.columns == columns
        assert sorted((key(r["doc_id"]), r["text"]) for r in docs.collect()) == sorted((key(d), t) for d, t in want)


def test_stages_on_an_empty_table_and_with_clashing_names(spark, corpus):
    folder, rows = corpus
    more = SCHEMA_TEXTS + ", _lang_pred string, _ld_dropped long, _ld_doc string, key string, class long, block int"
    docs = spark.createDataFrame([(*r, "p", 5, "d", "k", 6, 7) for r in rows], more).repartition(2)
    plain = spark.createDataFrame(rows, SCHEMA_TEXTS).repartition(2)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), folder).count() == 0
        out = stage(spark, docs, folder)
        if name != "bpe":
            assert out.columns == docs.columns
            got = sorted(map(repr, out.select("doc_id", "text", "n_chars").collect()))
            assert got == sorted(map(repr, stage(spark, plain, folder).select("doc_id", "text", "n_chars").collect())) and got
            assert out.select("_lang_pred", "_ld_dropped", "_ld_doc", "key", "class", "block").distinct().count() == 1


def test_run_is_the_stages(spark, corpus):
    folder, _ = corpus
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids"] and got.count() > 20


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    found = queries.QUERIES[name](spark, SF)
    wanted = con.execute(queries.ORACLES[name])
    names = [d[0] for d in wanted.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(repr, (tuple(r) for r in found.select(*names).collect()))) == sorted(map(repr, wanted.fetchall()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_language_query_is_accurate(spark):
    found = queries.op3_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.9 * len(found)
