"""Every registered query of the library against its SQL on the same Parquet files."""

import glob
import math
import os

import duckdb
import pytest

from siltstone.plans import catalogue, feature_queries, job_queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = catalogue.QUERIES | job_queries.QUERIES | feature_queries.QUERIES
ORACLES = catalogue.ORACLES | job_queries.ORACLES | feature_queries.ORACLES
#: Queries that may return nothing.
EMPTY = {"drift_no_fire"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return bool(value)
    if isinstance(value, (int, float)) or hasattr(value, "dtype"):
        return round(float(value), 9)
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, db, name):
    found = QUERIES[name](spark, SF)
    wanted = db.execute(ORACLES[name])
    names = [d[0] for d in wanted.description]
    assert sorted(found.columns) == sorted(names)
    got = rows_of(found.columns, found.collect())
    assert got == rows_of(names, wanted.fetchall()) and (got or name in EMPTY)


def test_rows_only_query_runs(spark):
    found = catalogue.QUERIES["ml_score"](spark, SF)
    assert found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert found.where("pred is null or confidence is null or confidence not between 0 and 1").count() == 0


def test_missing_requirements_leave_the_library(spark, monkeypatch):
    """Whatever the corpus subpackage cannot import, the library's own queries stay."""
    import __spark_entry__

    def fails(name):
        raise ImportError(name)

    monkeypatch.setattr(__spark_entry__.importlib, "import_module", fails)
    assert set(__spark_entry__.queries()) == set(QUERIES)


def test_entry_points(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
