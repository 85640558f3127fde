"""Every registered query of the engine against DuckDB on the smallest tables."""

import datetime
import glob
import os

import duckdb
import pytest

from quern.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def norm(v):
    if v is None:
        return "N"
    if isinstance(v, (bool, int)):
        return f"{float(v):.9g}"
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(norm(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_tfidf_counts_words_without_python(spark):
    from quern.queries import QUERIES

    plan = QUERIES["q105_tfidf"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "split(" in plan


def test_a_count_of_one_word_needs_no_python(spark):
    from quern.queries import QUERIES

    assert "Python" not in QUERIES["q70_tokenize"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
