import sys

import pytest

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from oracle_check import compare, connect

import __spark_entry__ as driver
from lookout.plans.oracle import SQL
from lookout.plans.registered import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(driver.queries()) and set(SQL) <= set(driver.oracle_sql())


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["key", "company", "job_id", "title", "score", "rank"]
    rows = sorted(df.collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    assert [r.score for r in rows] == sorted((r.score for r in rows), reverse=True) and rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, name) is None
