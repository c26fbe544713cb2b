"""Every registered query with an oracle must equal its DuckDB statement (sf0.001)."""

import os

import pytest

import __spark_entry__ as se
from tests.oracle_compare import canon, close, digest, duck

SF = os.environ.get("TIDEMARK_TEST_SF", "/root/testdata/sf0.001")
SQL = se.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry_smoke(spark):
    df = se.entry(spark)
    assert df.count() > 0
    assert set(df.columns) >= {"series_id", "split", "step", "rmse", "f24"}


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(se.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    s = se.queries()[name](spark, SF).toPandas()
    d = con.execute(SQL[name]).df()
    assert sorted(s.columns) == sorted(d.columns)
    cs, cd = canon(s), canon(d)
    assert len(cs) == len(cd)
    assert digest(cs) == digest(cd) or close(cs, cd)
