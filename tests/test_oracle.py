"""Every SQL-checkable query against its DuckDB oracle on the smallest tables."""

import pytest

import __spark_entry__ as E
from tools.check_queries import digest, duck

from conftest import SF_SMALL

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    s = digest(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(SQL[name])
    o = digest([d[0] for d in rel.description], rel.fetchall())
    assert s[0] == o[0], (s[0], o[0])
    assert s[1] == o[1]
    assert s[2] == o[2]


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["split", "label", "target", "n"]
