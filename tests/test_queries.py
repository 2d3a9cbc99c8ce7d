"""Every registered query against its SQL."""

from __future__ import annotations

import pytest
from oracle import compare, connect

import __spark_entry__ as entry_point


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(entry_point.queries()))
def test_query(spark, con, sf_dir, name):
    df = entry_point.queries()[name](spark, sf_dir)
    sql = entry_point.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
        return
    rows, differences = compare(df, con, sql)
    assert rows > 0 and not differences


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["domain", "n_docs", "tokens"] and df.count() == 20
