"""Every registered query against its oracle, at the smallest scale of the given tables."""

import math
import os

import pandas as pd
import pytest

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return connection


def canonical(frame):
    def cell(value):
        if value is None or value is pd.NA or value != value:
            return None
        return float(value) if isinstance(value, (int, float)) or hasattr(value, "dtype") else str(value)

    found = [tuple(cell(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False)]
    return sorted(found, key=lambda row: tuple((v is None, str(v)) for v in row))


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    got = contract.queries()[name](spark, FOLDER).toPandas()
    expected = duck.execute(contract.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    ours, theirs = canonical(got), canonical(expected)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9))


def test_oracles_name_known_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
