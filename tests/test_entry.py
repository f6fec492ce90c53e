"""Every registered query against its SQL twin on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from checks.oracles import ORACLES
from checks.queries import REGISTERED

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def shown(value):
    return round(value, 6) if isinstance(value, float) else value


def test_entry_runs(spark):
    assert contract.entry(spark).count() == 50


def test_every_query_has_a_twin():
    assert set(REGISTERED) == set(ORACLES)
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(REGISTERED))
def test_query_equals_sql(spark, duck, name):
    df = contract.queries()[name](spark, SMALL)
    result = duck.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    expected = sorted((tuple(map(shown, row)) for row in result.fetchall()), key=repr)
    assert sorted((tuple(shown(r[c]) for c in columns) for r in df.collect()), key=repr) == expected
