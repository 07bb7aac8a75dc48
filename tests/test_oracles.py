"""Every registered query against its DuckDB oracle (the driver's gate)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as se  # noqa: E402
from milepost.plans.registry import all_queries  # noqa: E402
from tests.conftest import SF01  # noqa: E402
from tools.check_oracles import TABLES, digest  # noqa: E402

KEYS = sorted(se.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return con


def test_every_key_has_an_oracle():
    missing = sorted(set(all_queries()) - set(se.oracle_sql()))
    assert missing == []


def test_entry_smoke(spark):
    df = se.entry(spark)
    assert len(df.columns) == 21
    assert df.count() > 0


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, duck, key):
    df = se.queries()[key](spark, SF01)
    srows = [tuple(r) for r in df.collect()]
    rel = duck.sql(se.oracle_sql()[key])
    drows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(rel.columns, drows)[0]
