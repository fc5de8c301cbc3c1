"""Every registered access-log query against its SQL twin."""

import math
import os

import duckdb
import pytest

from lumenlog.plans import queries as Q

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(norm(r[i]) for i in order) for r in values), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{DIR}/events.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_equals_sql(spark, duck, name):
    got = Q.queries()[name](spark, DIR)
    want = duck.execute(Q.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())
