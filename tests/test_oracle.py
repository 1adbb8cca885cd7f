"""Every registered query against its SQL twin on the smallest data set."""

from __future__ import annotations

import os

import pytest
from check_oracle import compare, oracle_connection

from __spark_entry__ import oracle_sql, queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle_connection(FOLDER)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, FOLDER)
    got = (df.columns, [tuple(r) for r in df.collect()])
    if name in oracle_sql():
        cursor = con.execute(oracle_sql()[name])
        assert compare(got, ([d[0] for d in cursor.description], cursor.fetchall())) == ""
    else:
        assert got[1]
