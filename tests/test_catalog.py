"""Every query of the catalog against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import verify_oracle
from patchlens.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    if name in catalog.SQL:
        found = con.execute(catalog.SQL[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert verify_oracle.rows(df.columns, got) == verify_oracle.rows(columns, found.fetchall())


def test_flagship(spark):
    rows = catalog.flagship(spark, SF).collect()
    assert rows and all(r.n_items >= 1 and r.n_equal >= 1 for r in rows)
