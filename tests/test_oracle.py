"""Every query with SQL against that SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb
import pytest

from factloom.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(rows):
    # Values are compared exactly; only floats are brought to a common rounding.
    return Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in rows)


def duck(sql: str, sf_dir: str):
    base = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        base.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return base.sql(sql)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    got = registry.queries()[name](spark, SF)
    wanted = duck(registry.oracle_sql()[name], SF)
    columns = sorted(got.columns)
    assert columns == sorted(wanted.columns)
    assert plain(tuple(r[c] for c in columns) for r in got.collect()) == plain(wanted.select(*columns).fetchall())


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())
