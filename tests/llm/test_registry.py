"""Every operator has a registered query; those with SQL agree with DuckDB on the small tables."""

import os

import duckdb
import pytest

from quillon.llm.oracle import ORACLES
from quillon.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    rows = sorted(map(repr, want.fetchall()))
    assert os.path.exists(SF)
    assert sorted(repr(tuple(r)) for r in QUERIES[name](spark, SF).select(columns).collect()) == rows
