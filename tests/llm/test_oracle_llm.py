"""Queries with SQL against DuckDB, and the columns every query returns."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tierline.llm.queries import ORACLES, QUERIES
from tierline.sources.tables import TABLES

from llm_helpers import SF_SMALL


def _norm(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_sql(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = QUERIES[key](spark, SF_SMALL)
    res = con.execute(ORACLES[key])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(repr(tuple(map(_norm, r))) for r in res.fetchall())
    got = sorted(repr(tuple(map(_norm, r))) for r in df.select(*cols).collect())
    assert got == want


def test_registered_with_the_entry_module():
    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {k[:k.index("_") + 1] for k in names if k.startswith("op") and k[2].isdigit()}
    assert "pipeline" in names and set(ORACLES) <= set(entry.oracle_sql())
