"""Every registered query against its DuckDB oracle SQL (sf0.001).

Same comparison as the driver: column names, row count and the multiset of
row values (floats compared to 9 significant digits)."""

import datetime as dt
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as E
from tierline.plans import all_oracles, all_queries
from tierline.sources.tables import TABLES
from helpers import SF_SMALL

ORACLES = all_oracles()
ALL = all_queries()


def _norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dt.datetime) and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    return v


_SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT",
                  "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE",
                  "timestamp_ntz": "TIMESTAMP"}


def _duck_type(t):
    if t.startswith("array<"):
        return _duck_type(t[6:-1]) + "[]"
    return _SPARK_TO_DUCK.get(t, t.upper())


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_oracle(spark, duck, key):
    df = ALL[key](spark, SF_SMALL)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLES[key])
    o_cols, o_rows = [d[0] for d in res.description], res.fetchall()
    assert sorted(s_cols) == sorted(o_cols)
    o_types = {d[0]: str(d[1]) for d in res.description}
    assert {c: _duck_type(t) for c, t in df.dtypes} == o_types
    assert len(s_rows) == len(o_rows)
    assert _canon(s_cols, s_rows) == _canon(o_cols, o_rows)


@pytest.mark.parametrize("key", sorted(set(ALL) - set(ORACLES)))
def test_rows_only_queries_run(spark, key):
    df = ALL[key](spark, SF_SMALL)
    assert df.count() > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "churned" in df.columns


ZONE_SENSITIVE = ["monthly_summary", "daily_summary", "rolling_24h", "latest_features",
                  "pit_created_tiebreak", "stream_hourly", "customer_metrics"]


@pytest.mark.parametrize("key", ZONE_SENSITIVE)
def test_results_do_not_depend_on_session_zone(spark, duck, key):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        test_matches_oracle(spark, duck, key)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
