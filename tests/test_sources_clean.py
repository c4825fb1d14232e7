"""Sources (paths, naming, union) and silver operators (SQL check, rules)."""

import pytest
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException, ParseException

from tierline.operators.clean import (
    check_query, dedup_latest, deidentify, quality_flags, quality_report, transform_sql,
)
from tierline.session import scratch_path
from tierline.sources.files import normalize_path, path_sql, read_sources, table_name_for
from helpers import rows


def test_normalize_path():
    assert normalize_path("s3://b/x") == "s3a://b/x"
    assert normalize_path("s3a://b/x") == "s3a://b/x"
    assert normalize_path("bucket/bronze/") == "s3a://bucket/bronze/"
    assert normalize_path("/tmp/x") == "/tmp/x"
    assert normalize_path("file:/tmp/x") == "file:/tmp/x"


def test_table_name_for():
    assert table_name_for("s3a://b/silver/1a2b3c4d/", "nessie") == "nessie.silver.t1a2b3c4d"
    assert table_name_for("s3://ns/My-Table", "nessie") == "nessie.ns.my_table"
    assert table_name_for("", "nessie") == "nessie.raw.table"
    assert table_name_for("s3://only", "c") == "c.raw.table"


def test_read_sources_union_by_name_and_missing(spark):
    p1, p2 = scratch_path(spark, "u1"), scratch_path(spark, "u2")
    spark.createDataFrame([(1, "a")], "id long, x string").write.parquet(p1)
    spark.createDataFrame([("b", 2, 3.0)], "x string, id long, extra double").write.parquet(p2)
    got = read_sources(spark, [p1, p2], view="src_test")
    assert rows(got, ["id", "x", "extra"]) == [(1, "a", None), (2, "b", 3.0)]
    assert spark.table("src_test").count() == 2
    with pytest.raises(AnalysisException):
        read_sources(spark, [p1, p1 + "_missing"])
    assert read_sources(spark, [p1, p1 + "_missing"], on_missing="skip").count() == 1
    with pytest.raises(FileNotFoundError):
        read_sources(spark, [p1 + "_missing"], on_missing="skip")


def test_check_query_accepts_select_and_with(spark):
    assert check_query(spark, "SELECT 1 AS a;") == "SELECT 1 AS a"
    check_query(spark, "WITH x AS (SELECT 1 AS a) SELECT a FROM x -- trailing comment")
    out = transform_sql(spark, ["SELECT 1 AS a", "SELECT a + 1 AS b FROM step_0"])
    assert out.first()["b"] == 2


@pytest.mark.parametrize("bad", [
    "DROP TABLE x", "INSERT INTO x SELECT 1", "CREATE TABLE y AS SELECT 1",
    "SELECT 1; SELECT 2", "SELECT 1) q; DROP TABLE x; SELECT * FROM (SELECT 1",
])
def test_check_query_rejects(spark, bad):
    with pytest.raises((ParseException, AnalysisException)):
        check_query(spark, bad)


def test_quality_flags_and_report(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 0.0), (None, -1.0)], "id long, q double")
    rules = {"non_positive": F.col("q") <= 0, "too_big": F.col("q") > 100}
    flagged = quality_flags(df, rules)
    got = {r["id"]: (r["quality_flag"], list(r["failed_rules"])) for r in flagged.collect()}
    assert got[1] == ("VALID", []) and got[2] == ("INVALID", ["non_positive"])
    rep = {r["rule"]: (r["failed"], r["passed"], r["rows_kept"], r["rows_removed"])
           for r in quality_report(df, rules, F.col("id").isNotNull()).collect()}
    assert rep["non_positive"] == (1, 1, 2, 1)
    assert rep["too_big"] == (0, 2, 2, 1)


def test_dedup_latest_hot_key(spark):
    data = [(1, i, f"v{i}") for i in range(500)] + [(2, 3, "x"), (2, 3, "y")]
    df = spark.createDataFrame(data, "k long, ts long, v string")
    assert rows(dedup_latest(df, ["k"], ["ts"])) == [(1, 499, "v499"), (2, 3, "y")]


def test_deidentify(spark):
    df = spark.createDataFrame([("a@b.com", "mail me at x.y@z.org or +1 555 123 4567")],
                               "email string, text string")
    r = deidentify(df, hash_cols=["email"], redact_cols=["text"]).first()
    assert len(r["email"]) == 64
    assert r["text"] == "mail me at [EMAIL] or [PHONE]"


def test_path_sql_reads_only_and_keeps_braces(spark):
    p = scratch_path(spark, "psql")
    spark.createDataFrame([(1, "{x}"), (2, "y")], "id long, v string").write.parquet(p)
    assert path_sql(spark, "SELECT id FROM parquet.`{src}` WHERE v = '{x}'", src=p).first()["id"] == 1
    with pytest.raises((AnalysisException, ParseException)):
        path_sql(spark, "CREATE TABLE t_evil AS SELECT * FROM parquet.`{src}`", src=p)


def test_transform_sql_puts_views_back(spark):
    spark.range(3).createOrReplaceTempView("mine")
    out = transform_sql(spark, ["SELECT v + 1 AS v FROM mine", "SELECT v * 2 AS v FROM step_0"],
                        {"mine": spark.createDataFrame([(5,)], "v long")})
    assert out.first()["v"] == 12
    assert spark.table("mine").count() == 3
    assert not any(t.name == "step_0" for t in spark.catalog.listTables())
    spark.catalog.dropTempView("mine")


def test_bad_values_become_null(spark):
    from tierline.functions import json_int
    from tierline.operators.features import define_feature_view
    from tierline.plans.silver import clean_orders
    import datetime as dt
    df = spark.createDataFrame([('{"k": 7}',), ('{"k":"abc"}',), ("no",)], "j string")
    assert [r[0] for r in df.select(json_int("j", "k")).collect()] == [7, None, None]
    o = spark.createDataFrame([(1, 2, 1e12, dt.datetime(2000, 1, 1), "x", "F")],
                              "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz, "
                              "o_orderpriority string, o_orderstatus string")
    assert clean_orders(o).first()["amount"] is None
    v = define_feature_view("v", spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "x")],
                                                       "k long, event_timestamp timestamp_ntz, f string"),
                            ["k"], [("f", "int64")])
    assert v.frame().first()["f"] is None
