"""Keyed merge / delete+insert / append materializations and table writes."""

import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F

from tierline.operators.sinks import _anti, materialize, materialize_newest, write_table
from tierline.session import scratch_path
from helpers import rows


def _df(spark, data):
    return spark.createDataFrame(data, "k long, v string")


def test_merge_first_run_creates_then_updates(spark):
    table = "gold.t_merge_unit"
    old = _df(spark, [(1, "a"), (2, "b"), (None, "n0")])
    new = _df(spark, [(2, "B"), (3, "c"), (None, "n1")])
    materialize(spark, old, table, "incremental", "merge", ["k"], root=scratch_path(spark, "g"))
    got = materialize(spark, new, table, "incremental", "merge", ["k"])
    assert rows(got) == sorted([(1, "a"), (2, "B"), (3, "c"), (None, "n1")], key=repr)


def test_merge_rejects_duplicate_source_keys(spark):
    table = "gold.t_merge_dup"
    materialize(spark, _df(spark, [(1, "a")]), table, "incremental", "merge", ["k"], root=scratch_path(spark, "g"))
    with pytest.raises(ValueError):
        materialize(spark, _df(spark, [(1, "x"), (1, "y")]), table, "incremental", "merge", ["k"], root=scratch_path(spark, "g"))


def test_delete_insert_keeps_source_duplicates(spark):
    table = "gold.t_di"
    materialize(spark, _df(spark, [(1, "a"), (1, "a2"), (2, "b")]), table, "incremental",
                "delete+insert", ["k"], root=scratch_path(spark, "g"))
    got = materialize(spark, _df(spark, [(1, "x"), (1, "y")]), table, "incremental",
                      "delete_insert", ["k"])
    assert rows(got) == [(1, "x"), (1, "y"), (2, "b")]


def test_append_and_table_replace(spark):
    table = "gold.t_app"
    materialize(spark, _df(spark, [(1, "a")]), table, "incremental", "append", root=scratch_path(spark, "g"))
    got = materialize(spark, _df(spark, [(2, "b")]), table, "incremental", "append", root=scratch_path(spark, "g"))
    assert rows(got) == [(1, "a"), (2, "b")]
    got = materialize(spark, _df(spark, [(9, "z")]), table, "table")
    assert rows(got) == [(9, "z")]


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        materialize(spark, _df(spark, [(1, "a")]), "gold.t_x", "incremental", "upsert_magic", ["k"], root=scratch_path(spark, "g"))


def test_keyed_upsert_null_safe(spark):
    old = _df(spark, [(None, "old"), (1, "one")])
    new = _df(spark, [(None, "new")])
    assert rows(_anti(old, new, ["k"]).unionByName(new)) == sorted([(None, "new"), (1, "one")], key=repr)


def test_write_table_dynamic_overwrite(spark):
    table = "silver.t_dyn"
    df = spark.range(12).select(F.col("id"), (F.col("id") % 3).alias("p"))
    write_table(spark, df, table, partition_by=["p"], location=scratch_path(spark, "t_dyn"))
    write_table(spark, spark.createDataFrame([(100, 1)], "id long, p long"), table, "overwrite")
    got = spark.table(table)
    assert got.filter("p = 1").count() == 1
    assert got.filter("p <> 1").count() == 8


def test_partitioned_merge_rewrites_only_touched_partitions(spark):
    table = "gold.t_part_merge"
    old = spark.createDataFrame([(1, "a", 2020), (2, "b", 2020), (3, "c", 2021), (4, "d", 2022)],
                                "k long, v string, y int")
    materialize(spark, old, table, "incremental", "merge", ["y", "k"], partition_by=["y"],
                root=scratch_path(spark, "g"))

    def files():
        return {r["y"]: r["f"] for r in spark.table(table).select(
            "y", F.col("_metadata.file_path").alias("f")).collect()}
    before = files()
    new = spark.createDataFrame([(2, "B", 2020), (9, "z", 2023)], "k long, v string, y int")
    got = materialize(spark, new, table, "incremental", "merge", ["y", "k"])
    assert rows(got, ["k", "v", "y"]) == [(1, "a", 2020), (2, "B", 2020), (3, "c", 2021),
                                           (4, "d", 2022), (9, "z", 2023)]
    after = files()
    assert after[2021] == before[2021] and after[2022] == before[2022]   # untouched
    assert after[2020] != before[2020]                                   # rewritten


def test_change_feed_newest_wins_delete_and_reinsert(spark):
    from tierline.operators.sinks import apply_change_feed
    snap = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "n")], "k long, v string")
    feed = spark.createDataFrame(
        [(1, "a1", "U", 1), (1, "a2", "U", 2),          # two updates: newest wins
         (2, None, "D", 1),                             # delete
         (3, None, "D", 1), (3, "c2", "I", 2),          # delete then re-insert
         (4, "d", "I", 1), (4, None, "D", 2),           # insert then delete -> absent
         (None, "n2", "U", 1)],                          # NULL key matches NULL key
        "k long, v string, op string, seq int")
    got = apply_change_feed(snap, feed, ["k"], "seq", "op")
    assert rows(got) == sorted([(1, "a2"), (3, "c2"), (None, "n2")], key=repr)


def test_write_table_replace_swaps_version(spark):
    table = "silver.t_replace"
    write_table(spark, _df(spark, [(1, "a")]), table, location=scratch_path(spark, "t_rep"))
    write_table(spark, _df(spark, [(7, "z"), (8, "y")]), table, "replace")
    assert rows(spark.table(table)) == [(7, "z"), (8, "y")]


def _parted(spark, data):
    return spark.createDataFrame(data, "k long, v string, p int")


def test_refresh_drops_partitions_that_are_no_more(spark):
    for table, kind in (("gold.t_refresh", "m"), ("silver.t_refresh", "w")):
        old, new = _parted(spark, [(1, "a", 1), (2, "b", 2)]), _parted(spark, [(3, "c", 1), (4, "d", None)])
        if kind == "m":
            materialize(spark, old, table, "table", partition_by=["p"], root=scratch_path(spark, "g"))
            materialize(spark, new, table, "table")
        else:
            write_table(spark, old, table, partition_by=["p"], location=scratch_path(spark, "w") + "/v0")
            write_table(spark, new, table, "replace")
        assert rows(spark.table(table), ["k", "v", "p"]) == sorted([(3, "c", 1), (4, "d", None)], key=repr)
        # and once more, now from the swapped version with its NULL partition
        materialize(spark, _parted(spark, [(5, "e", 2)]), table, "table")
        assert rows(spark.table(table), ["k", "v", "p"]) == [(5, "e", 2)]


def test_append_into_partitioned_table_is_readable(spark):
    table = "gold.t_append_part"
    materialize(spark, _parted(spark, [(1, "a", 1)]), table, "incremental", "append", partition_by=["p"],
                root=scratch_path(spark, "g"))
    got = materialize(spark, _parted(spark, [(2, "b", 1), (3, "c", 7)]), table, "incremental", "append")
    assert rows(got, ["k", "v", "p"]) == [(1, "a", 1), (2, "b", 1), (3, "c", 7)]


def test_merge_key_without_partition_column_moves_rows(spark):
    table = "gold.t_moved"
    materialize(spark, _parted(spark, [(1, "a", 1), (2, "b", 2)]), table, "incremental", "merge", ["k"],
                partition_by=["p"], root=scratch_path(spark, "g"))
    got = materialize(spark, _parted(spark, [(2, "B", 1), (3, "c", 3)]), table, "incremental", "merge", ["k"])
    assert rows(got, ["k", "v", "p"]) == [(1, "a", 1), (2, "B", 1), (3, "c", 3)]
    with pytest.raises(ValueError):
        materialize(spark, _parted(spark, [(9, "z", 1)]), table, "incremental", "append", partition_by=["v"])


def test_new_tables_need_a_place(spark):
    with pytest.raises(ValueError):
        materialize(spark, _df(spark, [(1, "a")]), "gold.t_nowhere", "table")
    with pytest.raises(ValueError):
        write_table(spark, _df(spark, [(1, "a")]), "silver.t_nowhere")


def test_change_without_op_is_an_upsert(spark):
    from tierline.operators.sinks import apply_change_feed
    snap = _df(spark, [(1, "a"), (2, "b")])
    feed = spark.createDataFrame([(1, "A", None, 1), (2, None, "D", 1)], "k long, v string, op string, seq int")
    assert rows(apply_change_feed(snap, feed, ["k"], "seq", "op")) == [(1, "A")]


def test_newest_row_survives_a_backfill(spark):
    table = "online.t_newest"
    df = lambda data: spark.createDataFrame(data, "k long, t date, x int")
    import datetime as dt
    d = lambda n: dt.date(2024, 1, n)
    materialize_newest(spark, df([(1, d(9), 10), (2, None, 1)]), table, ["k"], "t", scratch_path(spark, "o"))
    got = materialize_newest(spark, df([(1, d(3), 5), (2, d(1), 2), (3, d(1), 3)]), table, ["k"], "t")
    assert rows(got, ["k", "x"]) == [(1, 10), (2, 2), (3, 3)]


def test_silver_job_counts_and_leaves_no_views(spark):
    from tierline.operators.jobs import silver_job
    p1, p2 = scratch_path(spark, "j1"), scratch_path(spark, "j2")
    _df(spark, [(1, "a"), (2, "b")]).write.parquet(p1)
    _df(spark, [(3, "c")]).write.parquet(p2)
    m = silver_job(spark, [p1, p2], ["SELECT * FROM source_data WHERE k > 1", "SELECT k, upper(v) AS v FROM step_0"],
                   "silver.t_job", location=scratch_path(spark, "job") + "/t")
    assert m == {"rows_in": 3, "rows_out": 2} and rows(spark.table("silver.t_job")) == [(2, "B"), (3, "C")]
    assert not any(t.name in ("source_data", "step_0") for t in spark.catalog.listTables())


VALUES = ["new york", "rome", "a/b", "x=y", "50%", "50%20", "o'hare", "Zürich", "tab\there", "back\\slash", None]


def _partitioned(spark, name, value_type="string", values=VALUES):
    table = f"gold.{name}"
    old = spark.createDataFrame([(i, v, "old") for i, v in enumerate(values)], f"id long, p {value_type}, v string")
    materialize(spark, old, table, "table", partition_by=["p"], root=scratch_path(spark, "g"))
    return table, old


def test_special_partition_values_survive_refresh_and_replace(spark):
    table, old = _partitioned(spark, "t_special")
    want = rows(old.select("id", "p"))
    assert rows(spark.table(table).select("id", "p")) == want
    materialize(spark, old.withColumn("v", F.lit("new")), table, "table")
    assert rows(spark.table(table).select("id", "p")) == want
    assert {r["v"] for r in spark.table(table).collect()} == {"new"}
    write_table(spark, old.filter("id <> 0"), table, "replace")
    assert rows(spark.table(table).select("id", "p")) == [x for x in want if x[0] != 0]


@pytest.mark.parametrize("keys", [["p", "id"], ["id"]])
def test_special_partition_values_survive_merges(spark, keys):
    table, old = _partitioned(spark, f"t_special_merge_{len(keys)}", values=VALUES[:-1])
    batch = spark.createDataFrame([(0, "new york", "new"), (5, "50%20", "new"), (100, "a/b", "new")], "id long, p string, v string")
    materialize(spark, batch, table, "incremental", "merge", keys)
    want = {r["id"]: (r["p"], r["v"]) for r in old.collect()} | {0: ("new york", "new"), 5: ("50%20", "new"), 100: ("a/b", "new")}
    assert {r["id"]: (r["p"], r["v"]) for r in spark.table(table).collect()} == want
    assert spark.table(table).count() == len(want)


@pytest.mark.parametrize("kind,values", [
    ("date", [dt.date(2024, 1, 1), dt.date(2024, 12, 31)]),
    ("timestamp_ntz", [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 10, 30, 0, 500000)]),
    ("decimal(10,2)", [decimal.Decimal("1.50"), decimal.Decimal("-2.00")]),
    ("boolean", [True, False]), ("double", [0.1, -3.0])])
def test_typed_partition_values_survive(spark, kind, values):
    table, old = _partitioned(spark, "t_typed_" + kind[:4], kind, values)
    materialize(spark, old, table, "table")
    materialize(spark, old.filter("id = 1").withColumn("v", F.lit("new")), table, "incremental", "merge", ["p", "id"])
    assert rows(spark.table(table).select("id", "p", "v")) == sorted(
        [(0, values[0], "old"), (1, values[1], "new")], key=repr)


def test_empty_batches_and_refreshes_of_partitioned_tables(spark):
    table, old = _partitioned(spark, "t_empty_batch")
    for strategy in ("merge", "delete_insert", "append"):
        materialize(spark, old.limit(0), table, "incremental", strategy, ["p", "id"])
        assert spark.table(table).count() == len(VALUES)
    materialize(spark, old.limit(0), table, "table")
    assert spark.table(table).count() == 0
    materialize(spark, old, table, "incremental", "merge", ["p", "id"])
    assert spark.table(table).count() == len(VALUES)


@pytest.mark.parametrize("parts", [None, ["p"]])
def test_refresh_takes_the_columns_of_its_query(spark, parts):
    table = f"gold.t_columns_{bool(parts)}"
    old = spark.createDataFrame([(1, "a b"), (2, "c")], "id int, p string")
    materialize(spark, old, table, "table", partition_by=parts, root=scratch_path(spark, "g"))
    new = old.selectExpr("CAST(id AS BIGINT) AS id", "id * 2 AS extra", "p", "named_struct('x y', id) AS s")
    materialize(spark, new, table, "table")
    got = spark.table(table)
    assert set(got.columns) == {"id", "extra", "p", "s"} and dict(got.dtypes)["id"] == "bigint"
    assert rows(got.select("id", "extra", "p", "s.`x y`")) == [(1, 2, "a b", 1), (2, 4, "c", 2)]
    if parts:
        with pytest.raises(ValueError):
            materialize(spark, new.drop("p"), table, "table")


def test_view_given_by_sql_lives_in_the_catalog(spark):
    materialize(spark, _df(spark, [(1, "a"), (2, "b")]), "gold.t_view_base", "table", root=scratch_path(spark, "g"))
    got = materialize(spark, None, "gold.v_real", "view", view_sql="SELECT k FROM gold.t_view_base WHERE k > 1")
    assert rows(got) == [(2,)]
    assert [t.tableType for t in spark.catalog.listTables("gold") if t.name == "v_real"] == ["VIEW"]
    assert rows(spark.newSession().table("gold.v_real")) == [(2,)]
