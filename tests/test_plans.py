"""Physical-plan checks: pushdown, pruning, shuffle counts, no row UDFs."""

import re

import pytest

from tierline.operators.sinks import materialize, touched_rows
from tierline.operators.windows import rolling_frames
from tierline.plans import all_queries
from tierline.session import scratch_path
from helpers import SF_SMALL

ALL = all_queries()


def _plan(spark, key):
    spark.conf.set("spark.sql.adaptive.enabled", "false")   # static plan
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        return ALL[key](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.maxMetadataStringLength")


def _shuffles(plan):
    return len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition)", plan))


def test_filters_and_columns_reach_the_scan(spark):
    plan = _plan(spark, "clean_transactions")
    assert "PushedFilters: [IsNotNull(o_totalprice)" in plan
    assert "GreaterThan(o_totalprice,0.0)" in plan
    scan = re.search(r"ReadSchema: (struct<[^>]*>)", plan).group(1)
    assert "o_orderkey" in scan


def test_customer_metrics_prunes_and_preaggregates(spark):
    plan = _plan(spark, "customer_metrics")
    assert "partial_count(transaction_id" in plan        # map-side combine before shuffle
    assert "EqualTo(event_type,error)" in plan            # ticket filter pushed down
    assert "c_comment" not in plan


def test_pit_join_with_ttl_is_one_shuffle(spark):
    assert _shuffles(_plan(spark, "pit_join_ttl")) == 1


def test_rolling_window_shuffles_rows_once_and_never_slides_over_rows(spark):
    # event rows cross the network once, hashed on (user, coarse bucket); the
    # other exchanges carry per-(user, bucket) totals only.  The one
    # offset frame is over bucket numbers (at most 23 bucket rows); frames
    # over event rows are running ones, so no frame is re-aggregated per row.
    plan = _plan(spark, "rolling_24h")
    ex = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert sum("_B#" in e for e in ex) == 1
    assert len(ex) <= 4
    hour = 3_600_000_000
    frames = set(re.findall(r"specifiedwindowframe\(RangeFrame, (-?\d+), (-?\d+)\)", plan))
    assert frames == {(str(-23 * hour), str(-hour))}
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("key", [k for k in sorted(ALL) if not k.startswith(("rf_", "gbt_"))
                                 and k not in ("feature_importance", "batch_predict")])
def test_no_row_at_a_time_python(spark, key):
    plan = _plan(spark, key)
    assert "BatchEvalPython" not in plan
    assert "SinglePartition" not in plan or key in SINGLE_OK


# one-row global aggregates (final merge of per-task partials) and the
# ordered top-k / preview are the only single-partition steps
SINGLE_OK = {"store_sku_forecast", "metrics_regression_unit", "auc_scores", "silver_job",
             "data_coverage", "quality_report", "run_metrics", "metrics_classification",
             "metrics_regression", "metrics_auc", "label_distribution", "risk_distribution",
             "layer_counts", "catalog_profile", "top_risk", "preview_sql", "feature_catalog",
             "src_path_sql", "stratified_split", "outlier_score", "standard_scale"}


@pytest.mark.parametrize("key", ["rolling_multi", "rolling_24h", "event_counts_7d"])
def test_rolling_lengths_share_two_scans(spark, key):
    assert _plan(spark, key).count("FileScan") <= 2


@pytest.mark.parametrize("key, most", [("rolling_multi", 2), ("rolling_24h", 2), ("event_counts_7d", 1),
                                       ("account_risk_features", 1)])
def test_rolling_lengths_share_the_sorts_of_a_task(spark, key, most):
    # a task's memory is that of its sorts of rows and ghosts: one forward, one backward for a maximum
    plan = _plan(spark, key)
    assert 1 <= len(re.findall(r"Sort \[user_id#\d+L? ASC NULLS FIRST, _B#", plan)) <= most


def test_rolling_tasks_keep_their_size_as_the_input_grows(spark):
    rows = spark.range(4000).selectExpr("id % 7 AS k", "TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, 0, id) AS ts")
    plan = rolling_frames(rows, ["k"], "ts", [("count", None, "n", 3_600_000_000)], rows_per_task=200) \
        ._jdf.queryExecution().toString()
    assert re.search(r"hashpartitioning\(k#\d+L, _B#\d+L, 40\)", plan)


@pytest.mark.parametrize("key", ["rolling_distinct", "txn_pattern_features"])
def test_distinct_counts_keep_no_sets_per_row(spark, key):
    plan = _plan(spark, key)
    assert "collect_set" not in plan
    assert all(a == "unboundedpreceding$()" or b == "-1" for a, b in
               re.findall(r"specifiedwindowframe\(RangeFrame, ([^,]+), ([^)]+\)?)\)", plan)
               if "currentrow" in b)


def test_merge_prunes_partitions_of_an_unfiltered_batch(spark):
    old = spark.range(40).selectExpr("id", "CAST(id % 8 AS INT) AS p")
    table = "gold.t_prune"
    materialize(spark, old, table, "incremental", "merge", ["p", "id"], partition_by=["p"], root=scratch_path(spark, "g"))
    batch = spark.createDataFrame([(100, 2), (101, 3)], "id long, p int")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        plan = touched_rows(spark.table(table), batch, ["p"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = plan[plan.index("PartitionFilters: ["):]
    assert re.match(r"PartitionFilters: \[isnotnull\(p#\d+\), \(p#\d+ >= [Ss]ubquery .*\(p#\d+ <= [Ss]ubquery ", filters)


def test_partitioned_write_prunes_on_read(spark):
    path = scratch_path(spark, "pruned")
    spark.range(20).selectExpr("id", "id % 4 AS p").write.partitionBy("p").parquet(path)
    plan = spark.read.parquet(path).filter("p = 1")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*p#\d+ = 1", plan)
