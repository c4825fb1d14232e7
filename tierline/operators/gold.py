"""Silver -> gold building blocks: keyed pre-aggregation, shares, profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierline.functions import days_between, lit_date, round_double, safe_ratio


def share_of_total(df: DataFrame, group_cols: Sequence[str | Column],
                   count_name: str = "count", pct_name: str = "percentage",
                   digits: int = 6) -> DataFrame:
    """GROUP BY + COUNT(*) and COUNT(*) * 100 / SUM(COUNT(*)) OVER ().

    The grand total is a scalar subquery (one-row aggregate evaluated as its
    own job) instead of an empty-partition window, so the groups are never
    gathered into a single task however many there are."""
    counted = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias(count_name))
    total = counted.agg(F.sum(count_name)).scalar()
    return counted.withColumn(pct_name, round_double(F.col(count_name) * 100.0 / total, digits))


def customer_metrics(customers: DataFrame, transactions: DataFrame, tickets: DataFrame,
                     as_of: str, churn_days: int = 60) -> DataFrame:
    """Customer behaviour features and the churn label at ``as_of``.

    Transactions and tickets are aggregated per customer *before* the joins
    (map-side partial aggregation), so each join is 1:1 on customer_id and a
    customer with a third of all transactions costs one pre-aggregated row
    per task, not a skewed join partition."""
    d = lit_date(as_of)
    tx = (transactions.groupBy("customer_id")
          .agg(F.count("transaction_id").alias("total_purchases"),
               F.sum("amount").alias("_sum"),
               F.count("amount").alias("_n"),
               F.max("transaction_date").alias("last_purchase_date"),
               F.min("transaction_date").alias("first_purchase_date")))
    sup = (tickets.groupBy("customer_id")
           .agg(F.count(F.lit(1)).alias("support_tickets"),
                F.avg(F.coalesce(F.col("resolution_time_hours"), F.lit(0.0)))
                 .alias("avg_resolution_time")))
    co = customers.select("customer_id", "email", "registration_date", "country", "status") \
        .join(tx, "customer_id", "left")
    total = F.coalesce(F.col("total_purchases"), F.lit(0)).cast("bigint")
    since_last = days_between("last_purchase_date", d)
    since_first = days_between("first_purchase_date", d)
    return (co.join(sup, "customer_id", "left")
              .select("customer_id", "email",
                      total.alias("total_purchases"),
                      F.coalesce(F.col("_sum"), F.lit(0)).cast("double").alias("customer_lifetime_value"),
                      F.coalesce(round_double(safe_ratio(F.col("_sum"), F.col("_n"))), F.lit(0.0))
                       .alias("avg_purchase_value"),
                      since_last.alias("days_since_last_purchase"),
                      days_between("registration_date", d).alias("account_age_days"),
                      F.when(total == 0, F.lit(0.0))
                       .otherwise(round_double(safe_ratio(total, since_first.cast("double") / 30.0)))
                       .alias("purchase_frequency"),
                      F.coalesce(F.col("support_tickets"), F.lit(0)).cast("bigint").alias("support_tickets"),
                      F.coalesce(round_double(F.col("avg_resolution_time")), F.lit(0.0))
                       .alias("avg_support_resolution_hours"),
                      "country", "status",
                      F.when(since_last > churn_days, 1).otherwise(0).alias("churned"),
                      F.lit(as_of).cast("timestamp_ntz").alias("updated_at")))


def operator_profile(work_orders: DataFrame, as_of: str, min_orders: int = 5) -> DataFrame:
    """Per-operator performance profile from VALID work orders.

    Conditional counts, total units, duration stats, units per hour,
    completion rate, distinct products, data quality score and the
    high-performer label; operators with fewer than ``min_orders`` valid
    orders are dropped (HAVING)."""
    valid = F.col("quality_flag") == "VALID"
    hrs = F.sum(F.when(valid, F.col("duration_hours")))
    agg = (work_orders.groupBy("operator_id").agg(
        F.count_if(valid).alias("total_work_orders"),
        F.count_if(valid & (F.col("status") == "completed")).alias("completed_orders"),
        F.count_if(valid & (F.col("status") != "completed")).alias("open_orders"),
        F.sum(F.when(valid, F.col("quantity"))).alias("total_units"),
        F.avg(F.when(valid, F.col("duration_hours"))).alias("avg_duration_hours"),
        F.min(F.when(valid, F.col("duration_hours"))).alias("min_duration_hours"),
        F.max(F.when(valid, F.col("duration_hours"))).alias("max_duration_hours"),
        F.stddev_samp(F.when(valid, F.col("duration_hours"))).alias("stddev_duration_hours"),
        hrs.alias("_hours"),
        F.count_distinct(F.when(valid, F.col("product_id"))).alias("distinct_products"),
        F.count(F.lit(1)).alias("_all")))
    uph = safe_ratio(F.col("total_units"), F.col("_hours"))
    rate = safe_ratio(F.col("completed_orders"), F.col("total_work_orders"))
    return (agg.filter(F.col("total_work_orders") >= min_orders)
               .select("operator_id", "total_work_orders", "completed_orders", "open_orders",
                       round_double("total_units", 4).alias("total_units"),
                       round_double("avg_duration_hours", 4).alias("avg_duration_hours"),
                       round_double("min_duration_hours", 4).alias("min_duration_hours"),
                       round_double("max_duration_hours", 4).alias("max_duration_hours"),
                       round_double("stddev_duration_hours", 4).alias("stddev_duration_hours"),
                       round_double(uph, 6).alias("units_per_hour"),
                       round_double(rate, 6).alias("completion_rate"),
                       "distinct_products",
                       round_double(safe_ratio(F.col("total_work_orders"), F.col("_all")), 6)
                        .alias("quality_score"),
                       F.when((uph > 75) & (rate > 0.9), 1).otherwise(0).alias("is_high_performer"),
                       F.lit(as_of).cast("timestamp_ntz").alias("feature_timestamp")))


def price_elasticity(sales: DataFrame, group: str, price: str, quantity: str,
                     categories: DataFrame, category: str) -> DataFrame:
    """Price elasticity per group, shrunk to its category.

    The elasticity of a group is the slope of ln(quantity) on ln(price) over its sales of
    positive price and quantity, with the variance v of that estimate.  Groups of a
    category scatter around the precision-weighted mean by more than v alone explains;
    that excess (the method of moments, 0 at least) is the category's variance t, and a
    group's elasticity becomes mean + t / (t + v) * (slope - mean): a group with few or
    noisy sales moves to its category, a well-measured one keeps its own slope.

    Sales are reduced to five sums per group with map-side combine before anything is
    joined; ``categories`` maps ``group`` to ``category``, one row each.  Groups of fewer
    than three sales, of one price only, or without residual variance have no estimate of
    their own: ``slope`` as far as it exists, and the category's mean as ``elasticity``
    (NULL where the category has none).  Columns: group, category, n_sales, slope,
    category_mean, weight, elasticity."""
    x = F.when((F.col(price) > 0) & (F.col(quantity) > 0), F.ln(F.col(price)))
    y = F.when((F.col(price) > 0) & (F.col(quantity) > 0), F.ln(F.col(quantity)))
    fits = sales.select(F.col(group), x.alias("_x"), y.alias("_y")).groupBy(group).agg(
        F.regr_count("_y", "_x").alias("n_sales"), F.regr_slope("_y", "_x").alias("slope"),
        F.regr_sxx("_y", "_x").alias("_sxx"), F.regr_syy("_y", "_x").alias("_syy"))
    rest = F.col("_syy") - F.col("slope") * F.col("slope") * F.col("_sxx")
    variance = F.when((F.col("n_sales") > 2) & (F.col("_sxx") > 1e-12) & (rest > 1e-12),
                      rest / (F.col("n_sales") - 2) / F.col("_sxx"))
    fits = fits.join(categories.select(group, category), group).withColumn("_v", variance)
    told = fits.filter("_v IS NOT NULL").withColumn("_w", 1 / F.col("_v"))
    means = told.groupBy(F.col(category).alias("_c")).agg(
        (F.sum(F.col("_w") * F.col("slope")) / F.sum("_w")).alias("category_mean"), F.count("*").alias("_k"),
        F.sum("_w").alias("_sw"), F.sum(F.col("_w") * F.col("_w")).alias("_sw2"))
    spread = told.join(means, told[category].eqNullSafe(means["_c"])).groupBy("_c", "category_mean", "_k", "_sw", "_sw2").agg(
        F.sum(F.col("_w") * F.pow(F.col("slope") - F.col("category_mean"), 2)).alias("_q"))
    excess = (F.col("_q") - (F.col("_k") - 1)) / F.nullif(F.col("_sw") - F.col("_sw2") / F.col("_sw"), F.lit(0.0))
    spread = spread.select("_c", "category_mean", F.when(F.col("_k") > 1, F.greatest(excess, F.lit(0.0))).otherwise(0.0).alias("_t"))
    weight = F.coalesce(F.col("_t") / (F.col("_t") + F.col("_v")), F.lit(0.0))
    return fits.join(spread, fits[category].eqNullSafe(spread["_c"]), "left").withColumn("weight", weight) \
        .withColumn("elasticity", F.when(F.col("weight") > 0, F.col("category_mean") + F.col("weight")
                                         * (F.col("slope") - F.col("category_mean"))).otherwise(F.col("category_mean"))) \
        .select(group, category, "n_sales", "slope", "category_mean", "weight", "elasticity")
