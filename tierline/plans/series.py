"""Forecast queries: monthly units per store (supplier) and product type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierline.functions import round_double
from tierline.operators.forecast import GRID, seasonal_forecast
from tierline.plans.common import t


def monthly_units(spark: SparkSession, sf: str) -> DataFrame:
    """Units per (store, product type, month); lines are summed per part before the join."""
    li = t(spark, sf, "lineitem").filter(F.col("l_shipdate").isNotNull())
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    parts = li.groupBy("l_suppkey", "l_partkey", month.alias("month")).agg(F.sum("l_quantity").alias("units"))
    kinds = t(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("product_type"))
    return parts.join(kinds, "l_partkey").groupBy(F.col("l_suppkey").alias("store_id"), "product_type", "month") \
        .agg(F.sum("units").alias("units"))


def store_sku_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """Three months ahead per store and product type, with the errors of the last year."""
    out = seasonal_forecast(monthly_units(spark, sf), ["store_id", "product_type"], "month", "units")
    return out.select("store_id", "product_type", "n_periods", "horizon", F.col("period").alias("month"),
                      round_double("forecast", 6).alias("forecast"), "alpha", "beta", "gamma",
                      round_double("mae", 6).alias("mae"), round_double("naive_mae", 6).alias("naive_mae"))


_GRID_SQL = ", ".join(f"({k}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), CAST({g} AS DOUBLE))"
                      for k, (a, b, g) in enumerate(GRID))

STORE_SKU_FORECAST_SQL = f"""
WITH RECURSIVE u AS (
  SELECT l_suppkey AS store_id, p_type AS product_type,
         CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INTEGER) AS month, SUM(l_quantity) AS units
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate IS NOT NULL GROUP BY 1, 2, 3),
span AS (SELECT store_id, product_type, MIN(month) AS first, (SELECT MAX(month) FROM u) AS last FROM u GROUP BY 1, 2),
cells AS (SELECT store_id, product_type, first, unnest(generate_series(first, last)) AS month FROM span),
y AS (SELECT c.store_id, c.product_type, c.first, COUNT(*) AS n,
             list(COALESCE(u.units, 0.0) ORDER BY c.month) AS y
      FROM cells c LEFT JOIN u ON u.store_id = c.store_id AND u.product_type IS NOT DISTINCT FROM c.product_type
                              AND u.month = c.month GROUP BY 1, 2, 3),
w(k, a, b, g) AS (VALUES {_GRID_SQL}),
line AS (SELECT *, list_sum(y[1:12]) / 12 AS mean, (list_sum(y[13:24]) / 12 - list_sum(y[1:12]) / 12) / 12 AS slope
         FROM y WHERE n >= 36),
f AS (
  SELECT store_id, product_type, first, n, y, k, a, b, g, 12 AS i, mean + slope * 5.5::DOUBLE AS level, slope AS trend,
         list_transform(y[1:12], lambda v, j: v - (mean + slope * (j - 1 - 5.5::DOUBLE))) AS season,
         0.0::DOUBLE AS sse, 0.0::DOUBLE AS sae, 0.0::DOUBLE AS snaive
  FROM line, w
  UNION ALL
  SELECT store_id, product_type, first, n, y, k, a, b, g, i + 1, fresh, b * (fresh - level) + (1.0 - b) * trend,
         list_transform(season, lambda x, j: CASE WHEN j = i % 12 + 1 THEN g * (v - fresh) + (1.0 - g) * x ELSE x END),
         sse + CASE WHEN i >= n - 12 THEN 0.0 ELSE error * error END,
         sae + CASE WHEN i >= n - 12 THEN abs(error) ELSE 0.0 END,
         snaive + CASE WHEN i >= n - 12 THEN abs(v - y[i - 11]) ELSE 0.0 END
  FROM (SELECT *, a * (v - old) + (1.0 - a) * (level + trend) AS fresh, v - (level + trend + old) AS error
        FROM (SELECT *, y[i + 1] AS v, season[i % 12 + 1] AS old FROM f WHERE i < n))),
best AS (SELECT * FROM f WHERE i = n
         QUALIFY row_number() OVER (PARTITION BY store_id, product_type ORDER BY sse, k) = 1)
SELECT y.store_id, y.product_type, CAST(y.n AS INTEGER) AS n_periods, CAST(h AS INTEGER) AS horizon,
       CAST(y.first + y.n - 1 + h AS INTEGER) AS month,
       ROUND(level + h * trend + season[(y.n + h - 1) % 12 + 1], 6) AS forecast,
       a AS alpha, b AS beta, g AS gamma, ROUND(sae / 12, 6) AS mae, ROUND(snaive / 12, 6) AS naive_mae
FROM y LEFT JOIN best ON best.store_id = y.store_id AND best.product_type IS NOT DISTINCT FROM y.product_type,
     range(1, 4) r(h)
"""

QUERIES = {"store_sku_forecast": store_sku_forecast}
ORACLES = {"store_sku_forecast": STORE_SKU_FORECAST_SQL}
