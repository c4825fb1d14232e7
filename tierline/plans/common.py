"""Shared pieces of the registered queries: as-of dates and driver tables.

Fixed values: as-of points of the checked queries.  Orders run 1995-01-01 ..
2001-08-01 and events cover January 2024, so "today" is pinned to the end of
each data set; ``current_date`` is never used in a checked query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tierline.sources.tables import load

ORDERS_ASOF = "2001-08-01"
EVENTS_ASOF = "2024-01-31 00:00:00"
PROCESSED_AT = "2024-02-01 00:00:00"
RULE_VERSION = "rules-v1"
RUN_ID = "run-0001"


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load(spark, sf_dir, name)
