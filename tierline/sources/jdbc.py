"""Relational database ingestion (full copy to bronze).

``spark.read.jdbc`` split on a numeric column so many executors read disjoint
key ranges in parallel.  No driver jar for Postgres/MySQL ships with this
image and no database may be started here, so this reader is not exercised
by a registered query (see README).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

JDBC_URLS = {
    # fixed URL shapes per engine
    "postgres": "jdbc:postgresql://{host}:{port}/{database}",
    "mysql": "jdbc:mysql://{host}:{port}/{database}",
}
DEFAULT_PORTS = {"postgres": 5432, "mysql": 3306}


def jdbc_url(engine: str, host: str, database: str, port: int | None = None) -> str:
    return JDBC_URLS[engine].format(host=host, port=port or DEFAULT_PORTS[engine],
                                    database=database)


def read_jdbc(spark: SparkSession, url: str, table: str, user: str, password: str,
              partition_column: str | None = None, lower: int | None = None,
              upper: int | None = None, num_partitions: int = 64,
              fetch_size: int = 10_000) -> DataFrame:
    """Parallel JDBC read; bounds only shape the split, no rows are dropped."""
    props = {"user": user, "password": password, "fetchsize": str(fetch_size)}
    if partition_column is not None:
        return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower,
                               upperBound=upper, numPartitions=num_partitions,
                               properties=props)
    return spark.read.jdbc(url, table, properties=props)
