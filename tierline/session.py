"""Session construction and shared scratch locations.

Intermediate tables written by the library (materializations, merge outputs,
stream checkpoints) live below the cluster's shared ``spark.checkpoint.dir``.
Only when that setting is absent *and* the master is local (tests, bench) do
we pick a fresh directory under /tmp and register it as the checkpoint dir.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Session defaults.  Shuffle partitions are sized per run: ~cores locally,
# and on a cluster it should be data_bytes / ~128 MiB (AQE coalesces down).
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.sql.parquet.compression.codec": "snappy",
}


def build_session(master: str | None = None, app: str = "tierline",
                  shuffle_partitions: int | None = None,
                  driver_memory: str = "16g",
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or return) a SparkSession with the library's defaults."""
    master = master or os.environ.get("TIERLINE_MASTER", "local[8]")
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(_DEFAULTS)
    conf["spark.driver.memory"] = driver_memory
    if shuffle_partitions is None:
        shuffle_partitions = 8 if master.startswith("local") else 2000
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master.startswith("local") and "spark.checkpoint.dir" not in (extra or {}):
        conf["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="tierline-ckpt-")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ckpt = spark.conf.get("spark.checkpoint.dir", None)
    if ckpt and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(ckpt)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session.  Sets a private one only
    when it is unset and the session is local; a cluster must name a shared
    folder, machine-local temp dirs are never used there.
    """
    sc = spark.sparkContext
    root = sc.getCheckpointDir()
    if root:
        return root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="tierline-ckpt-")
    sc.setCheckpointDir(root)
    return sc.getCheckpointDir() or root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint root."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
