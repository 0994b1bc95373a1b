"""Spark session defaults for the rental jobs.

The settings that matter at cluster scale are adaptive execution (runtime
re-planning, partition coalescing, skew-join splitting of hot keys) and a UTC
session zone, so that "today" and date casts mean the same on every executor.
``spark.sql.shuffle.partitions`` is left to the deployment (size it to
about input bytes / 200 MB); adaptive execution coalesces from there.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SCALE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot vehicle or customer may own a third of all bookings: AQE splits
    # the oversized shuffle partition of the booking side into several tasks.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64MB",
    # Split hot partitions even when that costs an extra shuffle downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Ids as text shrink to a seventh in a shuffle: 16 MB there are over 100 MB of rows in a task.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB",
    # A side that is much smaller is hashed per partition, so the large one is not sorted (nor spilled by its sort).
    "spark.sql.join.preferSortMergeJoin": "false",
    # Coalesce small shuffle partitions towards the advisory size (not towards
    # maximal parallelism): on a large cluster this keeps tasks a useful size.
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.files.maxPartitionBytes": "128MB",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "rentwise", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the scale defaults applied."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(SCALE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_scale_conf(spark: SparkSession) -> None:
    """Apply the runtime SQL settings to an existing session (e.g. the driver's)."""
    for key, value in SCALE_CONF.items():
        if key.startswith("spark.sql."):
            spark.conf.set(key, value)


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    The folder comes from ``spark.checkpoint.dir`` (or an already set context
    directory). Only a local-mode session without one gets a fresh scratch
    folder; on a cluster a machine-local folder would lose data with its node.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="rentwise-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def tables_dir(spark: SparkSession) -> str:
    """Where stored tables live: ``spark.rentwise.tables.dir``, a shared folder; the checkpoint folder where it is unset."""
    return spark.conf.get("spark.rentwise.tables.dir", None) or checkpoint_dir(spark)


def staged(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet into a new folder of the shared checkpoint folder and read it back.

    Cuts the lineage in columnar form without tying the rows to an executor.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
