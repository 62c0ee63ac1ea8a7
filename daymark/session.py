"""Session helpers: local sessions for tests and bench, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence
from functools import cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "1m"


def local_session(app_name: str = "daymark", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster use the cluster's own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("DAYMARK_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def small_batches(spark: SparkSession) -> None:
    """Let a batch of rows for Python take about a megabyte, unless the session says otherwise.

    The default (64 MB or 10,000 rows) holds a batch of long texts several times in each task: in the
    JVM, in Python, and while buffers grow.
    """
    if spark.conf.get(BATCH_CONF, None) in (None, "67108864b", "64MB"):
        spark.conf.set(BATCH_CONF, BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster in ``spark.checkpoint.dir``.

    Only a local session, where driver and executors share one disk, may fall back to a
    temporary folder; elsewhere a missing setting is an error.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    return _local_folder(spark.sparkContext.applicationId)


@cache
def _local_folder(application_id: str) -> str:
    return tempfile.mkdtemp(prefix=f"daymark-{application_id}-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; never reused, so reruns cannot collide."""
    return f"{shared_folder(spark)}/daymark/{name}-{uuid.uuid4().hex}"


def materialise(
    df: DataFrame, name: str, partition_by: str | None = None, sort_by: Sequence[str] = ()
) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage so that iterative work (one fit per fold) neither recomputes the scans nor
    depends on cached blocks of executors that may be lost.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if partition_by:
        # Rebalancing brings a year's rows together and still splits a year that is too large
        # for one task, so neither tiny files per task nor one giant task per year.
        dealt = df.hint("rebalance", partition_by)
        if sort_by:
            dealt = dealt.sortWithinPartitions(*sort_by)
        dealt.write.partitionBy(partition_by).parquet(path)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
