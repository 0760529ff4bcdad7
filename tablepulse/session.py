"""Session set-up and the shared folder that jobs may write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app_name: str = "tablepulse", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC time and skew handling switched on."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def size_shuffles(spark: SparkSession, input_bytes: int, partition_bytes: int = 256 << 20) -> int:
    """Set the number of shuffle partitions so that an input of this size fits into memory.

    Adaptive execution merges partitions that turn out small, so the number only has
    to be large enough.
    """
    wanted = max(spark.sparkContext.defaultParallelism, -(-input_bytes // partition_bytes))
    spark.conf.set("spark.sql.shuffle.partitions", wanted)
    return wanted


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir`` that all executors can reach.

    On a cluster the setting must be there: a machine-local folder would be lost
    with its machine.  Only a local master falls back to a temporary folder.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="tablepulse-")
    return f"{root.rstrip('/')}/tablepulse-{uuid.uuid4().hex}"
