"""Session and shared-storage helpers.

Library code never creates a session; it reads configuration from the one it
is given.  ``local_session`` exists for tests, the bench and the smoke entry.
"""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8,
                  app: str = "choicekit") -> SparkSession:
    """A local session tuned for small scale factors (tests, bench)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, name: str | None = None) -> str:
    """A fresh folder under the cluster's shared checkpoint directory.

    The location comes from ``spark.checkpoint.dir`` (or a checkpoint dir
    already set on the context).  Only a local-mode session without one gets a
    folder under the system temp dir, as in tests; on a cluster a missing
    setting is an error, because executor-local folders do not survive the
    loss of an executor.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="choicekit-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    path = os.path.join(base, name or "stage", uuid.uuid4().hex) if "://" not in base \
        else f"{base.rstrip('/')}/{name or 'stage'}/{uuid.uuid4().hex}"
    return path


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint()`` usable (reliable, shared storage)."""
    shared_dir(spark, "probe")


# Recommended settings for a large cluster (about 1,000 executors, ~100 TB
# input).  The library never sets these itself; pass them to spark-submit or
# the session builder.
CLUSTER_CONF = {
    # AQE re-plans at run time: coalesces small shuffle partitions, splits
    # skewed ones, switches joins to broadcast when a side turns out small
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
    # start wide enough that no shuffle partition spills at 100 TB; AQE
    # coalesces the partitions that come out small
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.files.maxPartitionBytes": str(256 << 20),
    # broadcast only what AQE measures below this size at run time
    "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
    # shared storage for checkpoints and stages (set to the cluster's folder)
    # "spark.checkpoint.dir": "<shared folder>",
}
