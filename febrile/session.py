"""SparkSession helpers.

The library never creates a session inside an operator; jobs and tests call
``get_spark`` once.  Defaults target a cluster (AQE on, skew join on); tests
override ``spark.sql.shuffle.partitions``.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_spark(app_name: str = "febrile", master: str | None = None,
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def cluster_profile(total_cores: int) -> dict[str, str]:
    """Settings for a large cluster (tens of TB per job).

    Shuffles start wide (several partitions per core) and AQE coalesces
    them to ~256 MB; skewed partitions above 5x the median are split.
    """
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(max(200, 4 * total_cores)),
        "spark.sql.shuffle.partitions": str(max(200, 2 * total_cores)),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 << 20),
    }


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` must point at shared storage: without
    it, files would land on the machine that happens to run.  Only a local
    master (tests) gets a scratch folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not configured and not is_local(sc.master):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share (master {sc.master})")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="febrile-ckpt-"))
    return sc.getCheckpointDir()


def is_local(master: str) -> bool:
    """One JVM: driver and executors share their folders ("local-cluster" does not count)."""
    return re.fullmatch(r"local(\[.*\])?", master) is not None


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for written intermediate tables, under the shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/tables/{name}-{uuid.uuid4().hex}"
