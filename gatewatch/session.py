"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


PARTITION_BYTES = 256 << 20


def sized_for(input_bytes: int) -> dict[str, str]:
    """Shuffle settings for an input of this size: about 256 MiB per partition.

    The number is where adaptive execution starts from; it merges small neighbours down to the advisory size.
    """
    wanted = max(200, -(-input_bytes // PARTITION_BYTES))
    return {
        "spark.sql.shuffle.partitions": str(wanted),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(PARTITION_BYTES),
        "spark.sql.files.maxPartitionBytes": str(PARTITION_BYTES),
    }


def build_session(app: str = "gatewatch", master: str | None = None, input_bytes: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on. ``master`` is left to the cluster unless given; ``input_bytes`` sizes
    the shuffles.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **(sized_for(input_bytes) if input_bytes else {}),
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which all executors share. Where that is unset, a local master (as in
    tests) gets a local folder, and any other an error: its executors could not read each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Iterative fits cut their lineage by checkpoints. The cluster's folder is kept; one is set only where there is none."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_dir(spark, "checkpoints"))
