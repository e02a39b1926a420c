"""Where intermediate tables go: the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_FOLDER = "fleetlens"


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only in local mode with nothing set."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return f"{configured.rstrip('/')}/{_FOLDER}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="fleetlens-")
    spark.sparkContext.setCheckpointDir(folder)
    return scratch_root(spark)


def new_path(spark: SparkSession, name: str) -> str:
    """A path nobody used before."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
