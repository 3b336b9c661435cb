"""The folder that driver and executors share, for what jobs write between their rounds."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def home(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, local mode gets a folder of its own; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("SPARKLOOM_TMP", "/tmp"))
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{home(spark).rstrip('/')}/sparkloom/{label}-{uuid.uuid4().hex}"
