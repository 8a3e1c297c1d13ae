"""Where tables that executors share may lie."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder's path below spark.checkpoint.dir, which the driver and all executors see; a temporary one on a local master where that is unset."""
    context = spark.sparkContext
    given = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not given:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="siltlog-")
    return f"{given.rstrip('/')}/{what}-{uuid.uuid4().hex}"
