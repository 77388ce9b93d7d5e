"""Where queries put files of their own."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster shares (spark.checkpoint.dir); where none is set, a local one if all runs in one process, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = getattr(spark.sparkContext, "_lexispark_dir", None)
        if not base:
            base = spark.sparkContext._lexispark_dir = "file://" + tempfile.mkdtemp(prefix="lexispark-")
    return f"{base.rstrip('/')}/lexispark/{name}-{uuid.uuid4().hex}"
