"""The folder that driver and executors share, for tables and files that are written once and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only in local mode, where all tasks share the machine, a folder of our own stands in for it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(spark, "_sieve_shared", None) or "file://" + tempfile.mkdtemp(prefix="sieve-shared-")
        spark._sieve_shared = found
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/sieve-{name}-{uuid.uuid4().hex}"
