"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Only a local session may do without; it takes a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = base or _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-granary-"))
    return f"{base}/{name}-{uuid.uuid4().hex}"
