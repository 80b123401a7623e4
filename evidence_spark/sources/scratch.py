"""Folders for tables between steps."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share, below spark.checkpoint.dir; a session of one local process may do without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="evidence-spark-"))
    return f"{base.rstrip('/')}/evidence_spark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
