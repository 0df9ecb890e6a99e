"""Where jobs without a folder of their own keep topics and checkpoints."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; only in local mode, where that is unset (tests), under one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='rillmark-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"
