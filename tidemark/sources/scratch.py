"""A new path for tables that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """In the shared folder of spark.checkpoint.dir, or a local one where that is unset, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='spark-tidemark-')}"
    return f"{root.rstrip('/')}/tidemark/{uuid.uuid4().hex}"
