"""Statistics of tables from the files that hold them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sizes(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """name, rows, files, bytes of Parquet tables, from a scan of no columns and the files' own sizes."""
    each = []
    for name, path in paths.items():
        files = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size").groupBy("file_path", "file_size").agg(F.count("*").alias("rows"))
        each.append(files.agg(F.sum("rows").alias("rows"), F.count("*").alias("files"), F.sum("file_size").alias("bytes")).select(F.lit(name).alias("name"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("rows", "files", "bytes"))))
    return reduce(DataFrame.unionByName, each)
