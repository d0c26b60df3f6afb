"""Keyed Parquet tables that are changed in place, by Spark's dynamic partition overwrite.

A table is a folder of ``bucket=<n>`` partitions, the bucket being the hash of
the key.  A change reads the buckets of its keys only, writes their next state to
a folder beside the table (stage), and then has Spark overwrite these partitions
from there.  A change has a name.  Run again under it, it goes on from a stage
that is whole, and does nothing once it has been marked as done, so a job that is
killed between any two steps, or a stream that repeats a batch, may just run it
again.  Several tables are changed by staging all before any is overwritten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import tables

#: Partitions of a table; one rewrite of a key touches one of them.
BUCKETS = 64

Change = Callable[[DataFrame, DataFrame, list[str]], DataFrame]


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class Table:
    """A table at ``path`` of one schema, with its ``keys``; its folder may not be there yet."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.schema = spark.createDataFrame([], schema).schema

    # files, by the cluster's own file system
    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _exists(self, path: str) -> bool:
        files, at = self._at(path)
        return files.exists(at)

    def read(self) -> DataFrame:
        return self._partitions().drop("bucket")

    def _partitions(self) -> DataFrame:
        empty = self.spark.createDataFrame([], self.schema).withColumn("bucket", F.lit(0))
        if not self._exists(f"{self.path}/data"):
            return empty
        return self.spark.read.schema(empty.schema).parquet(f"{self.path}/data")

    def done(self, name: str) -> bool:
        return self._exists(f"{self.path}/done/{name}")

    def stage(self, name: str, new: DataFrame, change: Change = tables.replace_keys) -> None:
        """Writes the next state of the buckets that new's keys fall into; kept if it is whole already."""
        if self.done(name) or self._exists(f"{self.path}/stage/{name}/_SUCCESS"):
            return
        fresh = new.withColumn("bucket", bucket_of(self.keys, self.buckets))
        touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most a row for each bucket
        old = self._partitions().filter(F.col("bucket").isin(touched)).drop("bucket")
        after = change(old, fresh.select(*self.schema.names), self.keys).select(*self.schema.names)
        after.withColumn("bucket", bucket_of(self.keys, self.buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/stage/{name}")

    def publish(self, name: str) -> None:
        """Overwrites the staged partitions and marks the change as done."""
        if self.done(name):
            return
        if self._staged(name):
            rows = self.spark.read.schema(self._partitions().schema).parquet(f"{self.path}/stage/{name}")
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/data")
        files, at = self._at(f"{self.path}/done/{name}")
        files.create(at, True).close()
        files, at = self._at(f"{self.path}/stage/{name}")
        files.delete(at, True)

    def _staged(self, name: str) -> list[str]:
        files, at = self._at(f"{self.path}/stage/{name}")
        return [s.getPath().getName() for s in files.listStatus(at) if s.getPath().getName().startswith("bucket=")] if files.exists(at) else []

    def change(self, name: str, new: DataFrame, change: Change = tables.replace_keys) -> None:
        change_all(name, [(self, new)], change)


def change_all(name: str, changes: list[tuple[Table, DataFrame]], change: Change = tables.replace_keys) -> None:
    """One change of several tables: all are staged before the first is overwritten; run again, it goes on where it broke off."""
    for table, new in changes:
        table.stage(name, new, change)
    for table, _ in changes:
        table.publish(name)
