"""Streams over the events folder, run to its end and read as a table.

Each stream has a checkpoint and a sink in the shared folder; sinks that replace
a table write a new version a batch, so a repeated batch gives the same table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.tables import insert_absent
from tidemark.sources.scratch import scratch
from tidemark.sources.sink import Table

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """The events as a stream, with an event time that watermarks can use."""
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def appended(stream: DataFrame, path: str, store: str | None = None) -> StreamingQuery:
    """Runs the stream to its end into the folder path, going on where an earlier run left off; ``store`` names the state store's class."""
    conf = stream.sparkSession.conf
    before = conf.get(_PROVIDER)
    try:
        if store:
            conf.set(_PROVIDER, store)  # a query keeps the settings of its start
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out")
    finally:
        conf.set(_PROVIDER, before)
    query.awaitTermination()
    return query


def to_end(stream: DataFrame, mode: str = "append", store: str | None = None) -> DataFrame:
    """What the stream gives until it has read all that is there."""
    spark, path = stream.sparkSession, scratch(stream.sparkSession)
    if mode == "append":
        appended(stream, path, store)
        return spark.read.schema(stream.schema).parquet(f"{path}/out")
    last: list[str] = []

    def replace(batch: DataFrame, number: int) -> None:
        version = f"{path}/out/{number}"
        batch.write.mode("overwrite").parquet(version)
        last[:] = [version]

    stream.writeStream.foreachBatch(replace).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(last[0]) if last else spark.createDataFrame([], stream.schema)


def bars(stream: DataFrame, length: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Open, high, low, close and count of each type's values in tumbling windows."""
    timed = stream.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type")
    made = timed.agg(F.min_by("value", F.struct("ts", "event_id")).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.count("*").alias("n"))
    return made.select(F.col("w.start").cast("date").alias("d"), "event_type", "open", "high", "low", "close", "n")


def first_of_each(stream: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Rows of a key once within the watermark's delay; state holds keys that long and no longer."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def inserted(stream: DataFrame, table: Table) -> StreamingQuery:
    """Inserts rows whose key the table does not have, one a key; a repeated batch changes nothing."""

    def insert(batch: DataFrame, number: int) -> None:
        table.change(f"batch-{number}", batch.select(*table.schema.names), lambda old, new, keys: old.unionByName(insert_absent(old, new, keys)))

    return _each_batch(stream, table, insert)


def replaced(stream: DataFrame, table: Table, fetched: str) -> StreamingQuery:
    """Replaces all rows of the keys that come anew; keys whose fetch failed (``fetched`` is not true for any of their rows) are left alone."""

    def replace(batch: DataFrame, number: int) -> None:
        table.change(f"batch-{number}", batch.filter(fetched).select(*table.schema.names))

    return _each_batch(stream, table, replace)


def _each_batch(stream: DataFrame, table: Table, change: Callable[[DataFrame, int], None]) -> StreamingQuery:
    query = stream.writeStream.foreachBatch(change).option("checkpointLocation", f"{table.path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def newer_than(stream: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows after the last time that is known of their key; all rows of unknown keys."""
    marks = known.groupBy(key).agg(F.max("ts").alias("_mark"))
    return stream.join(marks, key, "left").filter(F.col("_mark").isNull() | (F.col("ts") > F.col("_mark"))).drop("_mark")


_POSITION = "user_id long, opened long, closed long, holding boolean"


def positions(stream: DataFrame) -> DataFrame:
    """Per user a position that a click opens and an error closes, carried from batch to batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, closed, holding = state.get if state.exists else (0, 0, False)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for kind in rows["event_type"]:
            if kind == "click" and not holding:
                opened, holding = opened + 1, True
            elif kind == "error" and holding:
                closed, holding = closed + 1, False
        state.update((opened, closed, holding))
        yield pd.DataFrame([(key[0], opened, closed, holding)], columns=["user_id", "opened", "closed", "holding"])

    slim = stream.select("user_id", "event_id", "ts", "event_type")
    return slim.groupBy("user_id").applyInPandasWithState(step, _POSITION, "opened long, closed long, holding boolean", "update", GroupStateTimeout.NoTimeout)


def refreshed(stream: DataFrame, table: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The table's metrics recomputed for the keys that the stream touches, batch by batch."""
    spark, path, parts = stream.sparkSession, scratch(stream.sparkSession), []

    def recompute(batch: DataFrame, number: int) -> None:
        touched = batch.select(key).distinct()
        compute(table.join(touched, key, "left_semi")).write.mode("overwrite").parquet(f"{path}/{number}")
        parts.append(f"{path}/{number}")

    stream.writeStream.foreachBatch(recompute).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    schema = compute(table.limit(0)).schema
    return spark.read.schema(schema).parquet(*parts).distinct() if parts else spark.createDataFrame([], schema)
