"""Positions with stops on a stream of prices and signals, carried in keyed state.

A row (k, ts, id, price, entry, leave) waits in state until the watermark has
passed it, and a timer then takes what has been passed in order of time.  So
trades do not depend on how the rows were cut into batches, or on their order
within the watermark's delay.  State is kept by buckets of keys, as each call for
a state key costs more than many rows: a bucket holds its waiting rows as Arrow
streams and the positions its keys are in, no more.  A key that is out of the
market holds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

TRADES = "k string, opened long, closed long, entry_price double, exit_price double, high double, why string"
_WAITING = pa.schema([("k", pa.string()), ("at", pa.int64()), ("id", pa.int64()), ("price", pa.float64()), ("entry", pa.bool_()), ("leave", pa.bool_())])
_POSITION = pa.schema([("k", pa.string()), ("opened", pa.int64()), ("price", pa.float64()), ("high", pa.float64())])
#: Buckets of keys; fixed, as state outlives a run.
BUCKETS = 1024
#: State of this kind is kept by this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _packed(table: pa.Table) -> tuple[bytes]:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_table(table)
    return (out.getvalue().to_pybytes(),)


def _unpacked(value: tuple) -> pa.Table:
    return pa.ipc.open_stream(bytes(value[0])).read_all()


class StopWalk(StatefulProcessor):
    """Opens on an entry while flat; closes on an exit, or once the price is ``stop`` below the entry's or, trailing, the highest since."""

    def __init__(self, stop: float, trailing: bool):
        self._stop, self._trailing = stop, trailing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", "rows binary")
        self._positions = handle.getValueState("positions", "rows binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        fresh = [pa.Table.from_pandas(frame[_WAITING.names], _WAITING, preserve_index=False) for frame in rows if len(frame)]
        if fresh:
            table = pa.concat_tables(fresh)
            self._waiting.appendValue(_packed(table))
            self._handle.registerTimer(pc.min(table["at"]).as_py() // 1000)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = 1000 * timerValues.getCurrentWatermarkInMs()
        held = [_unpacked(x) for x in self._waiting.get()]
        rows = pa.concat_tables(held) if held else _WAITING.empty_table()
        ripe, rest = rows.filter(pc.field("at") < passed), rows.filter(pc.field("at") >= passed)
        trades = list(self._walk(ripe.sort_by([(c, "ascending") for c in _WAITING.names])))
        if len(rest):
            self._waiting.put([_packed(rest)])
            self._handle.registerTimer(pc.min(rest["at"]).as_py() // 1000)
        else:
            self._waiting.clear()
        if trades:
            yield pd.DataFrame(trades, columns=[c.split()[0] for c in TRADES.split(", ")])

    def _walk(self, ripe: pa.Table) -> Iterator[tuple]:
        """The trades of rows in order of key and time; positions that stay open go to the state."""
        if not len(ripe):
            return
        before = _unpacked(self._positions.get()) if self._positions.exists() else _POSITION.empty_table()
        positions = {k: x for k, *x in zip(*(c.to_pylist() for c in before.columns), strict=True)}
        for key, id, price, entry, leave in zip(*(ripe[c].to_pylist() for c in ("k", "id", "price", "entry", "leave")), strict=True):
            held = positions.get(key)
            if held is None:
                if entry:
                    positions[key] = (id, price, price)
                continue
            opened, paid, high = held
            high = max(high, price) if self._trailing else high
            stopped = self._stop > 0 and price <= high * (1 - self._stop)
            if leave or stopped:
                del positions[key]
                yield key, opened, id, paid, price, high, "signal" if leave else "stop"
            else:
                positions[key] = (opened, paid, high)
        if positions:
            columns = zip(*((k, *x) for k, x in positions.items()), strict=True)
            self._positions.update(_packed(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _POSITION.types, strict=True)], schema=_POSITION)))
        else:
            self._positions.clear()

    def close(self) -> None:
        pass


def stop_trades(stream: DataFrame, late: str, stop: float, trailing: bool = True) -> DataFrame:
    """The closed trades of stream(k, ts, id, price, entry, leave), of rows that the watermark has passed; rows without a price are left out."""
    rows = stream.filter("price is not null").withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    flags = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("entry", "leave")})
    keyed = flags.select(F.col("k").cast("string").alias("k"), "ts", "at", "id", "price", "entry", "leave")
    bucketed = keyed.withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(BUCKETS)).cast("int"))
    return bucketed.groupBy("bucket").transformWithStateInPandas(StopWalk(stop, trailing), TRADES, "Append", "EventTime")
