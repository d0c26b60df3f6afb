"""Sharding by minimax contiguous partition (operator 5).

Rows with equal texts are one atomic group, and groups are ordered by the
64-bit hash of their text.  The groups are cut into contiguous shards so that
the largest shard's bytes are as few as possible: the capacity is found by
binary search, and a greedy fill tells whether a capacity is enough.

The driver never holds all group sizes.  It starts with the sums of the 2^16
ranges of the hash and asks for the sizes inside a range, 2^16 finer ranges at
a time, only where a greedy fill has to cut; the result is the same as over all
groups.  Slots are row numbers within small cells of the order plus the rows
before the cell, so no window spans a shard, and a hot group is split by id.

Defined results: a null or empty text has size 1 and the checksum of no bytes;
null texts are a group of their own; repeated rows take a slot each; an empty
table gives no rows; groups larger than the mean shard leave shards empty.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.base import read, written

#: Levels of the order: bits of the hash below each; ranges asked for ahead of the search; rows in a cell of slots.
SHIFTS, AHEAD, CELL_ROWS = (48, 32, 16, 0), 512, 50_000


def _range(level: int) -> Column:
    """Number of a row's range at a level; the hash counts as a signed integer."""
    return F.shiftright("key", SHIFTS[level])


@dataclass
class Atoms:
    """Ordered ranges of the hash with their sizes, of which some can still be split."""

    table: DataFrame
    level: np.ndarray = field(init=False)
    number: np.ndarray = field(init=False)
    size: np.ndarray = field(init=False)
    single: np.ndarray = field(init=False)

    def __post_init__(self):
        self._set(*self._ask(0, self.table))

    def _ask(self, level: int, rows: DataFrame) -> tuple:
        found = rows.groupBy(_range(level).alias("r")).agg(F.sum("size").alias("s"), (F.min("key") == F.max("key")).alias("one")).orderBy("r").toArrow().to_pandas()
        n = len(found)
        return np.full(n, level), found["r"].to_numpy(np.int64), found["s"].to_numpy(np.int64), found["one"].to_numpy(bool)

    def _set(self, level, number, size, single):
        start = number << np.array(SHIFTS)[level]
        order = np.argsort(start, kind="stable")
        self.start, self.level, self.number, self.size, self.single = start[order], level[order], number[order], size[order], single[order]
        self.before = np.r_[0, np.cumsum(self.size)]

    def split(self, which: np.ndarray) -> None:
        """Replaces some ranges by the next finer ones."""
        parts = [[x[np.setdiff1d(np.arange(len(self.size)), which)] for x in (self.level, self.number, self.size, self.single)]]
        for level in np.unique(self.level[which]).tolist():
            numbers = [int(x) for x in self.number[which[self.level[which] == level]]]
            parts.append(self._ask(level + 1, self.table.filter(_range(level).isin(numbers))))
        self._set(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    def fill(self, capacity: int, shards: int) -> tuple[list[int], bool, list[int]]:
        """Where greedy shards of a capacity end, whether all fits, and the ranges to split to be sure of it."""
        at, cuts, unsure = 0, [], []
        for _ in range(shards):
            to = int(np.searchsorted(self.before, self.before[at] + capacity, side="right")) - 1
            cuts.append(to)
            if to < len(self.size) and not self.single[to]:
                unsure.append(to)
            at = to
        return cuts, at == len(self.size), unsure


def minimax_cuts(table: DataFrame, shards: int) -> tuple[list[int], int]:
    """Smallest hash of each further shard, and the capacity, for table(key, size)."""
    atoms = Atoms(table)
    if not len(atoms.size):
        return [], 0
    low, high = -(-int(atoms.size.sum()) // shards), int(atoms.size.sum())
    for _ in range(2):  # a narrow bracket first, then the ranges that its fills may cut
        a, b = low, high
        while a < b:
            middle = (a + b) // 2
            a, b = (a, middle) if atoms.fill(middle, shards)[1] else (middle + 1, b)
        high = min(high, b)
        first, last = atoms.fill(low, shards)[0], atoms.fill(high, shards)[0]
        near = np.unique(np.concatenate([np.arange(x, min(y + 1, x + AHEAD, len(atoms.size))) for x, y in zip(first, last, strict=True)] + [np.zeros(0, int)])).astype(int)
        near = near[~atoms.single[near]][:AHEAD]
        if len(near):
            atoms.split(near)
    while low < high:
        middle = (low + high) // 2
        _, fits, unsure = atoms.fill(middle, shards)
        if fits:
            high = middle
        elif unsure:
            atoms.split(np.array(unsure))
        else:
            low = middle + 1
    while True:
        cuts, _, unsure = atoms.fill(high, shards)
        if not unsure:
            return [int(atoms.start[c]) for c in cuts[:-1] if c < len(atoms.size)], high
        atoms.split(np.array(unsure))


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """docs(doc_id, text) to doc_id, size, text_crc32, shard and slot, by the law of near equal bytes."""
    text = F.coalesce("text", F.lit(""))
    table = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")))
    cuts, _ = minimax_cuts(table, shards)
    placed = table.withColumn("shard", sum((F.when(F.col("key") >= c, 1).otherwise(0) for c in cuts), F.lit(0)))
    hot = placed.groupBy(_range(0).alias("range")).agg(F.count("*").alias("n")).filter(F.col("n") > CELL_ROWS)  # 2^16 rows at most
    hot = hot.select("range", F.ceil(F.col("n") / CELL_ROWS).alias("parts"))
    rows = placed.withColumn("range", _range(0)).join(F.broadcast(hot), "range", "left")
    rows = rows.withColumn("cell", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("parts"))))
    cell = ("shard", "range", "cell")
    counts = rows.groupBy(*cell).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("range", "cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*cell, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = rows.withColumn("place", F.row_number().over(Window.partitionBy(*cell).orderBy("key", "doc_id", "size", "text_crc32")) - 1)
    return numbered.join(offsets, list(cell)).select("doc_id", "size", "text_crc32", "shard", (F.col("place") + F.col("before")).alias("slot"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op5_sharding": op5_sharding}
ORACLES: dict[str, str] = {}
