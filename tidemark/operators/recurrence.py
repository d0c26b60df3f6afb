"""Linear recurrences y = a y_before + b over keyed series, as scans over blocks of time.

Maps ``y -> a y + b`` compose to maps of the same kind, so a series is cut into
blocks of calendar time: each block composes its own rows, blocks are chained by
their composed maps, and each row takes what its block starts from.  The rows of
one key so lie in as many tasks as it has blocks; only a row for each block
meets the others of its key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import scratch


def _written(rows: DataFrame) -> DataFrame:
    path = scratch(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _applied(name: str) -> Callable[[Column, Column], Column]:
    return lambda y, maps: maps[name]["p"] * y + maps[name]["q"]


def linear(rows: DataFrame, maps: dict[str, tuple[Column | float, Column]], key: str = "k", day: str = "d", span: str = "quarter") -> DataFrame:
    """rows with a column for each of ``maps``, name to (a, b): y = a y_before + b, where y before a key's first row is 0.

    A key and day has one row; a is above 0, b is not NULL.  A block is a
    ``span`` of the calendar; a few hundred rows in it lose no precision unless a
    is mostly below 0.1.
    """
    both = {f"_a_{n}": a if isinstance(a, Column) else F.lit(float(a)) for n, (a, _) in maps.items()} | {f"_b_{n}": b.cast("double") for n, (_, b) in maps.items()}
    block = Window.partitionBy(key, "_span").orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    # the maps up to a row: its factor is the product, its offset a running sum on the scale of the block's beginning
    flat = rows.withColumns({"_span": F.trunc(day, span), **both}).withColumns({f"_p_{n}": F.product(f"_a_{n}").over(block) for n in maps})
    flat = flat.withColumns({f"_q_{n}": F.col(f"_p_{n}") * F.sum(F.col(f"_b_{n}") / F.col(f"_p_{n}")).over(block) for n in maps})
    flat = _written(flat)  # read twice: for the blocks' maps and for the rows
    ends = flat.groupBy(key, "_span").agg(F.max_by(F.struct(*(F.struct(F.col(f"_p_{n}").alias("p"), F.col(f"_q_{n}").alias("q")).alias(n) for n in maps)), day).alias("_map"))
    earlier = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block of the calendar
    chained = ends.withColumn("_maps", F.collect_list("_map").over(earlier))
    chained = chained.withColumns({f"_y_{n}": F.aggregate("_maps", F.lit(0.0), _applied(n)) for n in maps})
    from_before = chained.select(key, "_span", *(f"_y_{n}" for n in maps))
    out = flat.join(from_before, [key, "_span"])
    return out.select(*rows.columns, *((F.col(f"_p_{n}") * F.col(f"_y_{n}") + F.col(f"_q_{n}")).alias(n) for n in maps))


def exponential_means(rows: DataFrame, value: str, shares: dict[str, float], key: str = "k", day: str = "d", span: str = "quarter") -> DataFrame:
    """rows with exponential means of value, name to the share of a new value; a key's first mean is its first value."""
    first = rows.groupBy(key).agg(F.min(day).alias("_begin"))
    held = rows.join(first, key)
    starts = F.col(day) == F.col("_begin")
    maps = {name: (1 - share, F.when(starts, F.col(value)).otherwise(share * F.col(value))) for name, share in shares.items()}
    return linear(held, maps, key, day, span).drop("_begin")
