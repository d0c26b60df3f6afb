"""Operators on keyed time series: rows (k, d, value), one a key and day.

All windows of a series share ``partitionBy(k).orderBy(d)``, so a chain of
these operators shuffles once.  Missing values are NULL, never NaN.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

YEAR = 252


def ordered(key: str = "k", day: str = "d") -> WindowSpec:
    return Window.partitionBy(key).orderBy(day)


def last_rows(n: int, key: str = "k", day: str = "d") -> WindowSpec:
    return ordered(key, day).rowsBetween(1 - n, 0)


def growth(value: str, n: int = 1, key: str = "k", day: str = "d") -> Column:
    """value / value n rows before, less 1; NULL where either is missing or the earlier one is 0."""
    return F.try_divide(F.col(value), F.lag(value, n).over(ordered(key, day))) - 1


def annual_growth(value: str, n: int, key: str = "k", day: str = "d") -> Column:
    """Growth over n rows to the power of a year; NULL unless both ends are above 0."""
    before = F.lag(value, n).over(ordered(key, day))
    return F.when((before > 0) & (F.col(value) > 0), F.pow(F.col(value) / before, YEAR / n) - 1)


def full_window(value: Column, n: int, counted: str, key: str = "k", day: str = "d") -> Column:
    """A window's value once n rows of ``counted`` are there, else NULL."""
    return F.when(F.count(counted).over(last_rows(n, key, day)) == n, value)


def densify(series: DataFrame, key: str = "k", day: str = "d") -> DataFrame:
    """Every key on every day that any key has; missing values are NULL."""
    spine = series.select(day).distinct().crossJoin(series.select(key).distinct())  # days by keys is the result's size; Spark broadcasts a side by its size only
    return spine.join(series, [key, day], "left")


def weekly(series: DataFrame, value: str = "nav", key: str = "k", day: str = "d") -> DataFrame:
    """The last value of each week on its own day."""
    return series.groupBy(key, F.trunc(day, "week").alias("_week")).agg(F.max(day).alias(day), F.max_by(value, day).alias(value)).select(key, day, value)


def densities(rows: DataFrame, value: str, low: float, high: float, points: int, key: str = "k", least: int = 50) -> DataFrame:
    """k, i, density: each key's Gaussian density with Silverman's bandwidth on an even grid; keys of few or equal values have none.
    """
    held = rows.filter(F.col(value).isNotNull()).select(key, F.col(value).alias("_x"))
    n = F.count("*")
    shape = held.groupBy(key).agg(n.alias("_n"), (1.06 * F.stddev_pop("_x") * F.pow(n, F.lit(-0.2))).alias("_h")).filter((F.col("_n") >= least) & (F.col("_h") > 0))
    at = F.lit(low) + F.lit(high - low) * F.col("i") / (points - 1)
    grid = held.join(shape, key).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    kernel = F.exp(-0.5 * F.pow((at - F.col("_x")) / F.col("_h"), 2))
    return grid.groupBy(key, "i").agg((F.sum(kernel) / F.first(F.col("_n") * F.col("_h")) / F.sqrt(2 * F.pi())).alias("density"))


def forward_filled(value: str, key: str = "k", day: str = "d") -> Column:
    return F.last(value, ignorenulls=True).over(ordered(key, day).rowsBetween(Window.unboundedPreceding, 0))


def drawdown(value: str, key: str = "k", day: str = "d") -> Column:
    """Value against its highest so far, less 1."""
    return F.col(value) / F.max(value).over(ordered(key, day).rowsBetween(Window.unboundedPreceding, 0)) - 1


def running_total(rows: DataFrame, value: str, day: str = "d", span: str = "month") -> DataFrame:
    """rows(day, value, ...), one a day, with value summed up to the day.

    Two levels: each span's days in a task of their own, and the spans' sums,
    one row each, give what came before.  Both come from one exchange.
    """
    held = rows.withColumn("_span", F.trunc(day, span))
    within = F.sum(value).over(Window.partitionBy("_span").orderBy(day).rowsBetween(Window.unboundedPreceding, 0))
    sums = held.groupBy("_span").agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))  # one row a span
    offsets = sums.select("_span", before.alias("_before"))
    return held.withColumn(value, within).join(offsets, "_span").withColumn(value, F.col("_before") + F.col(value)).select(*rows.columns)


def asof(left: DataFrame, right: DataFrame, value: str, how: str, key: str = "k", day: str = "d") -> DataFrame:
    """left with ``value`` and ``matched``, the day of right's row that is nearest as ``how`` says.

    backward: at or before; forward: at or after; nearest: of both the closer,
    on a tie the earlier.  Rows are put in one order, right's before left's on
    the same day, and filled by running windows, so a join is one shuffle.  What
    lies ahead is filled in the opposite order: a window over all following rows
    would start anew at each row.  Right has one row a key and day.
    """
    columns = left.columns
    tagged = left.withColumn("_side", F.lit(1)).withColumn("_hit", F.lit(None).cast(f"struct<at:date,v:{right.schema[value].dataType.simpleString()}>"))
    other = right.select(*(F.col(c) if c in (key, day) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in columns), F.lit(0).alias("_side"), F.struct(F.col(day).alias("at"), F.col(value).alias("v")).alias("_hit"))
    rows = tagged.unionByName(other)
    line = Window.partitionBy(key).orderBy(day, "_side")
    rows = rows.withColumn("_b", F.last("_hit", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    if how != "backward":
        back = Window.partitionBy(key).orderBy(F.desc(day), F.desc("_side"))
        ahead = F.last("_hit", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("_f", F.when(F.col("_b")["at"] == F.col(day), F.col("_b")).otherwise(ahead))
    rows = rows.filter("_side = 1")
    gap = lambda c: F.abs(F.datediff(F.col(day), F.col(c)["at"]))
    nearest = lambda: F.when(F.col("_f").isNull() | (gap("_b") <= gap("_f")), F.col("_b")).otherwise(F.col("_f"))
    pick = F.col("_b") if how == "backward" else F.col("_f") if how == "forward" else nearest()
    return rows.withColumn("_hit", pick).select(*columns, F.col("_hit")["at"].alias("matched"), F.col("_hit")["v"].alias(value))


def correlation(x: str, y: str, window: WindowSpec | None = None) -> Column:
    """Correlation over the rows that have both; NULL where either does not vary, which corr() takes for an error."""
    a, b = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    parts = [F.covar_samp(x, y), F.stddev_samp(a), F.stddev_samp(b)]
    joint, first, second = parts if window is None else (p.over(window) for p in parts)
    return F.try_divide(joint, first * second)


#: Keys in a block of the correlation matrix.
BLOCK = 512
_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _block_sums(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Sums over the common days of every two keys of two blocks, from products of their day-by-key matrices with gaps as 0."""
    low, high, _ = key
    days, day = np.unique(rows["day"].to_numpy(), return_inverse=True)
    block = rows["block"].to_numpy()
    sides = []
    for own in (block == low, block == high):
        names, at = np.unique(rows["key"].to_numpy(object)[own].astype(str), return_inverse=True)
        x, known = np.zeros((len(days), len(names))), np.zeros((len(days), len(names)))
        x[day[own], at], known[day[own], at] = rows["x"].to_numpy()[own], 1.0
        sides.append((names, x, known))
    (a, x, in_x), (b, y, in_y) = sides
    found = dict(zip(_SUMS, (in_x.T @ in_y, x.T @ in_y, in_x.T @ y, (x * x).T @ in_y, in_x.T @ (y * y), x.T @ y), strict=True))
    i, j = np.nonzero((found["n"] > 0) & ((a[:, None] <= b[None, :]) if low == high else True))
    return pd.DataFrame({"a": a[i], "b": b[j], **{c: found[c][i, j] for c in _SUMS}})


def correlation_pairs(returns: DataFrame, value: str, least: int, key: str = "k", day: str = "d", block: int = BLOCK) -> DataFrame:
    """a, b, corr of every two keys over the days both have; 0 where there are fewer than ``least`` or one does not vary.

    Keys are dealt to blocks of about ``block``, days to years.  A task has two
    blocks' rows of a year, at most some 366 rows a key, and gives the sums of
    their pairs by matrix products, so there is no row for each pair and day.  A
    key and day has one value; values are taken less the mean of all, for
    precision.
    """
    held = returns.filter(F.col(value).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(day).cast("date").alias("day"), F.col(value).cast("double").alias("x"))
    size = held.agg(F.avg("x").alias("mean"), F.approx_count_distinct("key").alias("keys")).first()
    blocks = max(1, -(-size["keys"] // block))
    dealt = held.withColumn("x", F.col("x") - F.lit(size["mean"] or 0.0)).withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    found = met.withColumn("year", F.year("day")).groupBy("low", "high", "year").applyInPandas(_block_sums, "a string, b string, " + ", ".join(f"{c} double" for c in _SUMS))
    sums = found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(*(F.sum(F.when(F.col("a") <= F.col("b"), F.col(c)).otherwise(F.col(d))).alias(c) for c, d in zip(_SUMS, ("n", "sy", "sx", "syy", "sxx", "sxy"), strict=True)))
    spread = lambda s, ss: F.col(ss) - F.col(s) * F.col(s) / F.col("n")
    flat = (spread("sx", "sxx") <= 1e-13 * F.col("sxx")) | (spread("sy", "syy") <= 1e-13 * F.col("syy"))
    corr = (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(spread("sx", "sxx") * spread("sy", "syy"))
    half = sums.select("a", "b", F.when((F.col("n") < least) | flat, 0.0).otherwise(F.least(F.greatest(corr, F.lit(-1.0)), F.lit(1.0))).alias("corr"))
    return half.withColumn("x", F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))).select("x.a", "x.b", "corr")
