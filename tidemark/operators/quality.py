"""Checks and repairs of price series (k, d, nav)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.series import ordered

#: A value this many times off both neighbours is a glitch; how near a jump's log10 must be to a whole number for a change of scale.
GLITCH, SCALE = 2.0, 0.04
#: Rows that a series needs for repair, and the yearly growth that a repaired one may have.
LEAST, GROWTH = 30, (-0.10, 0.60)


def glitches(nav: DataFrame, times: float = GLITCH) -> DataFrame:
    """Rows that are far above or far below both neighbours."""
    before, after = F.lag("nav").over(ordered()), F.lead("nav").over(ordered())
    rows = nav.withColumn("before", before).withColumn("after", after).filter("before > 0 and after > 0 and nav > 0")
    above = F.col("nav") / F.greatest("before", "after")
    below = F.least("before", "after") / F.col("nav")
    return rows.filter((above > times) | (below > times)).select("k", "d", "nav", F.greatest(above, below).alias("times"))


def without_glitches(nav: DataFrame) -> DataFrame:
    return nav.join(glitches(nav).select("k", "d"), ["k", "d"], "left_anti")


def _with_breaks(nav: DataFrame, tolerance: float) -> DataFrame:
    """nav with ``power`` where a value is about 10, 100, ... times the one before, else NULL.

    Only jumps upwards are errors of scale, those downwards are splits.  Series
    of less than ``LEAST`` rows and of segregated schemes have none.
    """
    before = F.lag("nav").over(ordered())
    log = F.when((before > 0) & (F.col("nav") > before), F.log10(F.col("nav") / before))
    rows = nav.withColumn("log", log).withColumn("rows", F.count("*").over(Window.partitionBy("k")))
    power = F.bround("log").cast("int")
    sound = (power >= 1) & (F.abs(F.col("log") - power) < tolerance) & (F.col("rows") >= LEAST) & ~F.contains(F.lower("k"), F.lit("segregated"))
    return rows.withColumn("power", F.when(sound, power)).drop("log", "rows")


def scale_breaks(nav: DataFrame, tolerance: float = SCALE) -> DataFrame:
    """k, d, power of the breaks of scale."""
    return _with_breaks(nav, tolerance).filter("power is not null").select("k", "d", "power")


def rescaled(nav: DataFrame, tolerance: float = SCALE) -> DataFrame:
    """nav with all values before a break brought to the scale after it; several breaks add up.

    A series whose yearly growth over all its days would then lie outside ``GROWTH`` stays as it is.
    """
    rows = _with_breaks(nav, tolerance)
    sofar = F.sum("power").over(ordered().rowsBetween(Window.unboundedPreceding, 0))
    later = F.coalesce(F.sum("power").over(Window.partitionBy("k")), F.lit(0)) - F.coalesce(sofar, F.lit(0))
    rows = rows.withColumn("fixed", F.col("nav") * F.pow(F.lit(10.0), later))
    whole = ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first("fixed").over(whole), F.last("nav").over(whole)
    years = F.datediff(F.last("d").over(whole), F.first("d").over(whole)) / 365.25
    growth = F.when((years > 0) & (first > 0), F.pow(last / first, 1 / years) - 1).otherwise(0.0)
    return rows.withColumn("growth", growth).select("k", "d", F.when(F.col("growth").between(*GROWTH), F.col("fixed")).otherwise(F.col("nav")).alias("nav"))
