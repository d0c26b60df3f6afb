"""Portfolio operators on trades(k, d, side, qty, price) and nav(k, d, nav)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.series import ordered, running_total

#: Yearly rate of the fixed deposit that a portfolio is compared with.
DEPOSIT_RATE = 0.065


def signed(trades: DataFrame) -> DataFrame:
    """trades with signed_qty, by the side in any case, and trade_value."""
    sign = F.when(F.lower("side") == "buy", 1).otherwise(-1)
    return trades.withColumn("signed_qty", F.col("qty") * sign).withColumn("trade_value", F.col("qty") * F.col("price") * sign)


def cumulative_units(trades: DataFrame) -> DataFrame:
    """k, d, units held after each day with trades."""
    daily = signed(trades).groupBy("k", "d").agg(F.sum("signed_qty").alias("q"))
    return daily.select("k", "d", F.sum("q").over(ordered()).alias("units"))


def net_units(trades: DataFrame) -> DataFrame:
    return signed(trades).groupBy("k").agg(F.sum("signed_qty").alias("units")).filter("units > 0")


def _events(trades: DataFrame, nav: DataFrame) -> DataFrame:
    """k, d, q, nav, turn: the traded units and the values of traded funds as one stream of events, a day's trades before its value."""
    daily = signed(trades).groupBy("k", "d").agg(F.sum("signed_qty").alias("q"))
    both = daily.select("k", "d", "q", F.lit(None).cast("double").alias("nav"), F.lit(0).alias("turn")).unionByName(nav.select("k", "d", F.lit(None).cast("double").alias("q"), "nav", F.lit(1).alias("turn")))
    return both.withColumn("_first", F.min("turn").over(Window.partitionBy("k"))).filter("_first = 0").drop("_first")


def _change(value: Column) -> Column:
    """What an event changes of its fund's value: units times value after it less before it."""
    return value - F.lag(value, 1, 0.0).over(Window.partitionBy("k").orderBy("d", "turn"))


def value_series(trades: DataFrame, nav: DataFrame) -> DataFrame:
    """d, value: units held times value of all funds, on days of any of them; both carried forward, values of 0 or less left out.

    A sweep over events: what a fund's value or units change of the total is
    summed by day and added up over the days, so no fund is put on the days of
    the others.  Units of days on which no fund has a value are taken over with
    the fund's next trade on a day that has one.
    """
    events = _events(trades, nav).withColumn("_spine", F.max("turn").over(Window.partitionBy("d")) == 1)
    sofar = Window.partitionBy("k").orderBy("d", "turn").rowsBetween(Window.unboundedPreceding, 0)
    counted = events.withColumn("_units", F.when((F.col("turn") == 0) & F.col("_spine"), F.sum("q").over(sofar)))
    held = F.coalesce(F.last("_units", ignorenulls=True).over(sofar), F.lit(0.0)) * F.coalesce(F.last("nav", ignorenulls=True).over(sofar), F.lit(0.0))
    moves = counted.withColumn("_value", held).filter("_spine").withColumn("_move", _change(F.col("_value")))
    return running_total(moves.groupBy("d").agg(F.sum("_move").alias("value")), "value").filter("value > 0")


def rolled_flows(trades: DataFrame, nav: DataFrame) -> DataFrame:
    """k, d, units, q and flow on each day with a value, of trades since the value before; trades after the last one are dropped."""
    sofar = Window.partitionBy("k").orderBy("d", "turn").rowsBetween(Window.unboundedPreceding, 0)
    valued = _events(trades, nav).withColumn("units", F.coalesce(F.sum("q").over(sofar), F.lit(0.0))).filter("turn = 1")
    q = F.col("units") - F.lag("units", 1, 0.0).over(Window.partitionBy("k").orderBy("d", "turn"))
    return valued.withColumn("q", q).select("k", "d", "turn", "nav", "units", "q", (F.col("q") * F.col("nav")).alias("flow"))


def time_weighted_returns(trades: DataFrame, nav: DataFrame) -> DataFrame:
    """d, value, flow, r: (value - flow) / value before - 1 with flows rolled forward; values of 0 or less give no return."""
    moves = rolled_flows(trades, nav).withColumn("_move", _change(F.col("units") * F.col("nav")))
    total = running_total(moves.groupBy("d").agg(F.sum("_move").alias("value"), F.sum("flow").alias("flow")), "value")
    before = F.lag("value").over(Window.orderBy("d"))  # one row a day
    sound = F.when((F.col("value") > 0) & (before > 0), (F.col("value") - F.col("flow")) / before - 1)
    return total.select("d", "value", "flow", sound.alias("r"))


def clipped_returns(value: DataFrame, flows: DataFrame, edge: float = 0.15) -> DataFrame:
    """d, r: (value - value before - flow) / value before with flows of the same day, clipped to +-edge."""
    before = F.lag("value").over(Window.orderBy("d"))
    r = F.try_divide(F.col("value") - before - F.coalesce("flow", F.lit(0.0)), before)
    return value.join(flows, "d", "left").select("d", F.when(r.isNotNull(), F.least(F.greatest(r, F.lit(-edge)), F.lit(edge))).alias("r")).filter("r is not null")


def allocation(trades: DataFrame, nav: DataFrame) -> DataFrame:
    """k, invested, units, latest, value, pnl, pnl_pct, share of each fund still held."""
    held = signed(trades).groupBy("k").agg(F.sum("trade_value").alias("invested"), F.sum("signed_qty").alias("units")).filter("units > 0")
    last = nav.groupBy("k").agg(F.max_by("nav", "d").alias("latest"))
    rows = held.join(last, "k").withColumn("value", F.col("units") * F.col("latest"))
    pnl = F.col("value") - F.col("invested")
    share = F.try_divide(100 * F.col("value"), F.sum("value").over(Window.partitionBy()))  # one row a fund
    return rows.select("k", "invested", "units", "latest", "value", pnl.alias("pnl"), F.try_divide(100 * pnl, F.abs("invested")).alias("pnl_pct"), share.alias("share"))


def deposit_growth(flows: DataFrame, days: DataFrame, rate: float = DEPOSIT_RATE) -> DataFrame:
    """d, value on each day of days(d) of a deposit that got flows(d, flow) at a yearly rate.

    Every flow grows from its day on.  Discounted to one day, flows are a running
    sum, so there is no join of all flows with all later days.
    """
    zero = F.lit("1970-01-01").cast("date")
    years = F.datediff("d", zero) / 365.25
    rows = flows.select("d", "flow").unionByName(days.select("d", F.lit(0.0).alias("flow"))).groupBy("d").agg(F.sum("flow").alias("flow"))
    base = F.pow(F.lit(1 + rate), -years)
    grown = running_total(rows.withColumn("value", F.col("flow") * base), "value")
    return grown.withColumn("value", F.col("value") / base).join(days.select("d").distinct(), "d", "left_semi").select("d", "value")
