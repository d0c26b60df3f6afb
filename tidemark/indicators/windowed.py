"""Indicators that are window expressions; values are NULL until a window is full."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.series import last_rows, ordered

#: Name to a function of no argument that gives {column: expression over bars}.
WINDOWED: dict[str, Callable[[], dict[str, Column]]] = {}


def indicator(make):
    WINDOWED[make.__name__] = make
    return make


def _over(f, c: str, n: int, rows: int | None = None) -> Column:
    """f over the last n rows once there are that many (or ``rows``, counting rows that have no value yet)."""
    return F.when(F.row_number().over(ordered()) >= (rows or n), f(c).over(last_rows(n)))


def _sma(n: int):
    return lambda: {f"sma_{n}": _over(F.avg, "close", n)}


for _n in (20, 50, 200):
    WINDOWED[f"sma_{_n}"] = _sma(_n)


@indicator
def bollinger():
    middle, width = _over(F.avg, "close", 20), 2 * _over(F.stddev_pop, "close", 20)
    return {"bb_upper": middle + width, "bb_middle": middle, "bb_lower": middle - width}


@indicator
def vwap():
    running = ordered()
    return {"vwap": F.try_divide(F.sum(F.col("_tp") * F.col("volume")).over(running), F.sum("volume").over(running))}


@indicator
def donchian():
    upper, lower = _over(F.max, "high", 20), _over(F.min, "low", 20)
    return {"dc_upper": upper, "dc_middle": (upper + lower) / 2, "dc_lower": lower}


@indicator
def obv():
    change = F.signum(F.col("close") - F.col("_prev"))
    return {"obv": F.sum(F.coalesce(change, F.lit(1.0)) * F.col("volume")).over(ordered())}


@indicator
def mfi():
    flow, before = F.col("_tp") * F.col("volume"), F.lag("_tp").over(ordered())
    up, down = (F.sum(F.when(test, flow).otherwise(0.0)).over(last_rows(14)) for test in (F.col("_tp") > before, F.col("_tp") < before))
    return {"mfi": F.when(F.row_number().over(ordered()) > 14, F.coalesce(F.try_divide(100 * up, up + down), F.lit(0.0)))}


def _range_position(n: int) -> Column:
    high, low = F.max("high").over(last_rows(n)), F.min("low").over(last_rows(n))
    return F.coalesce(F.try_divide(F.col("close") - low, high - low), F.lit(0.0))


@indicator
def stochastic():
    return {"_fast": _range_position(5) * 100, "stoch_k": _over(F.avg, "_fast", 3, 7), "stoch_d": _over(F.avg, "stoch_k", 3, 9)}


@indicator
def williams_r():
    return {"williams_r": F.when(F.row_number().over(ordered()) >= 14, (_range_position(14) - 1) * 100)}


@indicator
def cci():
    mean = F.avg("_tp").over(last_rows(20))
    spread = F.aggregate(F.collect_list("_tp").over(last_rows(20)), F.lit(0.0), lambda a, x: a + F.abs(x - mean)) / 20
    return {"cci": F.when(F.row_number().over(ordered()) >= 20, F.coalesce(F.try_divide(F.col("_tp") - mean, 0.015 * spread), F.lit(0.0)))}


@indicator
def momentum():
    return {"momentum": F.col("close") - F.lag("close", 10).over(ordered())}


@indicator
def roc():
    return {"roc": 100 * (F.try_divide(F.col("close"), F.lag("close", 10).over(ordered())) - 1)}


@indicator
def chaikin_ad():
    place = F.try_divide((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), F.col("high") - F.col("low"))
    return {"ad": F.sum(F.coalesce(place, F.lit(0.0)) * F.col("volume")).over(ordered())}


@indicator
def aroon():
    at = F.row_number().over(ordered())
    window = last_rows(15)
    since = lambda f, c: at - f(F.col("_at"), F.struct(c, "_at")).over(window)
    up, down = since(F.max_by, F.col("high")), since(F.max_by, -F.col("low"))
    return {"_at": at, "aroon_down": F.when(at >= 15, 100.0 * (14 - down) / 14), "aroon_up": F.when(at >= 15, 100.0 * (14 - up) / 14)}


@indicator
def ppo():
    slow = _over(F.avg, "close", 26)
    return {"ppo": F.try_divide(100 * (_over(F.avg, "close", 12) - slow), slow)}


@indicator
def ultimate():
    low = F.least("low", "_prev")
    pressure, reach = F.col("close") - low, F.greatest("high", "_prev") - low
    part = lambda n: F.coalesce(F.try_divide(F.sum(F.when(F.col("_prev").isNotNull(), pressure)).over(last_rows(n)), F.sum(F.when(F.col("_prev").isNotNull(), reach)).over(last_rows(n))), F.lit(0.0))
    return {"ultimate": F.when(F.row_number().over(ordered()) > 28, 100 * (4 * part(7) + 2 * part(14) + part(28)) / 7)}


def add_windowed(bars: DataFrame, wanted: list[str]) -> DataFrame:
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    rows = bars.withColumns({"_tp": typical, "_prev": F.lag("close").over(ordered())})
    for name in wanted:
        for column, expression in WINDOWED[name]().items():
            rows = rows.withColumn(column, expression)
    return rows.drop(*(c for c in rows.columns if c.startswith("_")))
