"""Trading strategies: entry and exit signals on bars, and a backtest of them."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.indicators import compute
from tidemark.operators.series import last_rows, ordered

#: Name to (indicators it needs, function of its parameters to (entry, exit)).
STRATEGIES: dict[str, tuple[list[str], Callable[..., tuple[Column, Column]]]] = {}


def strategy(name: str, *needs: str):
    def register(make):
        STRATEGIES[name] = (list(needs), make)
        return make

    return register


def _crossed_above(a: Column, b: Column) -> Column:
    return (a > b) & (F.lag(a).over(ordered()) <= F.lag(b).over(ordered()))


@strategy("rsi", "rsi")
def rsi(low: float = 30, high: float = 70):
    """Enters while the index is low and leaves while it is high: levels, not crossings."""
    return F.col("rsi") < low, F.col("rsi") > high


@strategy("macd")
def macd(fast: int = 12, slow: int = 26, signal: int = 9):
    """Zero crossings of the histogram of simple averages, which are in columns of ``with_signals``."""
    return _crossed_above(F.col("_hist"), F.lit(0.0)), _crossed_above(F.lit(0.0), F.col("_hist"))


@strategy("bollinger", "bollinger", "rsi")
def bollinger(guard: float = 40):
    """Enters on a fall below the lower band while the index is under the guard, leaves on a rise above the upper."""
    return _crossed_above(F.col("bb_lower"), F.col("close")) & (F.col("rsi") < guard), _crossed_above(F.col("close"), F.col("bb_upper"))


@strategy("sma_crossover", "sma_20", "sma_50")
def sma_crossover():
    return _crossed_above(F.col("sma_20"), F.col("sma_50")), _crossed_above(F.col("sma_50"), F.col("sma_20"))


def _mean(c: str, n: int, rows: int) -> Column:
    return F.when(F.row_number().over(ordered()) >= rows, F.avg(c).over(last_rows(n)))


def with_signals(bars: DataFrame, name: str, **parameters) -> DataFrame:
    """bars with boolean ``entry`` and ``exit``; a missing indicator gives no signal."""
    needs, make = STRATEGIES[name]
    rows = compute(bars, needs)
    if name == "macd":
        fast, slow, signal = (parameters.get(k, v) for k, v in (("fast", 12), ("slow", 26), ("signal", 9)))
        rows = rows.withColumn("_line", _mean("close", fast, slow) - _mean("close", slow, slow)).withColumn("_hist", F.col("_line") - _mean("_line", signal, slow + signal - 1))
    entry, leave = make(**parameters)
    kept = [c for c in bars.columns]
    return rows.select(*kept, F.coalesce(entry, F.lit(False)).alias("entry"), F.coalesce(leave, F.lit(False)).alias("exit"))


#: Start of the cash account, fee and slippage a side.
CASH, FEE, SLIP = 100_000.0, 0.001, 0.001
_TRADE = "k string, entry_day date, exit_day date, size double, entry_price double, exit_price double, pnl double, ret double, status string"
_EQUITY = "k string, d date, equity double, hold double"


def _simulate(pdf: pd.DataFrame, stop: float, trailing: bool, cash: float) -> tuple[list[tuple], np.ndarray]:
    """The account's state from bar to bar: all in on an entry, all out on an exit or stop."""
    size = cost = reference = 0.0
    opened = None
    entry_price, start, trades, equity = 0.0, cash, [], np.zeros(len(pdf))
    rows = zip(pdf["d"], pdf["close"].to_numpy(float), pdf["entry"].to_numpy(bool), pdf["exit"].to_numpy(bool), strict=True)
    for i, (day, price, enter, leave) in enumerate(rows):
        if size == 0 and enter:
            entry_price = price * (1 + SLIP)
            size, cost = cash / (entry_price * (1 + FEE)), cash
            cash, opened, reference = 0.0, day, price
        elif size > 0:
            reference = max(reference, price) if trailing else reference
            if leave or (stop > 0 and price <= reference * (1 - stop)):
                out = price * (1 - SLIP)
                cash = size * out * (1 - FEE)
                trades.append((opened, day, size, entry_price, out, cash - cost, (cash - cost) / cost, "Closed"))
                size = 0.0
        equity[i] = cash + size * price
    if size > 0:
        last = float(pdf["close"].iloc[-1])
        trades.append((opened, pdf["d"].iloc[-1], size, entry_price, last, size * last - cost, (size * last - cost) / cost, "Open"))
    return trades, equity


def backtest(signals: DataFrame, stop: float = 0.0, trailing: bool = False, cash: float = CASH) -> DataFrame:
    """The trades of signals(k, d, close, entry, exit), each key with an account of its own."""

    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        trades, _ = _simulate(pdf.sort_values("d"), stop, trailing, cash)
        return pd.DataFrame([(key[0], *t) for t in trades], columns=[c.split()[0] for c in _TRADE.split(", ")])

    return signals.groupBy("k").applyInPandas(run, _TRADE)


def equity_curve(signals: DataFrame, stop: float = 0.0, trailing: bool = False, cash: float = CASH) -> DataFrame:
    """k, d, equity of the strategy and hold, what buying on the first day would be worth."""

    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d")
        _, equity = _simulate(pdf, stop, trailing, cash)
        close = pdf["close"].to_numpy(float)
        return pd.DataFrame({"k": key[0], "d": pdf["d"].to_numpy(), "equity": equity, "hold": cash * close / close[0]})

    return signals.groupBy("k").applyInPandas(run, _EQUITY)


def trade_stats(trades: DataFrame) -> DataFrame:
    """Statistics of trades(k, pnl, ret, entry_day, exit_day): no loser gives payoff 0 and profit factor infinity, one trade or no variance SQN 0."""
    win, lose = F.col("pnl") > 0, F.col("pnl") < 0
    n, spread = F.count("*"), F.stddev_samp("pnl")
    mean_loss = F.avg(F.when(lose, 100 * F.col("ret")))
    gains, losses = F.coalesce(F.sum(F.when(win, F.col("pnl"))), F.lit(0.0)), F.abs(F.sum(F.when(lose, F.col("pnl"))))
    mean_win = F.avg(F.when(win, 100 * F.col("ret")))
    return trades.groupBy("k").agg(
        n.alias("trades"),
        F.try_divide(100.0 * F.count_if(win), n).alias("win_rate"),
        F.coalesce(mean_win, F.lit(0.0)).alias("avg_win"),
        F.coalesce(mean_loss, F.lit(0.0)).alias("avg_loss"),
        (100 * F.max("ret")).alias("best"),
        (100 * F.min("ret")).alias("worst"),
        F.coalesce(F.abs(F.try_divide(mean_win, mean_loss)), F.lit(0.0)).alias("payoff"),
        F.when(losses.isNull() | (losses == 0), F.lit(float("inf"))).otherwise(F.try_divide(gains, losses)).alias("profit_factor"),
        F.avg("pnl").alias("expectancy"),
        F.when((n > 1) & (spread > 0), F.sqrt(n.cast("double")) * F.avg("pnl") / spread).otherwise(0.0).alias("sqn"),
        F.avg(F.datediff("exit_day", "entry_day")).alias("mean_days"),
    )
