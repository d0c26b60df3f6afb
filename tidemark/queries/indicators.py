"""Queries of indicators, strategies and backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.indicators import RECURSIVE, SCANNED, compute
from tidemark.indicators.scanned import LEVELS
from tidemark.operators.cluster import cluster_order
from tidemark.operators.series import correlation_pairs, growth
from tidemark.plans.relations import BARS_SQL, NUDGE, bars, nav, nav_sql
from tidemark.queries.book import Book
from tidemark.strategies import STRATEGIES, backtest, equity_curve, trade_stats, with_signals

BOOK = Book()
_N = "row_number() OVER w"


def _last(f: str, n: int) -> str:
    return f"{f} OVER (PARTITION BY k ORDER BY d ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(f: str, n: int, rows: int | None = None) -> str:
    return f"CASE WHEN n >= {rows or n} THEN {_last(f, n)} END"


_BASE = f"bars AS ({BARS_SQL}), b AS (SELECT *, (high + low + close) / 3 AS tp, lag(close) OVER w AS prev, {_N} AS n FROM bars WINDOW w AS (PARTITION BY k ORDER BY d))"
_POSITION = "coalesce((close - {lo}) / nullif({hi} - {lo}, 0), 0)"


def _position(n: int) -> str:
    return _POSITION.format(lo=_last("min(low)", n), hi=_last("max(high)", n))


_PLAIN = {
    **{f"sma_{n}": (f"sma_{n}", _full("avg(close)", n)) for n in (20, 50, 200)},
    "bb_upper": ("bollinger", f"{_full('avg(close)', 20)} + 2 * {_full('stddev_pop(close)', 20)}"),
    "bb_lower": ("bollinger", f"{_full('avg(close)', 20)} - 2 * {_full('stddev_pop(close)', 20)}"),
    "vwap": ("vwap", "sum(tp * volume) OVER w / sum(volume) OVER w"),
    "dc_upper": ("donchian", _full("max(high)", 20)),
    "dc_lower": ("donchian", _full("min(low)", 20)),
    "obv": ("obv", "sum(coalesce(sign(close - prev), 1) * volume) OVER w"),
    "williams_r": ("williams_r", f"CASE WHEN n >= 14 THEN ({_position(14)} - 1) * 100 END"),
    "momentum": ("momentum", "close - lag(close, 10) OVER w"),
    "roc": ("roc", "100 * (close / lag(close, 10) OVER w - 1)"),
    "ad": ("chaikin_ad", "sum(coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume) OVER w"),
    "ppo": ("ppo", f"100 * ({_full('avg(close)', 12)} - {_full('avg(close)', 26)}) / {_full('avg(close)', 26)}"),
}


def _rounded(rows, columns):
    return rows.select("k", "d", *(F.round(F.col(c) + 1e3 * NUDGE, 5).alias(c) for c in columns))


@BOOK.add("i_windowed_indicators", f"WITH {_BASE} SELECT k, d, {', '.join(f'round({sql} + {1e3 * NUDGE}, 5) AS {c}' for c, (_, sql) in _PLAIN.items())} FROM b WINDOW w AS (PARTITION BY k ORDER BY d)", dates="d")
def windowed(spark, sf_dir):
    return _rounded(compute(bars(spark, sf_dir), list(dict.fromkeys(n for n, _ in _PLAIN.values()))), _PLAIN)


_SECOND = f"""{_BASE}, f AS (SELECT *, 100 * {_position(5)} AS fast, tp * volume AS flow, lag(tp) OVER w AS tp0, least(low, prev) AS lo, greatest(high, prev) AS hi,
  {_last("avg(tp)", 20)} AS mean, list(tp) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS tps,
  {_last("arg_max(n, (high, n))", 15)} AS top, {_last("arg_max(n, (-low, n))", 15)} AS bottom FROM b WINDOW w AS (PARTITION BY k ORDER BY d)),
g AS (SELECT *, {_full("avg(fast)", 3, 7)} AS stoch_k, {_last("sum(CASE WHEN tp > tp0 THEN flow ELSE 0 END)", 14)} AS up, {_last("sum(CASE WHEN tp < tp0 THEN flow ELSE 0 END)", 14)} AS down,
  {", ".join(f"coalesce({_last('sum(CASE WHEN prev IS NOT NULL THEN close - lo END)', m)} / nullif({_last('sum(CASE WHEN prev IS NOT NULL THEN hi - lo END)', m)}, 0), 0) AS u{m}" for m in (7, 14, 28))} FROM f)"""


@BOOK.add(
    "i_windowed_oscillators",
    f"""WITH {_SECOND} SELECT k, d, round(stoch_k + {1e3 * NUDGE}, 5) AS stoch_k, round({_full("avg(stoch_k)", 3, 9)} + {1e3 * NUDGE}, 5) AS stoch_d, round(CASE WHEN n > 14 THEN coalesce(100 * up / nullif(up + down, 0), 0) END + {1e3 * NUDGE}, 5) AS mfi,
  round(CASE WHEN n >= 20 THEN coalesce((tp - mean) / nullif(0.015 * list_sum(list_transform(tps, lambda x: abs(x - mean))) / 20, 0), 0) END + {1e3 * NUDGE}, 5) AS cci,
  round(CASE WHEN n >= 15 THEN 100.0 * (14 - (n - bottom)) / 14 END + {1e3 * NUDGE}, 5) AS aroon_down, round(CASE WHEN n >= 15 THEN 100.0 * (14 - (n - top)) / 14 END + {1e3 * NUDGE}, 5) AS aroon_up,
  round(CASE WHEN n > 28 THEN 100 * (4 * u7 + 2 * u14 + u28) / 7 END + {1e3 * NUDGE}, 5) AS ultimate FROM g""",
    dates="d",
)
def oscillators(spark, sf_dir):
    rows = compute(bars(spark, sf_dir), ["stochastic", "mfi", "cci", "aroon", "ultimate"])
    return _rounded(rows, ("stoch_k", "stoch_d", "mfi", "cci", "aroon_down", "aroon_up", "ultimate"))


@BOOK.add("i_recursive_indicators")
def recursive(spark, sf_dir):
    columns = [c for kinds in (SCANNED, RECURSIVE) for c in (x for names, _ in kinds.values() for x in names)]
    return _rounded(compute(bars(spark, sf_dir), [*SCANNED, *RECURSIVE]), columns)


#: The smoothings as states of a recursion from row to row: values seen, their sum at the start, and the mean.
_INPUTS = {"_line": "quick_y1 - ema_26_y1", "_dx": "CASE WHEN pd + md > 0 THEN 100 * abs(pd - md) / (pd + md) WHEN pd + md IS NOT NULL THEN 0 END"}
_NAMED = [{name.lstrip("_"): (_INPUTS.get(x, x.lstrip("_") + ("_y1" if x in ("_e20", "_e20b", "_e15", "_e15b") else "")), n, share) for name, (x, n, share) in level.items()} for level in LEVELS]


def _stepped(name: str, x: str, n: int, share: float) -> str:
    return f"""{name}_c + CASE WHEN ({x}) IS NULL THEN 0 ELSE 1 END AS {name}_c1, CASE WHEN ({x}) IS NOT NULL AND {name}_c < {n} THEN {name}_s + ({x}) ELSE {name}_s END AS {name}_s1,
    CASE WHEN ({x}) IS NULL THEN {name}_y WHEN {name}_c + 1 < {n} THEN NULL WHEN {name}_c + 1 = {n} THEN ({name}_s + ({x})) / {n} ELSE {name}_y + {share!r} * (({x}) - {name}_y) END AS {name}_y1"""


_STATES = [name for level in _NAMED for name in level]
_LAYER = [", ".join(_stepped(name, *spec) for name, spec in level.items()) for level in _NAMED]
_FLOW = "CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) ELSE 0 END * volume"
_RSI = "CASE WHEN gain_y + loss_y > 0 THEN 100 * gain_y / (gain_y + loss_y) WHEN gain_y + loss_y IS NOT NULL THEN 0 END"
_SMOOTHED = {
    "ema_12": "ema_12_y", "ema_26": "ema_26_y", "dema": "2 * e20_y - e20b_y", "tema": "3 * e20_y - 3 * e20b_y + e20c_y", "kama": "CASE WHEN n > 30 THEN kama END",
    "kc_upper": "e20_y + 1.5 * tr20_y", "kc_middle": "e20_y", "kc_lower": "e20_y - 1.5 * tr20_y", "rsi": "rsi", "macd": "CASE WHEN signal_y IS NOT NULL THEN quick_y - ema_26_y END", "macd_signal": "signal_y", "macd_hist": "quick_y - ema_26_y - signal_y",
    "atr": "tr14_y", "natr": "100 * tr14_y / close", "stochrsi_k": "fast_k", "stochrsi_d": "CASE WHEN count(fast_k) OVER v3 = 3 THEN avg(fast_k) OVER v3 END", "adx": "adx_y", "plus_di": "100 * plus_y / nullif(tr14_y, 0)", "minus_di": "100 * minus_y / nullif(tr14_y, 0)",
    "adosc": "CASE WHEN n >= 10 THEN fast - slow END", "trix": "100 * (e15c_y / lag(e15c_y) OVER w - 1)",
}


@BOOK.add(
    "i_smoothed_indicators",
    f"""WITH RECURSIVE bars AS ({BARS_SQL}), p AS (SELECT *, row_number() OVER w AS n, lag(close) OVER w AS c0, lag(high) OVER w AS h0, lag(low) OVER w AS l0, lag(close, 30) OVER w AS c30 FROM bars WINDOW w AS (PARTITION BY k ORDER BY d)),
b AS (SELECT k, d, n, close, CASE WHEN n > 14 THEN close END AS late, CASE WHEN n > 1 THEN greatest(high - low, abs(high - c0), abs(low - c0)) END AS tr, CASE WHEN n > 1 THEN greatest(close - c0, 0) END AS up, CASE WHEN n > 1 THEN greatest(c0 - close, 0) END AS down,
  CASE WHEN n > 1 THEN CASE WHEN high - h0 > l0 - low AND high > h0 THEN high - h0 ELSE 0 END END AS plus_dm, CASE WHEN n > 1 THEN CASE WHEN l0 - low > high - h0 AND l0 > low THEN l0 - low ELSE 0 END END AS minus_dm, sum({_FLOW}) OVER (PARTITION BY k ORDER BY d) AS flow,
  pow(coalesce(abs(close - c30) / nullif(sum(abs(close - c0)) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 0), 1) * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2) AS share FROM p),
e AS (SELECT DISTINCT k, 0::BIGINT AS n, {", ".join(f"0 AS {x}_c, 0.0::DOUBLE AS {x}_s, NULL::DOUBLE AS {x}_y" for x in _STATES)}, NULL::DOUBLE AS kama, NULL::DOUBLE AS fast, NULL::DOUBLE AS slow FROM bars
  UNION ALL SELECT k, n1, {", ".join(f"{x}_c1, {x}_s1, {x}_y1" for x in _STATES)}, kama1, fast1, slow1 FROM (SELECT *, {_LAYER[2]} FROM (SELECT *, {_LAYER[1]} FROM (SELECT *, 100 * plus_y1 / nullif(tr14_y1, 0) AS pd, 100 * minus_y1 / nullif(tr14_y1, 0) AS md FROM (
    SELECT e.*, b.n AS n1, {_LAYER[0]}, CASE WHEN b.n = 30 THEN close WHEN b.n > 30 THEN kama + share * (close - kama) END AS kama1, CASE WHEN b.n = 1 THEN flow ELSE fast + 2.0 / 4 * (flow - fast) END AS fast1, CASE WHEN b.n = 1 THEN flow ELSE slow + 2.0 / 11 * (flow - slow) END AS slow1
    FROM e JOIN b ON b.k = e.k AND b.n = e.n + 1))))),
r AS (SELECT e.*, b.d, b.close, {_RSI} AS rsi FROM e JOIN b ON b.k = e.k AND b.n = e.n),
f AS (SELECT *, CASE WHEN count(rsi) OVER v5 = 5 THEN coalesce(100 * (rsi - min(rsi) OVER v5) / nullif(max(rsi) OVER v5 - min(rsi) OVER v5, 0), 0) END AS fast_k FROM r WINDOW v5 AS (PARTITION BY k ORDER BY n ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT k, d, {", ".join(f"round({x} + {1e3 * NUDGE}, 5) AS {c}" for c, x in _SMOOTHED.items())} FROM f WINDOW w AS (PARTITION BY k ORDER BY n), v3 AS (PARTITION BY k ORDER BY n ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    dates="d",
)
def smoothed(spark, sf_dir):
    return _rounded(compute(bars(spark, sf_dir), list(SCANNED)), [c for columns, _ in SCANNED.values() for c in columns])


@BOOK.add("i4_last_ema", f"WITH bars AS ({BARS_SQL}), s AS (SELECT k, list(close ORDER BY d) AS x FROM bars GROUP BY k) SELECT k, {', '.join(f'round(list_reduce(x[{n + 1}:], lambda a, v: a + 2.0 / {n + 1} * (v - a), list_avg(x[1:{n}])), 4) AS ema_{n}' for n in (12, 26))} FROM s")
def last_ema(spark, sf_dir):
    rows = compute(bars(spark, sf_dir), ["ema_12", "ema_26"])
    return rows.groupBy("k").agg(*(F.round(F.max_by(c, "d"), 4).alias(c) for c in ("ema_12", "ema_26")))


_SMA = f"bars AS ({BARS_SQL}), b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d) AS n FROM bars), s AS (SELECT k, d, close, {_full('avg(close)', 20)} AS a, {_full('avg(close)', 50)} AS b FROM b)"


@BOOK.add("b5_sma_signals", f"WITH {_SMA}, c AS (SELECT *, lag(a) OVER w AS a0, lag(b) OVER w AS b0 FROM s WINDOW w AS (PARTITION BY k ORDER BY d)) SELECT k, d, coalesce(a > b AND a0 <= b0, false) AS entry, coalesce(b > a AND b0 <= a0, false) AS exit FROM c", dates="d")
def sma_signals(spark, sf_dir):
    return with_signals(bars(spark, sf_dir), "sma_crossover").select("k", "d", "entry", "exit")


@BOOK.add("b2_strategy_signals")
def strategy_signals(spark, sf_dir):
    rows = None
    for name in STRATEGIES:
        one = with_signals(bars(spark, sf_dir), name).groupBy("k").agg(F.count_if("entry").alias("entries"), F.count_if("exit").alias("exits")).withColumn("strategy", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def _signals(spark, sf_dir, name="sma_crossover"):
    series = nav(spark, sf_dir, "brand")
    bar = series.select("k", "d", *(F.col("nav").alias(c) for c in ("open", "high", "low", "close")), F.lit(1.0).alias("volume"))
    return with_signals(bar, name)


@BOOK.add("b7_trade_stats")
def stats(spark, sf_dir):
    return trade_stats(backtest(_signals(spark, sf_dir, "rsi"), stop=0.1, trailing=True))


_CROSSED = f"b AS (SELECT k, d, nav AS close, row_number() OVER (PARTITION BY k ORDER BY d) AS n FROM ({nav_sql('brand')})), s AS (SELECT k, d, n, close, {_full('avg(close)', 20)} AS a, {_full('avg(close)', 50)} AS b FROM b), x AS (SELECT *, lag(a) OVER w AS a0, lag(b) OVER w AS b0 FROM s WINDOW w AS (PARTITION BY k ORDER BY d)), sig AS (SELECT k, d, n, close, coalesce(a > b AND a0 <= b0, false) AS entry, coalesce(b > a AND b0 <= a0, false) AS exit FROM x)"


@BOOK.add("b8_equity_curve", f"WITH {_CROSSED}, r AS (SELECT k, n, entry, lag(entry) OVER (PARTITION BY k ORDER BY n) AS before FROM sig WHERE entry OR exit), e AS (SELECT k, n, CASE WHEN entry AND before IS DISTINCT FROM true THEN 1 WHEN NOT entry AND before THEN -1 END AS turn FROM r), c AS (SELECT k, d, close, sum(turn) OVER w AS held, sum(CASE turn WHEN 1 THEN -ln(close * 1.001 * 1.001) WHEN -1 THEN ln(close * 0.999 * 0.999) END) OVER w AS grown, first_value(close) OVER w AS first FROM sig LEFT JOIN e USING (k, n) WINDOW w AS (PARTITION BY k ORDER BY n)) SELECT k, d, round(100000 * exp(coalesce(grown, 0)) * CASE WHEN held = 1 THEN close ELSE 1 END + {1e4 * NUDGE}, 2) AS equity, round(100000 * close / first + {1e4 * NUDGE}, 2) AS hold FROM c", dates="d")
def equity(spark, sf_dir):
    return equity_curve(_signals(spark, sf_dir)).select("k", "d", *(F.round(F.col(c) + 1e4 * NUDGE, 2).alias(c) for c in ("equity", "hold")))


@BOOK.add(
    "b6_backtest_trades",
    f"""WITH RECURSIVE {_CROSSED},
c AS (SELECT e.k, e.n, any_value(e.d) AS d, any_value(e.close) AS close, min(s.n) AS x FROM sig AS e LEFT JOIN sig AS s ON s.k = e.k AND s.n > e.n AND (s.exit OR s.close <= e.close * (1 - 0.1)) WHERE e.entry GROUP BY e.k, e.n),
f AS (SELECT c.*, (SELECT min(y.n) FROM c AS y WHERE y.k = c.k AND y.n > c.x) AS next, coalesce(o.d, z.d) AS exit_day, coalesce(o.close * 0.999, z.close) AS exit_price, 1 / (c.close * 1.001 * 1.001) AS unit FROM c LEFT JOIN (SELECT k, n AS x, d, close FROM sig) AS o USING (k, x) JOIN (SELECT k, max(d) AS d, arg_max(close, d) AS close FROM sig GROUP BY k) AS z USING (k)),
t AS (SELECT f.*, CAST(100000 AS DOUBLE) AS cost FROM f WHERE n = (SELECT min(n) FROM c WHERE c.k = f.k) UNION ALL SELECT f.*, t.cost * t.unit * t.exit_price * 0.999 FROM t JOIN f ON f.k = t.k AND f.n = t.next),
v AS (SELECT *, cost * unit * exit_price * CASE WHEN x IS NULL THEN 1 ELSE 0.999 END - cost AS pnl FROM t)
SELECT k, d AS entry_day, exit_day, round(cost * unit, 5) AS size, round(close * 1.001, 5) AS entry_price, round(exit_price, 5) AS exit_price, round(pnl, 3) AS pnl, round(pnl / cost, 5) AS ret, CASE WHEN x IS NULL THEN 'Open' ELSE 'Closed' END AS status FROM v""",
    dates="entry_day exit_day",
)
def trades(spark, sf_dir):
    return backtest(_signals(spark, sf_dir), stop=0.1).select("k", "entry_day", "exit_day", *(F.round(c, n).alias(c) for c, n in (("size", 5), ("entry_price", 5), ("exit_price", 5), ("pnl", 3), ("ret", 5))), "status")


_TRADES = "SELECT o_custkey % 20 AS k, o_totalprice - 140000 AS pnl, (o_totalprice - 140000) / 1000000 AS ret, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_custkey % 30 AS INT) AS b FROM orders"


@BOOK.add(
    "a23_trade_stats",
    f"""SELECT k, count(*) AS trades, round(100.0 * count(*) FILTER (WHERE pnl > 0) / count(*), 5) AS win_rate, round(coalesce(avg(100 * ret) FILTER (WHERE pnl > 0), 0), 6) AS avg_win, round(coalesce(avg(100 * ret) FILTER (WHERE pnl < 0), 0), 6) AS avg_loss,
  round(abs(avg(100 * ret) FILTER (WHERE pnl > 0) / avg(100 * ret) FILTER (WHERE pnl < 0)), 6) AS payoff, round(sum(pnl) FILTER (WHERE pnl > 0) / abs(sum(pnl) FILTER (WHERE pnl < 0)), 6) AS profit_factor,
  round(avg(pnl), 3) AS expectancy, round(sqrt(count(*)) * avg(pnl) / stddev_samp(pnl), 6) AS sqn, round(avg(b - a), 6) AS mean_days FROM ({_TRADES}) GROUP BY k""",
)
def order_stats(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day, pnl = F.col("o_orderdate").cast("date"), F.col("o_totalprice") - 140000
    rows = orders.select((F.col("o_custkey") % 20).alias("k"), pnl.alias("pnl"), (pnl / 1000000).alias("ret"), day.alias("entry_day"), F.date_add(day, (F.col("o_custkey") % 30).cast("int")).alias("exit_day"))
    return trade_stats(rows).select("k", "trades", *(F.round(c, n).alias(c) for c, n in (("win_rate", 5), ("avg_win", 6), ("avg_loss", 6), ("payoff", 6), ("profit_factor", 6), ("expectancy", 3), ("sqn", 6), ("mean_days", 6))))


@BOOK.add("c1_cluster_order")
def clusters(spark, sf_dir):
    returns = nav(spark, sf_dir, "brand").withColumn("r", growth("nav"))
    return cluster_order(correlation_pairs(returns, "r", 30))
