"""Queries of the portfolio operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import portfolio as ops
from tidemark.plans.relations import NUDGE, TRADES_SQL, nav, nav_sql, trades
from tidemark.queries.book import Book

BOOK = Book()
_T = f"t AS (SELECT *, CASE WHEN lower(side) = 'buy' THEN qty ELSE -qty END AS signed_qty, price * CASE WHEN lower(side) = 'buy' THEN qty ELSE -qty END AS trade_value FROM ({TRADES_SQL}))"
_N = f"n AS ({nav_sql('brand')})"
_DAILY = "q AS (SELECT k, d, sum(signed_qty) AS q FROM t GROUP BY k, d)"


def _r(c, digits=4):
    return F.round(c if not isinstance(c, str) else F.col(c), digits)


@BOOK.add("p9_normalised_trades", f"WITH {_T} SELECT trade_id, k, d, signed_qty, trade_value FROM t", dates="d")
def normalised(spark, sf_dir):
    return ops.signed(trades(spark, sf_dir)).select("trade_id", "k", "d", "signed_qty", "trade_value")


@BOOK.add("w10_cumulative_units", f"WITH {_T}, {_DAILY} SELECT k, d, round(sum(q) OVER (PARTITION BY k ORDER BY d) + {NUDGE} * 1000, 3) AS units FROM q", dates="d")
def units(spark, sf_dir):
    return ops.cumulative_units(trades(spark, sf_dir)).select("k", "d", _r(F.col("units") + NUDGE * 1000, 3).alias("units"))


@BOOK.add("a3_net_units", f"WITH {_T} SELECT k, round(sum(signed_qty), 3) AS units FROM t GROUP BY k HAVING sum(signed_qty) > 0")
def net(spark, sf_dir):
    return ops.net_units(trades(spark, sf_dir)).select("k", _r("units", 3).alias("units"))


@BOOK.add("a8_tradebook_stats", f"WITH {_T} SELECT count(*) AS total, count(*) FILTER (WHERE lower(side) = 'buy') AS buys, count(*) FILTER (WHERE lower(side) = 'sell') AS sells, count(DISTINCT k) AS symbols, min(d) AS first_day, max(d) AS last_day FROM t", dates="first_day last_day")
def stats(spark, sf_dir):
    side = F.lower("side")
    return trades(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(side == "buy").alias("buys"), F.count_if(side == "sell").alias("sells"), F.count_distinct("k").alias("symbols"), F.min("d").alias("first_day"), F.max("d").alias("last_day"))


_VALUE = f"""WITH {_T}, {_N}, {_DAILY}, c AS (SELECT k, d, sum(q) OVER (PARTITION BY k ORDER BY d) AS units FROM q), h AS (SELECT * FROM n WHERE k IN (SELECT k FROM t)),
spine AS (SELECT * FROM (SELECT DISTINCT d FROM h), (SELECT DISTINCT k FROM h)),
x AS (SELECT k, d, coalesce(last_value(units IGNORE NULLS) OVER w, 0) AS u, last_value(nav IGNORE NULLS) OVER w AS v FROM spine LEFT JOIN h USING (k, d) LEFT JOIN c USING (k, d) WINDOW w AS (PARTITION BY k ORDER BY d)),
value AS (SELECT d, sum(u * v) AS value FROM x WHERE v IS NOT NULL GROUP BY d HAVING sum(u * v) > 0)"""


@BOOK.add("w19_portfolio_value", f"{_VALUE} SELECT d, round(value, 2) AS value FROM value", dates="d")
def value(spark, sf_dir):
    return ops.value_series(trades(spark, sf_dir), nav(spark, sf_dir, "brand")).select("d", _r("value", 2).alias("value"))


_TWR = f"""WITH {_T}, {_N}, {_DAILY}, h AS (SELECT * FROM n WHERE k IN (SELECT k FROM t)),
rolled AS (SELECT q.k, h.d, sum(q.q) AS q, sum(q.q * h.nav) AS flow FROM q ASOF JOIN h ON q.k = h.k AND q.d <= h.d GROUP BY 1, 2),
spine AS (SELECT * FROM (SELECT DISTINCT d FROM h), (SELECT DISTINCT k FROM h)),
x AS (SELECT k, d, flow, coalesce(sum(q) OVER w, 0) AS u, last_value(nav IGNORE NULLS) OVER w AS v FROM spine LEFT JOIN h USING (k, d) LEFT JOIN rolled USING (k, d) WINDOW w AS (PARTITION BY k ORDER BY d)),
s AS (SELECT d, sum(u * v) AS value, coalesce(sum(flow), 0) AS flow FROM x GROUP BY d), y AS (SELECT *, lag(value) OVER (ORDER BY d) AS before FROM s)"""


@BOOK.add("w17_time_weighted_return", f"{_TWR} SELECT d, round(value, 2) AS value, round(flow, 2) AS flow, CASE WHEN value > 0 AND before > 0 THEN round((value - flow) / before - 1, 7) END AS r FROM y", dates="d")
def time_weighted(spark, sf_dir):
    rows = ops.time_weighted_returns(trades(spark, sf_dir), nav(spark, sf_dir, "brand"))
    return rows.select("d", _r("value", 2).alias("value"), _r("flow", 2).alias("flow"), _r("r", 7).alias("r"))


@BOOK.add("y3_portfolio_point", f"{_TWR}, z AS (SELECT (value - flow) / before - 1 AS r FROM y WHERE value > 0 AND before > 0) SELECT count(*) AS n, round(stddev_samp(r) * sqrt(252), 6) AS vol, round(avg(r) / stddev_samp(r) * sqrt(252), 6) AS sharpe FROM z")
def portfolio_point(spark, sf_dir):
    rows = ops.time_weighted_returns(trades(spark, sf_dir), nav(spark, sf_dir, "brand")).filter("r is not null")
    return rows.agg(F.count("*").alias("n"), _r(F.stddev_samp("r") * 252**0.5, 6).alias("vol"), _r(F.avg("r") / F.stddev_samp("r") * 252**0.5, 6).alias("sharpe"))


@BOOK.add("w18_clipped_return", f"{_VALUE}, f AS (SELECT d, sum(trade_value) AS flow FROM t GROUP BY d), b AS (SELECT d, value, flow, lag(value) OVER (ORDER BY d) AS before FROM value LEFT JOIN f USING (d)) SELECT d, round(least(greatest((value - before - coalesce(flow, 0)) / before, -0.15), 0.15), 7) AS r FROM b WHERE before IS NOT NULL", dates="d")
def clipped(spark, sf_dir):
    rows = trades(spark, sf_dir)
    flows = ops.signed(rows).groupBy("d").agg(F.sum("trade_value").alias("flow"))
    return ops.clipped_returns(ops.value_series(rows, nav(spark, sf_dir, "brand")), flows).select("d", _r("r", 7).alias("r"))


@BOOK.add(
    "a15_allocation",
    f"""WITH {_T}, {_N}, h AS (SELECT k, sum(trade_value) AS invested, sum(signed_qty) AS units FROM t GROUP BY k HAVING sum(signed_qty) > 0), l AS (SELECT k, arg_max(nav, d) AS latest FROM n GROUP BY k), v AS (SELECT *, units * latest AS value FROM h JOIN l USING (k))
SELECT k, round(invested, 2) AS invested, round(units, 3) AS units, round(latest, 4) AS latest, round(value, 2) AS value, round(value - invested, 2) AS pnl, round(100 * (value - invested) / abs(invested), 3) AS pnl_pct, round(100 * value / sum(value) OVER (), 3) AS share FROM v""",
)
def allocation(spark, sf_dir):
    rows = ops.allocation(trades(spark, sf_dir), nav(spark, sf_dir, "brand"))
    return rows.select("k", *(_r(c, n).alias(c) for c, n in (("invested", 2), ("units", 3), ("latest", 4), ("value", 2), ("pnl", 2), ("pnl_pct", 3), ("share", 3))))


@BOOK.add(
    "j8_deposit_growth",
    f"WITH {_T}, {_N}, f AS (SELECT d, sum(trade_value) AS flow FROM t GROUP BY d), days AS (SELECT DISTINCT d FROM n WHERE day(d) = 1) SELECT days.d, round(sum(f.flow * pow(1.065, (days.d - f.d) / 365.25)), 1) AS value FROM days JOIN f ON f.d <= days.d GROUP BY days.d",
    dates="d",
)
def deposit(spark, sf_dir):
    flows = ops.signed(trades(spark, sf_dir)).groupBy("d").agg(F.sum("trade_value").alias("flow"))
    days = nav(spark, sf_dir, "brand").select("d").distinct().filter(F.dayofmonth("d") == 1)
    first = flows.agg(F.min("d").alias("first"))
    grown = ops.deposit_growth(flows, days).crossJoin(F.broadcast(first))  # one row
    return grown.filter("d >= first").select("d", _r("value", 1).alias("value"))


@BOOK.add("w24_invested_so_far", f"WITH {_T}, f AS (SELECT d, sum(trade_value) AS flow FROM t GROUP BY d) SELECT d, round(sum(flow) OVER (ORDER BY d) + 1e6 * {NUDGE}, 2) AS invested FROM f", dates="d")
def invested(spark, sf_dir):
    from pyspark.sql import Window

    flows = ops.signed(trades(spark, sf_dir)).groupBy("d").agg(F.sum("trade_value").alias("flow"))
    return flows.select("d", _r(F.sum("flow").over(Window.orderBy("d")) + 1e6 * NUDGE, 2).alias("invested"))


@BOOK.add(
    "y5_index_replica",
    f"""WITH {_T}, m AS (SELECT max(d) AS d, arg_max(nav, d) AS nav FROM ({nav_sql("flag")}) WHERE k = 'N' GROUP BY date_trunc('week', d)), f AS (SELECT d, sum(trade_value) AS flow FROM t GROUP BY d),
b AS (SELECT f.*, m.d AS bd, m.nav AS bn FROM f ASOF LEFT JOIN m ON f.d >= m.d), c AS (SELECT b.*, m.d AS fd, m.nav AS fn FROM b ASOF LEFT JOIN m ON b.d <= m.d),
u AS (SELECT d, flow / CASE WHEN fd IS NULL OR d - bd <= fd - d THEN bn ELSE coalesce(fn, bn) END AS units FROM c), s AS (SELECT d, sum(units) OVER (ORDER BY d) AS units FROM u)
SELECT s.d, round(s.units * m.nav, 2) AS value FROM s ASOF JOIN m ON s.d >= m.d""",
    dates="d",
)
def replica(spark, sf_dir):
    from pyspark.sql import Window

    from tidemark.operators.series import asof, weekly

    market = weekly(nav(spark, sf_dir, "flag").filter("k = 'N'"))
    flows = ops.signed(trades(spark, sf_dir)).groupBy("d").agg(F.sum("trade_value").alias("flow")).withColumn("k", F.lit("N"))
    bought = asof(flows, market, "nav", "nearest").select("k", "d", (F.col("flow") / F.col("nav")).alias("u"))
    held = bought.select("k", "d", F.sum("u").over(Window.partitionBy("k").orderBy("d")).alias("units"))
    return asof(held, market, "nav", "backward").filter("nav is not null").select("d", _r(F.col("units") * F.col("nav"), 2).alias("value"))


@BOOK.add("y9_complete_cases", f"WITH {_N}, r AS (SELECT k, d, nav / lag(nav) OVER (PARTITION BY k ORDER BY d) - 1 AS r FROM n), c AS (SELECT d FROM r WHERE r IS NOT NULL GROUP BY d HAVING count(*) = (SELECT count(DISTINCT k) FROM n)) SELECT k, d, round(r + {NUDGE}, 8) AS r FROM r WHERE d IN (SELECT d FROM c)", dates="d")
def complete_cases(spark, sf_dir):
    from tidemark.operators.series import growth

    rows = nav(spark, sf_dir, "brand").withColumn("r", growth("nav"))
    funds = rows.select("k").distinct().agg(F.count("*").alias("n"))
    full = rows.filter("r is not null").groupBy("d").agg(F.count("*").alias("n")).join(F.broadcast(funds), "n").select("d")  # one row
    return rows.join(full, "d", "left_semi").select("k", "d", _r(F.col("r") + NUDGE, 8).alias("r"))
