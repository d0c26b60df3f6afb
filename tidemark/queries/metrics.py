"""Queries of the risk and return metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import metrics as ops
from tidemark.operators.series import correlation, growth
from tidemark.plans.relations import nav, nav_sql
from tidemark.queries.book import Book

BOOK = Book()
_W = "OVER (PARTITION BY k ORDER BY d)"
_RUN = "OVER (PARTITION BY k ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_DAILY = (1 + ops.RISK_FREE / 252) ** (1 / 252) - 1

_MARKED = f"""nav AS ({{}}), a AS (
  SELECT k, d, nav, nav / lag(nav) {_W} - 1 AS r, row_number() OVER (PARTITION BY k ORDER BY d DESC) AS back,
    {", ".join(f"CASE WHEN lag(nav, {252 * y}) {_W} > 0 AND nav > 0 THEN pow(nav / lag(nav, {252 * y}) {_W}, 1.0 / {y}) - 1 END AS g{y}" for y in (1, 3, 5))} FROM nav
), b AS (SELECT *, CASE WHEN abs(r) <= 1 THEN r END AS all_r FROM a
), c AS (SELECT *, CASE WHEN count(all_r) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) < 252 THEN all_r END AS q, CASE WHEN count(all_r) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) < 756 THEN all_r END AS q3 FROM b
), e AS (SELECT *, CASE WHEN q IS NOT NULL THEN exp(sum(ln(1 + q)) {_RUN}) END AS grown, exp(coalesce(sum(ln(1 + all_r)) {_RUN}, 0)) AS every FROM c
), m AS (SELECT *, grown / greatest(1.0, max(grown) {_RUN}) - 1 AS dd, every / greatest(1.0, max(every) {_RUN}) - 1 AS dd_all FROM e)"""


def _at(n: int) -> str:
    return f"max(CASE WHEN back = {n + 1} THEN nav END)"


_RATIO = "(count(*) FILTER (WHERE q > 0) * 1.0 / nullif(count(*) FILTER (WHERE q <> 0), 0))"
_PAYOFF = "abs(avg(q) FILTER (WHERE q > 0) / nullif(avg(q) FILTER (WHERE q < 0), 0))"
_METRICS = {
    **{f"cagr_{y}y": f"pow({_at(0)} / {_at(252 * y)}, 1.0 / {y}) - 1" for y in (1, 3, 5, 10)},
    "vol_3y": "stddev_samp(q3) * sqrt(252)",
    "sharpe_3y": f"(avg(q3) - {_DAILY!r}) / stddev_samp(q3) * sqrt(252)",
    "sortino_3y": f"(avg(q3) - {_DAILY!r}) / sqrt(avg(pow(least(q3 - {_DAILY!r}, 0), 2)) FILTER (WHERE q3 IS NOT NULL)) * sqrt(252)",
    "vol_1y": "stddev_samp(q) * sqrt(252)",
    "downside_vol_1y": "stddev_samp(q) FILTER (WHERE q < 0) * sqrt(252)",
    "sharpe_1y": f"(avg(q) - {_DAILY!r}) / stddev_samp(q) * sqrt(252)",
    "sortino_1y": f"(avg(q) - {_DAILY!r}) / sqrt(avg(pow(least(q - {_DAILY!r}, 0), 2)) FILTER (WHERE q IS NOT NULL)) * sqrt(252)",
    "calmar_1y": "(pow(exp(sum(ln(1 + q))), 252.0 / count(q)) - 1) / abs(nullif(min(dd), 0))",
    "gain_to_pain_1y": "sum(q) / abs(sum(q) FILTER (WHERE q < 0))",
    "max_dd_1y": "min(dd)",
    "max_dd_all": "min(dd_all)",
    "cumulative_return_1y": "exp(sum(ln(1 + q))) - 1",
    "avg_daily_return_1y": "avg(q)",
    "win_rate_1y": "count(*) FILTER (WHERE q > 0) * 1.0 / count(q)",
    "best_day_1y": "max(q)",
    "worst_day_1y": "min(q)",
    "var_95_1y": f"avg(q) - {ops.QUANTILE} * stddev_samp(q)",
    "skew_1y": "skewness(q)",
    "kurt_1y": "kurtosis(q)",
    "kelly_1y": f"({_PAYOFF} * {_RATIO} - (1 - {_RATIO})) / {_PAYOFF}",
    "avg_win_1y": "avg(q) FILTER (WHERE q > 0)",
    "avg_loss_1y": "avg(q) FILTER (WHERE q < 0)",
    "payoff_1y": _PAYOFF,
    "pct_from_ath": f"{_at(0)} / max(nav) - 1",
    **{f"rolling_{y}y_{n}": f"{f}(g{y})" for y in (1, 3, 5) for n, f in (("min", "min"), ("median", "median"), ("mean", "avg"), ("max", "max"))},
    **{f"abs_return_{n}": f"{_at(0)} / {_at(m)} - 1" for n, m in (("3m", 63), ("6m", 126), ("1y", 252))},
}


#: The metrics by brand, for queries that join them.
ORACLE_METRICS = f"""WITH {_MARKED.format(nav_sql("brand"))}
SELECT k, {", ".join(f"round({_METRICS[name]}, 6) AS {name}" for name in ("cagr_1y", "sharpe_1y", "max_dd_1y"))}, min(d) AS inception_date FROM m GROUP BY k HAVING count(*) >= 252"""


def _rounded(df, digits: int = 6):
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@BOOK.add(
    "m_scheme_metrics",
    f"""WITH {_MARKED.format(nav_sql("region"))}
SELECT k, {", ".join(f"round({sql}, 6) AS {name}" for name, sql in _METRICS.items())}, min(d) AS inception_date, round(arg_max(nav, d), 6) AS last_nav, max(d) AS last_nav_date, count(*) AS history_days
FROM m GROUP BY k HAVING count(*) >= 252""",
    dates="inception_date last_nav_date",
)
def scheme_metrics(spark, sf_dir):
    return _rounded(ops.scheme_metrics(nav(spark, sf_dir, "region")))


@BOOK.add(
    "m_scheme_metrics_by_brand",
    f"""WITH {_MARKED.format(nav_sql("brand"))}
SELECT k, {", ".join(f"round({sql}, 6) AS {name}" for name, sql in _METRICS.items())}, min(d) AS inception_date, round(arg_max(nav, d), 6) AS last_nav, max(d) AS last_nav_date, count(*) AS history_days
FROM m GROUP BY k HAVING count(*) >= 252""",
    dates="inception_date last_nav_date",
)
def scheme_metrics_by_brand(spark, sf_dir):
    return _rounded(ops.scheme_metrics(nav(spark, sf_dir, "brand")))


@BOOK.add(
    "m13_cvar",
    f"""WITH {_MARKED.format(nav_sql("region"))}, v AS (SELECT k, avg(q) - {ops.QUANTILE} * stddev_samp(q) AS v FROM m GROUP BY k)
SELECT m.k, round(v.v, 7) AS var_95_1y, round(coalesce(avg(q) FILTER (WHERE q < v.v), v.v), 7) AS cvar_95_1y FROM m JOIN v ON m.k = v.k WHERE q IS NOT NULL GROUP BY m.k, v.v""",
)
def cvar(spark, sf_dir):
    return _rounded(ops.tail_mean(nav(spark, sf_dir, "region")), 7)


_RETURNS = f"nav AS ({nav_sql('brand')}), r AS (SELECT k, d, nav / lag(nav) {_W} - 1 AS r FROM nav), bnav AS ({nav_sql('flag')}), br AS (SELECT k AS b, d, nav / lag(nav) {_W} - 1 AS br FROM bnav)"


def _returns(spark, sf_dir):
    funds = nav(spark, sf_dir, "brand").select("k", "d", growth("nav").alias("r"))
    return funds, nav(spark, sf_dir, "flag").select(F.col("k").alias("b"), "d", growth("nav").alias("br"))


@BOOK.add(
    "m21_capm",
    f"""WITH {_RETURNS} SELECT k, b, round(covar_samp(r, br) / var_samp(br), 6) AS beta, round((avg(r) - covar_samp(r, br) / var_samp(br) * avg(br)) * 252, 6) AS alpha,
  round(pow(corr(r, br), 2), 6) AS r2, round(stddev_samp(r - br) * sqrt(252), 6) AS tracking_error
FROM r JOIN br USING (d) WHERE r IS NOT NULL AND br IS NOT NULL GROUP BY k, b HAVING count(*) >= 60""",
)
def capm(spark, sf_dir):
    return _rounded(ops.capm(*_returns(spark, sf_dir)))


@BOOK.add(
    "j12_excess_and_downside",
    f"""WITH {_RETURNS} SELECT k, b, round(avg(r - br), 8) AS excess, round(corr(r, br) FILTER (WHERE br < 0), 6) AS down_corr, count(*) FILTER (WHERE br < 0) AS down_days
FROM r JOIN br USING (d) WHERE r IS NOT NULL AND br IS NOT NULL GROUP BY k, b""",
)
def excess_and_downside(spark, sf_dir):
    funds, market = _returns(spark, sf_dir)
    both = funds.join(market, "d").filter("r is not null and br is not null")
    down = F.col("br") < 0
    both = both.withColumn("dr", F.when(down, F.col("r"))).withColumn("dbr", F.when(down, F.col("br")))
    return both.groupBy("k", "b").agg(F.round(F.avg(F.col("r") - F.col("br")), 8).alias("excess"), F.round(correlation("dr", "dbr"), 6).alias("down_corr"), F.count_if(down).alias("down_days"))


@BOOK.add(
    "m24_stock_metrics",
    f"""WITH {_RETURNS}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d DESC) AS back FROM r WHERE r IS NOT NULL) WHERE back <= 252),
s AS (SELECT k, 100 * stddev_samp(r) * sqrt(252) AS vol, 100 * (exp(sum(ln(1 + r))) - 1) AS gain FROM last GROUP BY k HAVING count(*) >= 60),
c AS (SELECT k, covar_samp(r, br) / var_samp(br) AS beta, 100 * (avg(r) - covar_samp(r, br) / var_samp(br) * avg(br)) * 252 AS alpha FROM r JOIN br USING (d) WHERE b = 'N' AND r IS NOT NULL AND br IS NOT NULL GROUP BY k HAVING count(*) >= 60)
SELECT k, round(vol, 5) AS vol, round(gain, 5) AS gain, round(beta, 6) AS beta, round(alpha, 5) AS alpha,
  CASE WHEN alpha > 0 AND beta >= 1 THEN 'aggressive outperformer' WHEN alpha > 0 THEN 'defensive outperformer' WHEN beta >= 1 THEN 'aggressive underperformer' WHEN alpha IS NOT NULL THEN 'defensive underperformer' ELSE 'unknown' END AS class
FROM s LEFT JOIN c USING (k)""",
)
def stock_metrics(spark, sf_dir):
    from pyspark.sql import Window

    from tidemark.functions.text import alpha_class

    funds, market = _returns(spark, sf_dir)
    last = funds.filter("r is not null").withColumn("back", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("d")))).filter("back <= 252")
    stats = last.groupBy("k").agg(F.count("*").alias("n"), (100 * F.stddev_samp("r") * ops.ROOT).alias("vol"), (100 * (F.exp(F.sum(F.log1p("r"))) - 1)).alias("gain")).filter("n >= 60").drop("n")
    fit = ops.capm(funds, market.filter("b = 'N'")).select("k", "beta", (100 * F.col("alpha")).alias("alpha"))
    rows = stats.join(fit, "k", "left").withColumn("class", alpha_class("alpha", "beta"))
    return rows.select("k", F.round("vol", 5).alias("vol"), F.round("gain", 5).alias("gain"), F.round("beta", 6).alias("beta"), F.round("alpha", 5).alias("alpha"), "class")


@BOOK.add(
    "m25_monthly_returns",
    f"""WITH nav AS ({nav_sql("region")}), r AS (SELECT k, d, nav / lag(nav) {_W} - 1 AS r FROM nav)
SELECT k, year(d) AS year, {", ".join(f"round(exp(sum(ln(1 + r)) FILTER (WHERE month(d) = {m})) - 1, 7) AS m{m}" for m in range(1, 13))}, round(exp(sum(ln(1 + r))) - 1, 7) AS eoy FROM r GROUP BY 1, 2""",
)
def monthly_returns(spark, sf_dir):
    rows = nav(spark, sf_dir, "region").withColumn("r", F.log1p(growth("nav"))).withColumn("m", F.month("d"))
    return rows.groupBy("k", F.year("d").cast("long").alias("year")).agg(*(F.round(F.exp(F.sum(F.when(F.col("m") == m, F.col("r")))) - 1, 7).alias(f"m{m}") for m in range(1, 13)), F.round(F.exp(F.sum("r")) - 1, 7).alias("eoy"))


@BOOK.add(
    "a27_quadrants",
    f"""WITH nav AS ({nav_sql("brand")}), r AS (SELECT k, d, nav, nav / lag(nav) {_W} - 1 AS r FROM nav), p AS (SELECT k, stddev_samp(r) AS risk, arg_max(nav, d) / arg_min(nav, d) - 1 AS gain FROM r GROUP BY k),
q AS (SELECT median(risk) AS mr, median(gain) AS mg FROM p) SELECT (CASE WHEN gain >= mg THEN 'high' ELSE 'low' END) || ' return, ' || (CASE WHEN risk >= mr THEN 'high' ELSE 'low' END) || ' risk' AS quadrant, count(*) AS n FROM p, q GROUP BY 1""",
)
def quadrants(spark, sf_dir):
    rows = nav(spark, sf_dir, "brand").withColumn("r", growth("nav"))
    points = rows.groupBy("k").agg(F.stddev_samp("r").alias("risk"), (F.max_by("nav", "d") / F.min_by("nav", "d") - 1).alias("gain"))
    middle = points.agg(F.median("risk").alias("mr"), F.median("gain").alias("mg"))
    side = lambda a, b: F.when(F.col(a) >= F.col(b), "high").otherwise("low")
    label = F.concat(side("gain", "mg"), F.lit(" return, "), side("risk", "mr"), F.lit(" risk"))
    return points.crossJoin(F.broadcast(middle)).groupBy(label.alias("quadrant")).agg(F.count("*").alias("n"))  # one row of medians
