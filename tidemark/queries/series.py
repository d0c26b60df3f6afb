"""Queries of the series operators (windows, as-of joins, resampling)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.dates import month_start, week_end
from tidemark.operators import series as ops
from tidemark.operators.series import annual_growth, correlation, densify, drawdown, forward_filled, full_window, growth, last_rows, ordered
from tidemark.plans.relations import BARS_SQL, TRADES_SQL, bars, keyed_lines, nav, nav_sql, trades
from tidemark.queries.book import Book

BOOK = Book()
_W = "OVER (PARTITION BY k ORDER BY d)"
#: Added before rounding, so that short decimals never lie on a rounding edge.
_NUDGE = 0.3137e-8


@BOOK.add("w1_daily_return", f"WITH nav AS ({nav_sql('brand')}) SELECT k, d, round(nav / lag(nav) {_W} - 1, 8) AS r FROM nav", dates="d")
def daily_return(spark, sf_dir):
    return nav(spark, sf_dir, "brand").select("k", "d", F.round(growth("nav"), 8).alias("r"))


@BOOK.add(
    "w2_spine_return",
    f"""WITH nav AS ({nav_sql("brand")}), spine AS (SELECT * FROM (SELECT DISTINCT d FROM nav), (SELECT DISTINCT k FROM nav))
SELECT k, d, round(nav / lag(nav, 5) {_W} - 1 + {_NUDGE}, 8) AS r5 FROM spine LEFT JOIN nav USING (k, d)""", dates="d"
)
def spine_return(spark, sf_dir):
    return densify(nav(spark, sf_dir, "brand")).select("k", "d", F.round(growth("nav", 5) + _NUDGE, 8).alias("r5"))


@BOOK.add(
    "w5_rolling_cagr",
    f"""WITH nav AS ({nav_sql("brand")}), g AS (SELECT k, d, CASE WHEN lag(nav, 252) {_W} > 0 AND nav > 0 THEN pow(nav / lag(nav, 252) {_W}, 1.0) - 1 END AS g1,
  CASE WHEN lag(nav, 756) {_W} > 0 AND nav > 0 THEN pow(nav / lag(nav, 756) {_W}, 252.0 / 756) - 1 END AS g3,
  CASE WHEN lag(nav, 1260) {_W} > 0 AND nav > 0 THEN pow(nav / lag(nav, 1260) {_W}, 252.0 / 1260) - 1 END AS g5 FROM nav)
SELECT k, d, round(g1, 7) AS g1, round(g3, 7) AS g3, round(g5, 7) AS g5 FROM g""", dates="d"
)
def rolling_cagr(spark, sf_dir):
    return nav(spark, sf_dir, "brand").select("k", "d", F.round(annual_growth("nav", 252), 7).alias("g1"), F.round(annual_growth("nav", 756), 7).alias("g3"), F.round(annual_growth("nav", 1260), 7).alias("g5"))


@BOOK.add(
    "a19_rolling_summary",
    f"""WITH nav AS ({nav_sql("brand")}), spine AS (SELECT * FROM (SELECT DISTINCT d FROM nav), (SELECT DISTINCT k FROM nav)),
r AS (SELECT k, d, nav / lag(nav, 20) {_W} - 1 AS r FROM spine LEFT JOIN nav USING (k, d))
SELECT k, round(100 * avg(r), 2) AS mean, round(100 * min(r), 2) AS min, round(100 * max(r), 2) AS max,
       round(100 * arg_max(CASE WHEN r IS NULL THEN [] ELSE [r] END, d)[1], 2) AS latest, count(r) AS n FROM r GROUP BY k""",
)
def rolling_summary(spark, sf_dir):
    rows = densify(nav(spark, sf_dir, "brand")).withColumn("r", growth("nav", 20))
    pct = lambda c: F.round(100 * c, 2)
    return rows.groupBy("k").agg(pct(F.avg("r")).alias("mean"), pct(F.min("r")).alias("min"), pct(F.max("r")).alias("max"), pct(F.max_by(F.struct("r"), "d")["r"]).alias("latest"), F.count("r").alias("n"))


@BOOK.add(
    "w12_drawdown",
    f"""WITH nav AS ({nav_sql("brand")}), dd AS (SELECT k, d, nav / max(nav) {_W} - 1 AS dd FROM nav)
SELECT k, round(min(dd), 8) AS max_dd, min(d) FILTER (WHERE dd = low) AS max_dd_date, round(arg_max(dd, d), 8) AS current_dd
FROM (SELECT *, min(dd) OVER (PARTITION BY k) AS low FROM dd) GROUP BY k""", dates="max_dd_date"
)
def drawdowns(spark, sf_dir):
    rows = nav(spark, sf_dir, "brand").withColumn("dd", drawdown("nav"))
    return rows.groupBy("k").agg(F.round(F.min("dd"), 8).alias("max_dd"), F.min_by("d", F.struct("dd", "d")).alias("max_dd_date"), F.round(F.max_by("dd", "d"), 8).alias("current_dd"))


@BOOK.add(
    "w13_rebased_growth",
    f"""WITH fund AS ({nav_sql("brand")}), base AS ({nav_sql("flag")}), on_axis AS (
  SELECT f.k, f.d, f.nav, last_value(b.nav IGNORE NULLS) OVER (PARTITION BY f.k ORDER BY f.d) AS v FROM fund AS f LEFT JOIN (SELECT d, nav FROM base WHERE k = 'N') AS b USING (d)
), filled AS (SELECT k, d, nav, coalesce(v, first_value(v IGNORE NULLS) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM on_axis)
SELECT k, d, round(100 * nav / first_value(nav) {_W}, 6) AS fund, round(100 * v / first_value(v) {_W}, 6) AS benchmark FROM filled""", dates="d"
)
def rebased(spark, sf_dir):
    base = nav(spark, sf_dir, "flag").filter("k = 'N'").select("d", F.col("nav").alias("b"))
    rows = nav(spark, sf_dir, "brand").join(base, "d", "left").withColumn("v", forward_filled("b"))
    rows = rows.withColumn("v", F.coalesce("v", F.first("v", ignorenulls=True).over(ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    rebase = lambda c: F.round(100 * F.col(c) / F.first(c).over(ordered()), 6)
    return rows.select("k", "d", rebase("nav").alias("fund"), rebase("v").alias("benchmark"))


_LAST = "OVER (PARTITION BY k ORDER BY d ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


@BOOK.add(
    "w15_rolling_risk",
    f"""WITH nav AS ({nav_sql("brand")}), r AS (SELECT k, d, nav / lag(nav) {_W} - 1 AS r FROM nav)
SELECT k, d, CASE WHEN count(r) {_LAST.format(29)} = 30 THEN round(stddev_samp(r) {_LAST.format(29)} * sqrt(252), 6) END AS vol_30,
  CASE WHEN count(r) {_LAST.format(59)} = 60 THEN round(avg(r) {_LAST.format(59)} / stddev_samp(r) {_LAST.format(59)} * sqrt(252), 6) END AS sharpe_60 FROM r""", dates="d"
)
def rolling_risk(spark, sf_dir):
    rows = nav(spark, sf_dir, "brand").withColumn("r", growth("nav"))
    vol = F.stddev_samp("r").over(last_rows(30)) * F.sqrt(F.lit(252.0))
    sharpe = F.try_divide(F.avg("r").over(last_rows(60)), F.stddev_samp("r").over(last_rows(60))) * F.sqrt(F.lit(252.0))
    return rows.select("k", "d", F.round(full_window(vol, 30, "r"), 6).alias("vol_30"), F.round(full_window(sharpe, 60, "r"), 6).alias("sharpe_60"))


@BOOK.add(
    "w16_rolling_correlation",
    f"""WITH nav AS ({nav_sql("region")}), r AS (SELECT k, d, nav / lag(nav) {_W} - 1 AS r FROM nav),
p AS (SELECT a.k, a.d, a.r AS x, b.r AS y FROM r AS a JOIN r AS b ON a.d = b.d AND b.k = 'ASIA' WHERE a.k <> 'ASIA')
SELECT k, d, {", ".join(f"CASE WHEN count(x + y) {_LAST.format(n - 1)} = {n} THEN round(corr(x, y) {_LAST.format(n - 1)}, 6) END AS corr_{n}" for n in (60, 90, 180, 252))} FROM p""", dates="d"
)
def rolling_correlation(spark, sf_dir):
    rows = nav(spark, sf_dir, "region").withColumn("r", growth("nav"))
    other = rows.filter("k = 'ASIA'").select("d", F.col("r").alias("y"))
    pairs = rows.filter("k <> 'ASIA'").select("k", "d", F.col("r").alias("x")).join(other, "d").withColumn("both", F.col("x") + F.col("y"))
    return pairs.select("k", "d", *(F.round(full_window(correlation("x", "y", last_rows(n)), n, "both"), 6).alias(f"corr_{n}") for n in (60, 90, 180, 252)))


@BOOK.add(
    "w20_pareto_frontier",
    f"""WITH nav AS ({nav_sql("brand")}), r AS (SELECT k, d, nav, nav / lag(nav) {_W} - 1 AS r FROM nav),
p AS (SELECT k, stddev_samp(r) AS risk, arg_max(nav, d) / arg_min(nav, d) - 1 AS gain FROM r GROUP BY k),
f AS (SELECT *, max(gain) OVER (ORDER BY risk, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM p), kept AS (SELECT * FROM f WHERE best IS NULL OR gain > best)
SELECT k, round(risk, 7) AS risk, round(gain, 7) AS gain FROM kept WHERE (SELECT count(*) FROM kept) >= 2""",
)
def pareto(spark, sf_dir):
    rows = nav(spark, sf_dir, "brand").withColumn("r", growth("nav"))
    points = rows.groupBy("k").agg(F.stddev_samp("r").alias("risk"), (F.max_by("nav", "d") / F.min_by("nav", "d") - 1).alias("gain"))
    best = F.max("gain").over(Window.orderBy("risk", "k").rowsBetween(Window.unboundedPreceding, -1))  # one row a fund
    kept = points.withColumn("best", best).filter("best is null or gain > best")
    return kept.withColumn("n", F.count("*").over(Window.partitionBy())).filter("n >= 2").select("k", F.round("risk", 7).alias("risk"), F.round("gain", 7).alias("gain"))


@BOOK.add(
    "w25_lag_features",
    f"""WITH nav AS ({nav_sql("brand")}), r AS (SELECT *, nav / lag(nav) {_W} - 1 AS r, ln(nav / lag(nav) {_W}) AS lr FROM nav)
SELECT k, d, {", ".join(f"round(lag(nav, {n}) {_W} + 100 * {_NUDGE}, 6) AS lag_{n}" for n in (1, 5, 7, 10, 15))}, round(avg(nav) {_LAST.format(4)} + 100 * {_NUDGE}, 6) AS mean_5, round(avg(nav) {_LAST.format(9)} + 100 * {_NUDGE}, 6) AS mean_10,
  CASE WHEN count(lr) {_LAST.format(9)} = 10 THEN round(stddev_samp(lr) {_LAST.format(9)}, 7) END AS log_vol_10,
  CASE WHEN count(r) {_LAST.format(13)} = 14 THEN round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) {_LAST.format(13)}, 6) END AS up_share_14 FROM r""", dates="d"
)
def lag_features(spark, sf_dir):
    rows = nav(spark, sf_dir, "brand").withColumn("r", growth("nav")).withColumn("lr", F.log(F.col("nav") / F.lag("nav").over(ordered())))
    return rows.select(
        "k", "d", *(F.round(F.lag("nav", n).over(ordered()) + 100 * _NUDGE, 6).alias(f"lag_{n}") for n in (1, 5, 7, 10, 15)), *(F.round(F.avg("nav").over(last_rows(n)) + 100 * _NUDGE, 6).alias(f"mean_{n}") for n in (5, 10)),
        F.round(full_window(F.stddev_samp("lr").over(last_rows(10)), 10, "lr"), 7).alias("log_vol_10"),
        F.round(full_window(F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)).over(last_rows(14)), 14, "r"), 6).alias("up_share_14"),
    )


@BOOK.add(
    "w26_imputation",
    f"""WITH nav AS ({nav_sql("brand")}), holes AS (SELECT k, d, CASE WHEN day(d) % 7 <> 0 THEN nav END AS v FROM nav)
SELECT k, d, round(coalesce(v, avg(v) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), avg(v) OVER (PARTITION BY k), 0) + 100 * {_NUDGE}, 6) AS v FROM holes""", dates="d"
)
def imputation(spark, sf_dir):
    rows = nav(spark, sf_dir, "brand").select("k", "d", F.when(F.dayofmonth("d") % 7 != 0, F.col("nav")).alias("v"))
    near = F.avg("v").over(ordered().rowsBetween(-1, 1))
    return rows.select("k", "d", F.round(F.coalesce("v", near, F.avg("v").over(Window.partitionBy("k")), F.lit(0.0)) + 100 * _NUDGE, 6).alias("v"))


@BOOK.add(
    "w27_sequences",
    f"""WITH nav AS ({nav_sql("region")}), s AS (SELECT k, d, list(round(nav, 4)) OVER (PARTITION BY k ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS s, row_number() {_W} AS n FROM nav)
SELECT k, d, array_to_string(list_transform(s, lambda x: CAST(CAST(round(x * 10000) AS BIGINT) AS VARCHAR)), ',') AS sequence FROM s WHERE n > 5""", dates="d"
)
def sequences(spark, sf_dir):
    rows = nav(spark, sf_dir, "region").withColumn("n", F.row_number().over(ordered()))
    items = F.collect_list(F.round("nav", 4)).over(ordered().rowsBetween(-5, -1))
    text = F.array_join(F.transform(items, lambda x: F.round(x * 10000).cast("long").cast("string")), ",")
    return rows.withColumn("sequence", text).filter("n > 5").select("k", "d", "sequence")


#: The last value of each week, on its own day: a series with gaps.
_WEEKLY = "SELECT k, max(d) AS d, arg_max(nav, d) AS nav FROM ({}) GROUP BY k, date_trunc('week', d)"
_SALES = f"SELECT k, d, sum(CAST(round(CASE WHEN lower(side) = 'buy' THEN qty ELSE -qty END * 100000) AS BIGINT))::BIGINT AS qty FROM ({TRADES_SQL}) GROUP BY k, d"


def _sales(spark, sf_dir):
    return trades(spark, sf_dir).groupBy("k", "d").agg(F.sum(F.round(F.when(F.lower("side") == "buy", F.col("qty")).otherwise(-F.col("qty")) * 100000).cast("long")).alias("qty"))


for _name, _how, _sql in (
    ("j5_asof_backward", "backward", "SELECT t.k, t.d, t.qty, n.d AS matched, n.nav FROM t ASOF LEFT JOIN n ON t.k = n.k AND t.d >= n.d"),
    ("j7_asof_forward", "forward", "SELECT t.k, t.d, t.qty, n.d AS matched, n.nav FROM t ASOF LEFT JOIN n ON t.k = n.k AND t.d <= n.d"),
    (
        "j6_asof_nearest",
        "nearest",
        """SELECT k, d, qty, CASE WHEN fd IS NULL OR d - bd <= fd - d THEN bd ELSE fd END AS matched, CASE WHEN fd IS NULL OR d - bd <= fd - d THEN bn ELSE fn END AS nav
FROM (SELECT b.*, n.d AS fd, n.nav AS fn FROM (SELECT t.*, n.d AS bd, n.nav AS bn FROM t ASOF LEFT JOIN n ON t.k = n.k AND t.d >= n.d) AS b ASOF LEFT JOIN n ON b.k = n.k AND b.d <= n.d)""",
    ),
):

    @BOOK.add(_name, f"WITH n AS ({_WEEKLY.format(nav_sql('brand'))}), t AS ({_SALES}) {_sql}", dates="d matched")
    def asof(spark, sf_dir, how=_how):
        return ops.asof(_sales(spark, sf_dir), ops.weekly(nav(spark, sf_dir, "brand")), "nav", how).select("k", "d", "qty", "matched", "nav")


@BOOK.add(
    "a22_correlation_matrix",
    f"""WITH nav AS ({nav_sql("brand")}), r AS (SELECT k, d, nav / lag(nav) {_W} - 1 AS r FROM nav)
SELECT a.k AS a, b.k AS b, round(CASE WHEN count(*) >= 30 THEN coalesce(corr(a.r, b.r), 0) ELSE 0 END, 6) AS corr FROM r AS a JOIN r AS b USING (d) WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2""",
)
def correlation_matrix(spark, sf_dir):
    returns = nav(spark, sf_dir, "brand").withColumn("r", growth("nav"))
    return ops.correlation_pairs(returns, "r", 30).select("a", "b", F.round("corr", 6).alias("corr"))


@BOOK.add(
    "o7_top_pair",
    f"""WITH nav AS ({nav_sql("brand")}), r AS (SELECT k, d, nav / lag(nav) {_W} - 1 AS r FROM nav)
SELECT a, b, corr FROM (SELECT a.k AS a, b.k AS b, round(corr(a.r, b.r), 6) AS corr FROM r AS a JOIN r AS b USING (d) WHERE a.k < b.k AND a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 30) ORDER BY corr DESC, a, b LIMIT 1""",
)
def top_pair(spark, sf_dir):
    returns = nav(spark, sf_dir, "brand").withColumn("r", growth("nav"))
    pairs = ops.correlation_pairs(returns, "r", 30).filter("a < b").select("a", "b", F.round("corr", 6).alias("corr"))
    return pairs.orderBy(F.desc("corr"), "a", "b").limit(1)


for _name, _label, _period in (("f26_weekly_bars", "d + (7 - isodow(d))::INT", week_end), ("f26_monthly_bars", "date_trunc('month', d)::DATE", month_start)):

    @BOOK.add(_name, f"WITH bars AS ({BARS_SQL}) SELECT k, {_label} AS period, arg_min(open, d) AS open, max(high) AS high, min(low) AS low, arg_max(close, d) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2", dates="period")
    def resampled(spark, sf_dir, period=_period):
        rows = bars(spark, sf_dir).withColumn("period", period("d"))
        return rows.groupBy("k", "period").agg(F.min_by("open", "d").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "d").alias("close"), F.sum("volume").alias("volume"))


@BOOK.add(
    "f25_month_end_returns",
    f"""WITH nav AS ({nav_sql("brand")}), m AS (SELECT k, last_day(d) AS month, arg_max(nav, d) AS v FROM nav GROUP BY 1, 2),
spine AS (SELECT k, last_day(CAST(unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS DATE)) AS month FROM (SELECT k, min(d) AS a, max(d) AS b FROM nav GROUP BY k))
SELECT k, month, round(v / lag(v) OVER (PARTITION BY k ORDER BY month) - 1, 8) AS r FROM spine LEFT JOIN m USING (k, month)""", dates="month"
)
def month_ends(spark, sf_dir):
    series = nav(spark, sf_dir, "brand")
    ends = series.groupBy("k", F.last_day("d").alias("month")).agg(F.max_by("nav", "d").alias("v"))
    months = series.groupBy("k").agg(F.trunc(F.min("d"), "MM").alias("a"), F.trunc(F.max("d"), "MM").alias("b"))
    spine = months.select("k", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month")).withColumn("month", F.last_day("month"))
    return spine.join(ends, ["k", "month"], "left").select("k", "month", F.round(growth("v", day="month"), 8).alias("r"))


@BOOK.add(
    "a30_calendar_pivot",
    f"WITH nav AS ({nav_sql('region')}), r AS (SELECT k, d, nav / lag(nav) {_W} - 1 AS r FROM nav) SELECT k, year(d) AS year, {', '.join(f'round(avg(r) FILTER (WHERE month(d) = {m}), 8) AS m{m}' for m in range(1, 13))} FROM r GROUP BY 1, 2",
)
def calendar_pivot(spark, sf_dir):
    rows = nav(spark, sf_dir, "region").withColumn("r", growth("nav"))
    wide = rows.withColumn("m", F.month("d")).withColumn("year", F.year("d").cast("long")).groupBy("k", "year").pivot("m", list(range(1, 13)))
    return wide.agg(F.round(F.avg("r"), 8)).select("k", "year", *(F.col(str(m)).alias(f"m{m}") for m in range(1, 13)))


for _bins in (60, 80):

    @BOOK.add(
        "a28_histogram" if _bins == 60 else f"a28_histogram_{_bins}",
        f"""WITH nav AS ({nav_sql("region")}), r AS (SELECT k, nav / lag(nav) {_W} - 1 AS r FROM nav), e AS (SELECT k, min(r) AS lo, max(r) AS hi FROM r GROUP BY k)
SELECT k, least(CAST(floor(round((r - lo) / (hi - lo) * {_bins}, 6)) AS BIGINT), {_bins - 1}) AS bin, count(*) AS n FROM r JOIN e USING (k) WHERE r IS NOT NULL GROUP BY 1, 2""",
    )
    def histogram(spark, sf_dir, bins=_bins):
        rows = nav(spark, sf_dir, "region").select("k", growth("nav").alias("r")).filter("r is not null")
        ends = rows.groupBy("k").agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
        place = F.least(F.floor(F.round((F.col("r") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins, 6)), F.lit(bins - 1).cast("long"))
        return rows.join(ends, "k").groupBy("k", place.alias("bin")).agg(F.count("*").alias("n"))


#: Ends and number of points of the densities' grid.
_GRID = (-0.06, 0.06, 500)


@BOOK.add(
    "a29_density",
    f"""WITH nav AS ({nav_sql("region")}), r AS (SELECT k, d, nav / lag(nav) {_W} - 1 AS r FROM nav), v AS (SELECT * FROM r WHERE r IS NOT NULL),
s AS (SELECT k, count(*) AS n, 1.06 * stddev_pop(r) * pow(count(*), -0.2) AS h FROM v GROUP BY k HAVING count(*) >= 50 AND stddev_pop(r) > 0),
g AS (SELECT s.*, {_GRID[0]} + {_GRID[1] - _GRID[0]} * i / {_GRID[2] - 1} AS x, i FROM s, (SELECT unnest(range({_GRID[2]})) AS i))
SELECT g.k, g.i::INT AS i, round(sum(exp(-0.5 * pow((g.x - v.r) / g.h, 2))) / (g.n * g.h * sqrt(2 * pi())), 6) AS density FROM g JOIN v ON g.k = v.k GROUP BY g.k, g.i, g.n, g.h""",
)
def density(spark, sf_dir):
    return ops.densities(nav(spark, sf_dir, "region").withColumn("r", growth("nav")), "r", *_GRID).select("k", "i", F.round("density", 6).alias("density"))


@BOOK.add(
    "y7_correlations",
    f"""WITH nav AS ({nav_sql("brand")}), m AS (SELECT d, nav / lag(nav) OVER (ORDER BY d) - 1 AS b FROM ({nav_sql("flag")}) WHERE k = 'N'), daily AS (SELECT k, d, nav / lag(nav) {_W} - 1 AS r FROM nav),
ends AS (SELECT k, last_day(d) AS d, arg_max(nav, d) AS nav FROM nav GROUP BY 1, 2), monthly AS (SELECT k, d, nav / lag(nav) {_W} - 1 AS r FROM ends), near AS (SELECT k, d, r, b FROM daily JOIN m USING (d)),
rows AS (SELECT 'daily' AS view, 30 AS least, k, d, r FROM daily UNION ALL SELECT 'monthly', 12, * FROM monthly UNION ALL SELECT 'excess', 30, k, d, r - b FROM near UNION ALL SELECT 'downside', 15, k, d, r FROM near WHERE b < 0)
SELECT a.view, a.k AS a, b.k AS b, round(CASE WHEN count(*) >= a.least THEN coalesce(corr(a.r, b.r), 0) ELSE 0 END, 6) AS corr FROM rows AS a JOIN rows AS b ON a.view = b.view AND a.d = b.d WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY a.view, a.least, a.k, b.k""",
)
def four_correlations(spark, sf_dir):
    """Correlations of daily, monthly, excess and down-day returns, each with its own least number of common days."""
    series = nav(spark, sf_dir, "brand")
    daily = series.select("k", "d", growth("nav").alias("r"))
    ends = series.groupBy("k", F.last_day("d").alias("month")).agg(F.max_by("nav", "d").alias("nav")).withColumnRenamed("month", "d")
    market = nav(spark, sf_dir, "flag").filter("k = 'N'").select("d", growth("nav").alias("b"))
    near = daily.join(market, "d")
    views = (("daily", 30, daily), ("monthly", 12, ends.select("k", "d", growth("nav").alias("r"))), ("excess", 30, near.select("k", "d", (F.col("r") - F.col("b")).alias("r"))), ("downside", 15, near.filter("b < 0").select("k", "d", "r")))
    out = None
    for name, least, rows in views:
        one = ops.correlation_pairs(rows, "r", least).select(F.lit(name).alias("view"), "a", "b", F.round("corr", 6).alias("corr"))
        out = one if out is None else out.unionByName(one)
    return out


@BOOK.add("j13_densified", f"WITH nav AS ({_WEEKLY.format(nav_sql('brand'))}), spine AS (SELECT * FROM (SELECT DISTINCT d FROM nav), (SELECT DISTINCT k FROM nav)) SELECT k, d, last_value(nav IGNORE NULLS) {_W} AS nav FROM spine LEFT JOIN nav USING (k, d)", dates="d")
def densified(spark, sf_dir):
    return densify(ops.weekly(nav(spark, sf_dir, "brand"))).select("k", "d", forward_filled("nav").alias("nav"))


@BOOK.add("f23_business_days", "SELECT k, min(d) AS a, max(d) AS b, (SELECT count(*) FROM (SELECT unnest(range(min(d), max(d), INTERVAL 1 DAY)) AS x) WHERE isodow(x) < 6) AS days FROM (SELECT l_returnflag AS k, CAST(l_shipdate AS DATE) AS d FROM lineitem) GROUP BY k", dates="a b")
def business_day_span(spark, sf_dir):
    from tidemark.functions.dates import business_days

    spans = keyed_lines(spark, sf_dir, "flag").groupBy("k").agg(F.min("d").alias("a"), F.max("d").alias("b"))
    return spans.select("k", "a", "b", business_days("a", "b").cast("long").alias("days"))
