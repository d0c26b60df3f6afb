"""Risk and return metrics of series, all in one plan with one shuffle.

Windows over (k, d) mark returns and ranks, then one aggregate a key gives every
metric.  "One year" is the last 252 rows; metrics of net asset values use all
rows, metrics of returns leave out returns above 100 % as corrupt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.series import YEAR, annual_growth, correlation, growth, ordered

#: Yearly risk-free rate, and the parametric quantile of value at risk.
RISK_FREE, QUANTILE = 0.06, 1.6448536269514722
ROOT = YEAR**0.5


def _at(value: str, n: int) -> Column:
    """The value n rows before the last one."""
    return F.max(F.when(F.col("back") == n + 1, F.col(value)))


def _cagr(years: int) -> Column:
    n = YEAR * years
    return F.when((_at("nav", n) > 0) & (_at("nav", 0) > 0), F.pow(F.try_divide(_at("nav", 0), _at("nav", n)), 1 / years) - 1)


def corrected_skew(x: str) -> Column:
    n = F.count(x).cast("double")
    return F.when(n > 2, F.try_divide(F.skewness(x) * F.sqrt(n * (n - 1)), n - 2))


def corrected_kurtosis(x: str) -> Column:
    n = F.count(x).cast("double")
    return F.when(n > 3, F.try_divide((n - 1) * ((n + 1) * F.kurtosis(x) + 6), (n - 2) * (n - 3)))


def marked(nav: DataFrame) -> DataFrame:
    """nav(k, d, nav) with daily return r, rank from the end, the last year's filtered returns q, and rolling growths."""
    w = ordered()
    whole = Window.partitionBy("k")  # what follows a row is the whole less what came: one order, and no window starts anew at each row
    rows = nav.withColumn("r", growth("nav")).withColumn("back", (F.count("*").over(whole) - F.row_number().over(w) + 1).cast("int"))
    sound = F.when(F.abs("r") <= 1, F.col("r"))
    later = F.count("all_r").over(whole) - F.count("all_r").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("all_r", sound).withColumn("q", F.when(later < YEAR, sound)).withColumn("q3", F.when(later < 3 * YEAR, sound))
    rows = rows.withColumns({f"g{y}": annual_growth("nav", YEAR * y) for y in (1, 3, 5)})
    grown = F.sum(F.log1p("q")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    every = F.sum(F.log1p("all_r")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("grown", F.when(F.col("q").isNotNull(), F.exp(grown))).withColumn("every", F.exp(F.coalesce(every, F.lit(0.0))))


def scheme_metrics(nav: DataFrame) -> DataFrame:
    """One row of metrics for each key of nav(k, d, nav) with at least a year of rows."""
    w = ordered().rowsBetween(Window.unboundedPreceding, 0)
    rows = marked(nav)
    rows = rows.withColumn("dd", F.col("grown") / F.greatest(F.lit(1.0), F.max("grown").over(w)) - 1).withColumn("dd_all", F.col("every") / F.greatest(F.lit(1.0), F.max("every").over(w)) - 1)
    q, daily = F.col("q"), (1 + RISK_FREE / YEAR) ** (1 / YEAR) - 1
    mean, deviation, n = F.avg("q"), F.stddev_samp("q"), F.count("q")
    below = lambda c: F.avg(F.when(F.col(c).isNotNull(), F.pow(F.least(F.col(c) - daily, F.lit(0.0)), 2)))
    ratio = lambda c, risk: F.try_divide(F.avg(c) - daily, risk) * ROOT
    win, loss = F.avg(F.when(q > 0, q)), F.avg(F.when(q < 0, q))
    payoff = F.abs(F.try_divide(win, loss))
    wins = F.try_divide(F.count_if(q > 0), F.count_if(q != 0))
    total = F.exp(F.sum(F.log1p("q"))) - 1
    worst = F.min("dd")
    return rows.groupBy("k").agg(
        *(_cagr(y).alias(f"cagr_{y}y") for y in (1, 3, 5, 10)),
        (deviation * ROOT).alias("vol_1y"),
        F.when(F.count_if(q < 0) >= 2, F.stddev_samp(F.when(q < 0, q)) * ROOT).alias("downside_vol_1y"),
        *(ratio(c, F.stddev_samp(c)).alias(f"sharpe_{y}y") for y, c in ((1, "q"), (3, "q3"))),
        *(ratio(c, F.sqrt(below(c))).alias(f"sortino_{y}y") for y, c in ((1, "q"), (3, "q3"))),
        (F.stddev_samp("q3") * ROOT).alias("vol_3y"),
        F.try_divide(F.pow(1 + total, YEAR / n) - 1, F.abs(worst)).alias("calmar_1y"),
        F.try_divide(F.sum("q"), F.abs(F.sum(F.when(q < 0, q)))).alias("gain_to_pain_1y"),
        worst.alias("max_dd_1y"),
        F.min("dd_all").alias("max_dd_all"),
        total.alias("cumulative_return_1y"),
        mean.alias("avg_daily_return_1y"),
        F.try_divide(F.count_if(q > 0), n).alias("win_rate_1y"),
        F.max("q").alias("best_day_1y"),
        F.min("q").alias("worst_day_1y"),
        (mean - QUANTILE * deviation).alias("var_95_1y"),
        corrected_skew("q").alias("skew_1y"),
        corrected_kurtosis("q").alias("kurt_1y"),
        F.try_divide(payoff * wins - (1 - wins), payoff).alias("kelly_1y"),
        win.alias("avg_win_1y"),
        loss.alias("avg_loss_1y"),
        payoff.alias("payoff_1y"),
        (F.try_divide(_at("nav", 0), F.max("nav")) - 1).alias("pct_from_ath"),
        *(f(f"g{y}").alias(f"rolling_{y}y_{name}") for y in (1, 3, 5) for name, f in (("min", F.min), ("median", F.median), ("mean", F.avg), ("max", F.max))),
        *((F.try_divide(_at("nav", 0), _at("nav", m)) - 1).alias(f"abs_return_{name}") for name, m in (("3m", 63), ("6m", 126), ("1y", 252))),
        F.min("d").alias("inception_date"),
        F.max_by("nav", "d").alias("last_nav"),
        F.max("d").alias("last_nav_date"),
        F.count("*").alias("history_days"),
    ).filter(F.col("history_days") >= YEAR)


def tail_mean(nav: DataFrame) -> DataFrame:
    """k, var_95_1y and cvar_95_1y: the mean of the returns below the value at risk, which stands in where there is none."""
    rows = marked(nav).filter(F.col("q").isNotNull())
    every = Window.partitionBy("k")
    bound = rows.withColumn("v", F.avg("q").over(every) - QUANTILE * F.stddev_samp("q").over(every))
    return bound.groupBy("k").agg(F.first("v").alias("var_95_1y"), F.coalesce(F.avg(F.when(F.col("q") < F.col("v"), F.col("q"))), F.first("v")).alias("cvar_95_1y"))


def capm(returns: DataFrame, benchmark: DataFrame, least: int = 60) -> DataFrame:
    """k, b, alpha, beta, r2, tracking_error of returns(k, d, r) against benchmark(b, d, br) over common days."""
    both = returns.join(benchmark, "d").filter(F.col("r").isNotNull() & F.col("br").isNotNull())
    beta = F.try_divide(F.covar_samp("r", "br"), F.var_samp("br"))
    stats = both.groupBy("k", "b").agg(F.count("*").alias("n"), beta.alias("beta"), ((F.avg("r") - beta * F.avg("br")) * YEAR).alias("alpha"), F.pow(correlation("r", "br"), 2).alias("r2"), (F.stddev_samp(F.col("r") - F.col("br")) * ROOT).alias("tracking_error"))
    return stats.filter(F.col("n") >= least).drop("n")
