"""What the fund and stock pages ask for: details, search, benchmarks of choice, windows that are long enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import trigram_similarity
from tidemark.operators import metrics
from tidemark.operators.screener import star
from tidemark.operators.series import YEAR, growth

#: Rows that a rolling window needs beyond its own, and the windows on offer.
BEYOND, WINDOWS = 30, {"3 Months": 63, "6 Months": 126, "1 Year": 252, "3 Years": 756, "5 Years": 1260}


def details(schemes: DataFrame, houses: DataFrame, categories: DataFrame) -> DataFrame:
    """Schemes with the names of their fund house and category; an unknown id has none."""
    return star(schemes, [(houses, "house_id"), (categories, "category_id")]).drop("house_id", "category_id")


def search(schemes: DataFrame, houses: DataFrame, categories: DataFrame, asked: str, least: float = 0.3, limit: int = 20) -> DataFrame:
    """The schemes whose names are most like ``asked``, with their dimensions; equally alike ones by length and code."""
    scored = schemes.withColumn("score", F.round(trigram_similarity(F.col("name"), F.lit(asked)), 7)).filter(F.col("score") >= least)
    top = scored.orderBy(F.desc("score"), F.length("name"), "code").limit(limit)
    return details(top, houses, categories)


def recent(schemes: DataFrame, houses: DataFrame, categories: DataFrame, limit: int = 25) -> DataFrame:
    """The schemes added last, with their dimensions; those whose time is not known do not show."""
    top = schemes.filter("added is not null").orderBy(F.desc("added"), F.desc("code")).limit(limit)
    return details(top, houses, categories)


def index_returns(prices: DataFrame, symbol: str) -> DataFrame:
    """b, d, br: daily returns of one index of prices(b, d, close); no rows, of the same schema, where it is not known."""
    rows = prices.filter(F.col("b") == symbol).withColumn("br", growth("close", key="b"))
    return rows.filter("br is not null").select("b", "d", "br")


def last_year_capm(returns: DataFrame, benchmark: DataFrame, least: int = 60) -> DataFrame:
    """capm() of each fund's last 252 returns against a benchmark of choice; funds with too few common days have a row without values."""
    back = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("d")))
    last = returns.filter("r is not null").withColumn("_back", back).filter(F.col("_back") <= YEAR).drop("_back")
    return last.select("k").distinct().join(metrics.capm(last, benchmark, least), "k", "left")


def _summary(value: Column) -> list[Column]:
    return [F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high")]


def rolling_pages(nav: DataFrame, beyond: int = BEYOND) -> DataFrame:
    """k, label, chosen, mean, low, high, latest of the rolling windows that nav(k, d, nav) is long enough for, in percent.

    A window of n rows is offered from n + ``beyond`` rows on; chosen is the
    third that is offered, or the last.  Growth over a year or more is annualised.
    """
    rows = nav.withColumn("_rows", F.count("*").over(Window.partitionBy("k")))
    each = []
    for place, (label, n) in enumerate(WINDOWS.items()):
        r = growth("nav", n)
        yearly = F.when(1 + r > 0, F.pow(1 + r, YEAR / n) - 1) if n >= YEAR else r
        each.append(F.struct(F.lit(place).alias("place"), F.lit(label).alias("label"), F.lit(n).alias("n"), (100 * yearly).alias("r")))
    long = rows.select("k", "d", "_rows", F.array(*each).alias("_w")).select("k", "d", "_rows", F.explode("_w").alias("w")).filter(F.col("_rows") >= F.col("w.n") + beyond).filter("w.r is not null")
    sums = long.groupBy("k", "w.place", "w.label").agg(*_summary(F.col("w.r")), F.max_by("w.r", "d").alias("latest"))
    offered = F.count("*").over(Window.partitionBy("k"))  # at most a row for each window
    return sums.withColumn("chosen", F.col("place") == F.least(F.lit(2), offered - 1)).select("k", "label", "chosen", "mean", "low", "high", "latest")


def cached(rows: DataFrame, schemes: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Cached metrics with their scheme's sub-category, of the asked names or, without any asked, of all."""
    named = rows.join(schemes.select("k", "name", "sub_category"), "k")
    return named if asked is None else named.join(asked.select("name").distinct(), "name", "left_semi")


def composition(rows: DataFrame, tops: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """k, shares of equity, debt and cash, and of the n largest positions, in [0, 1]; weights that add up to more than 1.5 are percentages.

    A class counts for the first of equity, debt and cash whose words it holds;
    positions without a weight count for nothing.
    """
    held = rows.filter("weight is not null")
    c = F.lower("asset_class")
    kind = F.when(c.contains("equity"), "pct_equity").when(c.rlike("debt|bond"), "pct_debt").when(c.rlike("cash|money market|tbill|tri-party"), "pct_cash")
    place = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("weight")))
    sums = held.withColumn("_kind", kind).withColumn("_place", place).groupBy("k").agg(
        F.when(F.sum("weight") > 1.5, 100.0).otherwise(1.0).alias("_scale"),
        *(F.coalesce(F.sum(F.when(F.col("_kind") == n, F.col("weight"))), F.lit(0.0)).alias(n) for n in ("pct_equity", "pct_debt", "pct_cash")),
        *(F.sum(F.when(F.col("_place") <= n, F.col("weight"))).alias(f"pct_top{n}") for n in tops),
    )
    return sums.select("k", *((F.col(c) / F.col("_scale")).alias(c) for c in sums.columns if c.startswith("pct_")))
