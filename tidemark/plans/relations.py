"""Relations that the queries run on, and the same relations as SQL.

The tables at hand hold orders, so a fund's price history is derived from them:
per key and ship date the mean discount less 0.05 is the day's return, and its
compounded quarter is the net asset value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Where a series' key comes from: the tables to join and the column.
KEYS = {
    "region": ("supplier nation region", "r_name"),
    "nation": ("supplier nation", "n_name"),
    "brand": ("part", "p_brand"),
    "flag": ("", "l_returnflag"),
}
#: Added to a value before it is rounded, so that short decimals never lie on a rounding edge.
NUDGE = 0.3137e-8
_ON = {"supplier": ("l_suppkey", "s_suppkey"), "nation": ("s_nationkey", "n_nationkey"), "region": ("n_regionkey", "r_regionkey"), "part": ("l_partkey", "p_partkey")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_lines(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """lineitem with the series key ``k`` and the day ``d``."""
    tables, key = KEYS[kind]
    rows = table(spark, sf_dir, "lineitem")
    for name in tables.split():
        left, right = _ON[name]
        rows = rows.join(table(spark, sf_dir, name), F.col(left) == F.col(right))
    return rows.withColumn("k", F.col(key)).withColumn("d", F.col("l_shipdate").cast("date"))


def nav(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """k, d, nav: one compounded series a key."""
    daily = keyed_lines(spark, sf_dir, kind).groupBy("k", "d").agg((F.avg("l_discount") - 0.05).alias("r"))
    running = Window.partitionBy("k").orderBy("d")
    value = 100 * F.exp(F.sum(F.log1p(F.col("r") / 4)).over(running))
    return daily.select("k", "d", F.round(value + NUDGE, 8).alias("nav"))


def _joins(kind: str) -> str:
    return "lineitem" + "".join(f" JOIN {t} ON {_ON[t][0]} = {_ON[t][1]}" for t in KEYS[kind][0].split())


def nav_sql(kind: str) -> str:
    return f"""SELECT k, d, round(100 * exp(sum(ln(1 + r / 4)) OVER (PARTITION BY k ORDER BY d)) + {NUDGE}, 8) AS nav
    FROM (SELECT {KEYS[kind][1]} AS k, CAST(l_shipdate AS DATE) AS d, avg(l_discount) - 0.05 AS r
          FROM {_joins(kind)} GROUP BY 1, 2)"""


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, d, open, high, low, close, volume: unit prices of a brand's lines of a day."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    rows = keyed_lines(spark, sf_dir, "brand").select("k", "d", price.alias("p"), "l_quantity", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").alias("turn"))
    return rows.groupBy("k", "d").agg(F.min_by("p", "turn").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "turn").alias("close"), F.sum("l_quantity").alias("volume"))


BARS_SQL = f"""SELECT k, d, arg_min(p, t) AS open, max(p) AS high, min(p) AS low, arg_max(p, t) AS close, sum(l_quantity) AS volume
    FROM (SELECT p_brand AS k, CAST(l_shipdate AS DATE) AS d, l_extendedprice / l_quantity AS p, l_quantity,
                 (l_orderkey, l_linenumber, l_partkey, l_quantity) AS t FROM {_joins("brand")}) GROUP BY k, d"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trade_id, k, d, side, qty, price: orders as trades in 25 brands, F as sales, at 10 plus the day of the month."""
    brand = F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25 + 1).cast("string"))
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("trade_id"), brand.alias("k"), day.alias("d"),
        F.when(F.col("o_orderstatus") == "F", "SELL").otherwise("buy").alias("side"),
        (F.col("o_totalprice") / 1000).alias("qty"), (F.dayofmonth(day) + 10).cast("double").alias("price"),
    )


TRADES_SQL = """SELECT o_orderkey AS trade_id,
      'Brand#' || CAST(o_custkey % 25 + 1 AS VARCHAR) AS k,
      CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderstatus = 'F' THEN 'SELL' ELSE 'buy' END AS side,
      o_totalprice / 1000 AS qty, CAST(day(o_orderdate) + 10 AS DOUBLE) AS price FROM orders"""


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, month, instrument, asset_class, bucket, rating, weight: a brand's lines of a month as a portfolio."""
    rows = keyed_lines(spark, sf_dir, "brand").withColumn("month", F.last_day("d"))
    by = ("k", "month", "instrument", "asset_class", "bucket", "rating")
    bucket = F.when(F.col("p_size") > 35, "Large Cap").when(F.col("p_size") > 20, "Mid Cap").when(F.col("p_size") > 5, "Small Cap")
    named = rows.select("k", "month", F.concat(F.lit("I"), (F.col("p_partkey") % 60).cast("string")).alias("instrument"), F.when(F.col("p_size") % 3 == 0, "Equity").when(F.col("p_size") % 3 == 1, "Debt").otherwise("Cash & Equivalent").alias("asset_class"), bucket.alias("bucket"), F.concat("l_returnflag", "l_linestatus").alias("rating"), "l_extendedprice")
    sums = named.groupBy(*by).agg(F.sum("l_extendedprice").alias("v"))
    return sums.select(*by, (100 * F.col("v") / F.sum("v").over(Window.partitionBy("k", "month"))).alias("weight"))


HOLDINGS_SQL = f"""SELECT k, month, instrument, asset_class, bucket, rating, 100 * v / sum(v) OVER (PARTITION BY k, month) AS weight FROM (
      SELECT p_brand AS k, last_day(CAST(l_shipdate AS DATE)) AS month, 'I' || CAST(p_partkey % 60 AS VARCHAR) AS instrument,
             CASE WHEN p_size % 3 = 0 THEN 'Equity' WHEN p_size % 3 = 1 THEN 'Debt' ELSE 'Cash & Equivalent' END AS asset_class,
             CASE WHEN p_size > 35 THEN 'Large Cap' WHEN p_size > 20 THEN 'Mid Cap' WHEN p_size > 5 THEN 'Small Cap' END AS bucket,
             l_returnflag || l_linestatus AS rating, sum(l_extendedprice) AS v FROM {_joins("brand")} GROUP BY ALL)"""
