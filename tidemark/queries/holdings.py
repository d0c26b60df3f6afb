"""Queries of the holdings operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import holdings as ops
from tidemark.plans.relations import HOLDINGS_SQL, NUDGE, holdings
from tidemark.queries.book import Book

BOOK = Book()
_H = f"h AS ({HOLDINGS_SQL}), l AS (SELECT h.* FROM h JOIN (SELECT k, max(month) AS last FROM h GROUP BY k) AS m ON h.k = m.k AND h.month = m.last)"


def _latest(spark, sf_dir):
    return ops.latest(holdings(spark, sf_dir))


latest_holdings = _latest


def _r(c, digits=4):
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e4 * NUDGE, digits)


def _q(sql: str, digits: int = 4) -> str:
    return f"round({sql} + {1e4 * NUDGE}, {digits})"


@BOOK.add("j15_latest_snapshot", f"WITH {_H} SELECT k, month, instrument, asset_class, coalesce(bucket, '-') AS bucket, rating, {_q('weight')} AS weight FROM l", dates="month")
def snapshot(spark, sf_dir):
    return _latest(spark, sf_dir).select("k", "month", "instrument", "asset_class", F.coalesce("bucket", F.lit("-")).alias("bucket"), "rating", _r("weight").alias("weight"))


@BOOK.add("j9_overlap_matrix", f"WITH {_H}, o AS (SELECT k, instrument, sum(weight) AS w FROM l GROUP BY 1, 2) SELECT a.k AS a, b.k AS b, round(least(sum(least(a.w, b.w)), 100), 2) AS overlap FROM o AS a JOIN o AS b USING (instrument) WHERE a.k <= b.k GROUP BY 1, 2")
def overlap(spark, sf_dir):
    return ops.overlap(_latest(spark, sf_dir))


@BOOK.add("j10_missing_classes", f"WITH {_H} SELECT instrument, {_q('sum(weight) / (SELECT count(DISTINCT k) FROM l)')} AS mean_weight, count(DISTINCT k) AS funds FROM l WHERE k <> 'Brand#1' AND instrument NOT IN (SELECT instrument FROM l WHERE k = 'Brand#1') GROUP BY 1")
def missing(spark, sf_dir):
    return ops.missing_classes(_latest(spark, sf_dir), "Brand#1").select("instrument", _r("mean_weight").alias("mean_weight"), "funds")


@BOOK.add("a1_class_exposure", f"WITH {_H} SELECT k, asset_class, {_q('sum(weight)')} AS weight, count(*) AS n FROM l GROUP BY 1, 2")
def exposure(spark, sf_dir):
    return _latest(spark, sf_dir).groupBy("k", "asset_class").agg(_r(F.sum("weight")).alias("weight"), F.count("*").alias("n"))


@BOOK.add("a2_average_exposure", f"WITH {_H} SELECT asset_class, {_q('sum(weight) / 25')} AS mean_weight, count(DISTINCT k) AS funds FROM l GROUP BY 1")
def average_exposure(spark, sf_dir):
    return _latest(spark, sf_dir).groupBy("asset_class").agg(_r(F.sum("weight") / 25).alias("mean_weight"), F.count_distinct("k").alias("funds"))


@BOOK.add("a9_concentration", f"WITH {_H}, p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY weight DESC, instrument, bucket, rating) AS place FROM l) SELECT k, {', '.join(f'{_q(f'100 * sum(weight) FILTER (WHERE place <= {n}) / sum(weight)')} AS top_{n}' for n in (3, 5, 10))} FROM p GROUP BY k")
def concentration(spark, sf_dir):
    return ops.concentration(_latest(spark, sf_dir)).select("k", *(_r(f"top_{n}").alias(f"top_{n}") for n in (3, 5, 10)))


@BOOK.add("a10_cap_breakdown", f"WITH {_H}, e AS (SELECT k, coalesce(bucket, 'Other') AS bucket, sum(weight) AS w FROM l WHERE asset_class IS NULL OR lower(asset_class) LIKE '%equity%' GROUP BY 1, 2) SELECT k, bucket, {_q('100 * w / sum(w) OVER (PARTITION BY k)')} AS share FROM e")
def caps(spark, sf_dir):
    equity = _latest(spark, sf_dir).filter(F.col("asset_class").isNull() | F.lower("asset_class").contains("equity"))
    return ops.shares(equity, F.coalesce("bucket", F.lit("Other")), "bucket").select("k", "bucket", _r("share").alias("share"))


@BOOK.add("a11_credit_breakdown", f"WITH {_H}, e AS (SELECT k, rating, sum(weight) AS w FROM l WHERE asset_class = 'Debt' AND rating <> '' GROUP BY 1, 2) SELECT k, rating, {_q('100 * w / sum(w) OVER (PARTITION BY k)')} AS share FROM e")
def credit(spark, sf_dir):
    debt = _latest(spark, sf_dir).filter((F.col("asset_class") == "Debt") & (F.col("rating") != ""))
    return ops.shares(debt, F.col("rating"), "rating").select("k", "rating", _r("share").alias("share"))


@BOOK.add("a12_asset_breakdown", f"WITH {_H}, e AS (SELECT k, asset_class, max(weight) AS w FROM l GROUP BY 1, 2) SELECT k, asset_class, {_q('100 * w / sum(w) OVER (PARTITION BY k)')} AS share FROM e")
def assets(spark, sf_dir):
    widest = _latest(spark, sf_dir).groupBy("k", "asset_class").agg(F.max("weight").alias("weight"))
    return ops.shares(widest, F.col("asset_class"), "asset_class").select("k", "asset_class", _r("share").alias("share"))


_FAMILIES = {"equity": "equity", "debt": "debt|bond", "cash": "cash|treps|money", "large": "large", "mid": "mid", "small": "small"}


@BOOK.add("a13_keyword_rollup", f"WITH {_H} SELECT k, {', '.join(f'{_q(f"coalesce(sum(weight) FILTER (WHERE regexp_matches(lower(asset_class || ' ' || coalesce(bucket, '')), '{p}')), 0)")} AS {n}' for n, p in _FAMILIES.items())} FROM l GROUP BY k")
def rollup(spark, sf_dir):
    text = F.lower(F.concat_ws(" ", "asset_class", "bucket"))
    return _latest(spark, sf_dir).groupBy("k").agg(*(_r(F.coalesce(F.sum(F.when(text.rlike(p), F.col("weight"))), F.lit(0.0))).alias(n) for n, p in _FAMILIES.items()))


@BOOK.add("a14_composition", f"WITH {_H}, s AS (SELECT *, sum(weight) OVER (PARTITION BY k) AS total, lower(asset_class) AS c FROM l) SELECT k, {', '.join(f'{_q(f"coalesce(sum(weight / CASE WHEN total > 1.5 THEN 100 ELSE 1 END) FILTER (WHERE {w}), 0)", 6)} AS {n}' for n, w in {'pct_equity': "c LIKE '%equity%'", 'pct_debt': "c NOT LIKE '%equity%' AND c LIKE '%debt%'", 'pct_cash': "c NOT LIKE '%equity%' AND c NOT LIKE '%debt%' AND c LIKE '%cash%'"}.items())} FROM s GROUP BY k".replace(str(1e4 * NUDGE), str(NUDGE)))
def composition(spark, sf_dir):
    c = F.lower("asset_class")
    kind = F.when(c.contains("equity"), "pct_equity").when(c.rlike("debt|bond"), "pct_debt").when(c.rlike("cash|money market|tbill|tri-party"), "pct_cash")
    rows = _latest(spark, sf_dir).withColumn("kind", kind)
    scale = F.when(F.sum("weight") > 1.5, 100).otherwise(1)
    return rows.groupBy("k").agg(*(F.round(F.coalesce(F.sum(F.when(F.col("kind") == n, F.col("weight"))), F.lit(0.0)) / scale + NUDGE, 6).alias(n) for n in ("pct_equity", "pct_debt", "pct_cash")))


@BOOK.add("a26_top_and_others", f"WITH {_H}, o AS (SELECT k, instrument, sum(weight) AS w FROM l GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY w DESC, instrument) AS place FROM o) SELECT k, CASE WHEN place <= 10 THEN instrument ELSE 'Others' END AS instrument, {_q('sum(w)')} AS weight FROM p GROUP BY 1, 2")
def top_others(spark, sf_dir):
    return ops.top_and_others(_latest(spark, sf_dir)).select("k", "instrument", _r("weight").alias("weight"))


@BOOK.add("a5_snapshot_span", f"WITH h AS ({HOLDINGS_SQL}) SELECT k, min(month) AS first_month, max(month) AS last_month, count(DISTINCT month) AS months, count(DISTINCT instrument) AS instruments FROM h GROUP BY k", dates="first_month last_month")
def span(spark, sf_dir):
    return holdings(spark, sf_dir).groupBy("k").agg(F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.count_distinct("month").alias("months"), F.count_distinct("instrument").alias("instruments"))
