"""Queries of the screener: star join, filters, text functions, search and growth."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import metrics
from tidemark.operators.screener import Filters, screen, star
from tidemark.plans.relations import NUDGE, nav, table
from tidemark.queries.book import Book, stem_sql
from tidemark.queries.metrics import ORACLE_METRICS

BOOK = Book()
#: Literal names with plan and option words, which the tables lack.
_SUFFIX = ("Direct Plan - Growth", "Regular Plan - IDCW", "Direct Plan - IDCW Payout", "Growth Option", "ETF", "Regular - Bonus", "(Growth)", "Growth Opportunities", "Income Distribution - Retail", "(Regular Plan) Monthly Dividend", "- Growth - Direct", "- Growth.", "(Regular - Growth)", "-- Dividend Yield", "Cumulative", "Half  Yearly Payout")
_NAME = f"p_name || ' Fund ' || CASE p_partkey % {len(_SUFFIX)} {' '.join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SUFFIX))} END"


def _name():
    out = None
    for i, s in enumerate(_SUFFIX):
        hit = F.col("p_partkey") % len(_SUFFIX) == i
        out = F.when(hit, F.lit(s)) if out is None else out.when(hit, F.lit(s))
    return F.concat("p_name", F.lit(" Fund "), out)


def _schemes(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("code"), _name().alias("name"), F.col("p_brand").alias("k"), F.col("p_type").alias("category"), F.col("p_size").alias("size"),
        F.when(F.col("p_partkey") % 6 != 0, F.col("p_retailprice")).alias("aum"), F.when(F.col("p_partkey") % 5 != 0, (F.col("p_size") % 30) / 10).alias("ter"),
    )


_SCHEMES = f"schemes AS (SELECT p_partkey AS code, {_NAME} AS name, p_brand AS k, p_type AS category, p_size AS size, CASE WHEN p_partkey % 6 <> 0 THEN p_retailprice END AS aum, CASE WHEN p_partkey % 5 <> 0 THEN (p_size % 30) / 10 END AS ter FROM part)"
_STATUS = "status AS (SELECT DISTINCT l_partkey AS code, 'available' AS status FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 20)"
_PLAN = "CASE WHEN regexp_matches(name, '(?i)\\bdirect\\b') THEN 'Direct' WHEN regexp_matches(name, '(?i)\\bregular\\b') THEN 'Regular' END"
_OPTION = r"""CASE WHEN contains(lower(name), 'idcw') OR contains(lower(name), 'income distribution') OR list_contains(string_split_regex(lower(name), '\W+'), 'dividend') THEN 'IDCW'
  WHEN regexp_matches(lower(name), '\bgrowth +(plan|option)\b') OR contains(replace(lower(name), ' ', ''), '-growth-') OR list_contains(string_split_regex(lower(name), '\W+'), 'cumulative') OR regexp_matches(rtrim(lower(name), ' .()'), '(^|[ -])growth$') THEN 'Growth'
  WHEN list_contains(string_split_regex(lower(name), '\W+'), 'bonus') THEN 'Bonus' WHEN list_contains(string_split_regex(lower(name), '\W+'), 'etf') THEN 'ETF' ELSE 'Other' END"""
_VIEW = f"{_SCHEMES}, {_STATUS}, met AS ({ORACLE_METRICS}), view AS (SELECT s.*, t.status, m.cagr_1y, m.sharpe_1y, m.max_dd_1y, m.inception_date, s.k AS house, {_PLAN} AS plan, {_OPTION} AS option FROM schemes AS s LEFT JOIN status AS t ON s.code = t.code LEFT JOIN met AS m ON s.k = m.k)"


def _view(spark, sf_dir):
    seen = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A' and l_quantity > 20").select(F.col("l_partkey").alias("code")).distinct().withColumn("status", F.lit("available"))
    met = metrics.scheme_metrics(nav(spark, sf_dir, "brand")).select("k", *(F.round(c, 6).alias(c) for c in ("cagr_1y", "sharpe_1y", "max_dd_1y")), "inception_date")
    return star(_schemes(spark, sf_dir), [(seen, "code"), (met, "k")]).withColumn("house", F.col("k"))


@BOOK.add("j2_screener_view", f"WITH {_VIEW} SELECT code, name, house, category, aum, ter, status, cagr_1y, sharpe_1y, max_dd_1y, inception_date, plan, option FROM view", dates="inception_date")
def view(spark, sf_dir):
    return _view(spark, sf_dir).withColumn("plan", text.plan_of("name")).withColumn("option", text.option_of("name")).select("code", "name", "house", "category", "aum", "ter", "status", "cagr_1y", "sharpe_1y", "max_dd_1y", "inception_date", "plan", "option")


@BOOK.add("p2_screen", f"WITH {_VIEW} SELECT code, plan, option, status FROM view WHERE contains(lower(name), 'fund') AND contains(lower(name), 'direct') AND plan IN ('Direct') AND coalesce(aum, 0) >= 900 AND coalesce(ter, 0) <= 2.0 AND status IS NOT NULL AND cagr_1y IS NOT NULL AND cagr_1y * 100 >= -10 AND inception_date <= DATE '2001-11-04' - 1826")
def screened(spark, sf_dir):
    wanted = Filters(name="FUND direct", plans=["Direct"], aum_min=900, ter_max=2.0, only_tracked=True, has_nav=True, cagr_min=-10, years=5)
    return screen(_view(spark, sf_dir), wanted, "2001-11-04").select("code", "plan", "option", "status")


@BOOK.add("p1_literal_name_filter", f"WITH {_SCHEMES} SELECT code, name FROM schemes WHERE contains(name, '(')")
def literal_name(spark, sf_dir):
    return screen(_schemes(spark, sf_dir), Filters(name="("), "2001-11-04").select("code", "name")


@BOOK.add("p3_untracked_or_cheap", f"WITH {_VIEW} SELECT house, count(*) AS n, count(*) FILTER (WHERE status IS NULL) AS untracked, count(*) FILTER (WHERE ter < 1) AS cheap FROM view WHERE option IN ('Growth', 'ETF') GROUP BY house")
def untracked(spark, sf_dir):
    rows = screen(_view(spark, sf_dir), Filters(options=["Growth", "ETF"]), "2001-11-04")
    return rows.groupBy("house").agg(F.count("*").alias("n"), F.count_if(F.col("status").isNull()).alias("untracked"), F.count_if(F.col("ter") < 1).alias("cheap"))


@BOOK.add("p17_filter_options", f"WITH {_SCHEMES} SELECT DISTINCT k, category FROM schemes WHERE size < 10")
def filter_options(spark, sf_dir):
    return _schemes(spark, sf_dir).filter("size < 10").select("k", "category").distinct()


@BOOK.add("p11_visible_columns", f"WITH {_VIEW} SELECT code AS \"Code\", name AS \"Scheme\", round(cagr_1y * 100, 4) AS \"CAGR 1Y %\", round(max_dd_1y * 100, 4) AS \"Max DD 1Y %\", CASE WHEN status IS NULL THEN '-' WHEN status = 'available' THEN 'yes' ELSE 'no' END AS \"NAV\" FROM view")
def visible(spark, sf_dir):
    mark = F.when(F.col("status").isNull(), "-").when(F.col("status") == "available", "yes").otherwise("no")
    return _view(spark, sf_dir).select(F.col("code").alias("Code"), F.col("name").alias("Scheme"), F.round(F.col("cagr_1y") * 100, 4).alias("CAGR 1Y %"), F.round(F.col("max_dd_1y") * 100, 4).alias("Max DD 1Y %"), mark.alias("NAV"))


@BOOK.add("a7_status_counts", f"WITH {_VIEW} SELECT count(*) AS n, count(*) FILTER (WHERE status = 'available') AS available, count(*) FILTER (WHERE status IS NULL) AS untracked, count(*) FILTER (WHERE plan = 'Direct') AS direct FROM view")
def status_counts(spark, sf_dir):
    rows = _view(spark, sf_dir).withColumn("plan", text.plan_of("name"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "available").alias("available"), F.count_if(F.col("status").isNull()).alias("untracked"), F.count_if(F.col("plan") == "Direct").alias("direct"))


@BOOK.add("a24_category_counts", f"WITH {_SCHEMES} SELECT category, count(*) AS n FROM schemes GROUP BY 1")
def category_counts(spark, sf_dir):
    return _schemes(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))


#: One ending after another, six times over, as the rule has it; names here end in four at most.
_PEELED = "name"
for _ in range(6):
    for _end in ("[(](direct|regular) +plan[)]", "(direct|regular) +plan", "growth +(option|plan)", "idcw( +(reinvestment|payout))?", "growth"):
        _PEELED = f"regexp_replace({_PEELED}, '[ -]*{_end} *$', '', 'i')"
    _PEELED = f"regexp_replace({_PEELED}, '[ -]+(direct|regular) *$', '', 'i')"
_SHORT = f"trim(regexp_replace(regexp_replace({_PEELED}, ' *- *$', ''), ' +', ' ', 'g'))"


@BOOK.add(
    "f1_names",
    rf"""WITH {_SCHEMES} SELECT code, {_SHORT} AS short, {_PLAN} AS plan, {_OPTION} AS option,
  lower(array_to_string(list_transform(list_filter(string_split_regex(trim(translate(name, '()', '  ')), ' +'), lambda w: w <> '-' AND w <> ''), lambda w: trim(w, '-')), '-')) AS slug,
  {stem_sql("name")} AS stem FROM schemes""",
)
def names(spark, sf_dir):
    return _schemes(spark, sf_dir).select("code", text.short_name("name").alias("short"), text.plan_of("name").alias("plan"), text.option_of("name").alias("option"), text.slug("name").alias("slug"), text.stem("name").alias("stem"))


@BOOK.add("f5_clean_isin", "WITH c AS (SELECT p_partkey AS code, CASE p_partkey % 4 WHEN 0 THEN ' inf' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '1 ' WHEN 1 THEN 'IN12' WHEN 2 THEN 'INF' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') || 'X' ELSE '' END AS raw FROM part) SELECT code, CASE WHEN regexp_matches(upper(trim(raw)), '^[A-Z]{2}[A-Z0-9]{9}[0-9]$') THEN upper(trim(raw)) ELSE '' END AS isin FROM c")
def isins(spark, sf_dir):
    digits = F.lpad(F.col("p_partkey").cast("string"), 8, "0")
    turn = F.col("p_partkey") % 4
    raw = F.when(turn == 0, F.concat(F.lit(" inf"), digits, F.lit("1 "))).when(turn == 1, "IN12").when(turn == 2, F.concat(F.lit("INF"), digits, F.lit("X"))).otherwise("")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), raw.alias("raw")).select("code", text.clean_isin("raw").alias("isin"))


_GRAMS = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: length(w) > 0), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_SIM = f"len(list_intersect({_GRAMS.format('name')}, {_GRAMS.format('q')})) * 1.0 / len(list_distinct(list_concat({_GRAMS.format('name')}, {_GRAMS.format('q')})))"

#: Similarity of name and q, as text.trigram_similarity has it.
TRIGRAMS = _SIM


@BOOK.add("f10_trigram_search", f"WITH {_SCHEMES}, s AS (SELECT code, name, {_SIM} AS score FROM (SELECT code, name, 'direct growth fund blue' AS q FROM schemes)) SELECT code, name, round(score, 7) AS score FROM s WHERE score >= 0.3 ORDER BY round(score, 7) DESC, length(name), code LIMIT 20")
def search(spark, sf_dir):
    score = text.trigram_similarity(F.col("name"), F.lit("direct growth fund blue"))
    rows = _schemes(spark, sf_dir).select("code", "name", F.round(score, 7).alias("score")).filter("score >= 0.3")
    return rows.orderBy(F.desc("score"), F.length("name"), "code").limit(20)


@BOOK.add("o2_recent_additions", "SELECT o_orderkey AS code, CAST(o_orderdate AS DATE) AS added FROM orders WHERE o_orderstatus <> 'F' ORDER BY added DESC, code DESC LIMIT 25", dates="added")
def recent(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("code"), F.col("o_orderdate").cast("date").alias("added"))
    return rows.orderBy(F.desc("added"), F.desc("code")).limit(25)


@BOOK.add("o9_top_a_day", f"WITH s AS (SELECT CAST(l_shipdate AS DATE) AS d, l_partkey AS k, sum(l_extendedprice * l_discount) AS v FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY v DESC, k) AS place FROM s) SELECT d, k, place, round(v + {1e4 * NUDGE}, 3) AS v FROM r WHERE place <= 10", dates="d")
def top_a_day(spark, sf_dir):
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("d"), F.col("l_partkey").alias("k")).agg(F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("v"))
    place = F.row_number().over(Window.partitionBy("d").orderBy(F.desc("v"), "k")).cast("long")
    return sums.withColumn("place", place).filter("place <= 10").select("d", "k", "place", F.round(F.col("v") + 1e4 * NUDGE, 3).alias("v"))


@BOOK.add("x2_missing_codes", "SELECT p_partkey AS code FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount > 0.09")
def missing_codes(spark, sf_dir):
    have = table(spark, sf_dir, "lineitem").filter("l_discount > 0.09").select(F.col("l_partkey").alias("code"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("code")).join(have, "code", "left_anti")


@BOOK.add("x3_common_days", "SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE l_returnflag = 'A' AND l_discount < 0.01 INTERSECT SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_returnflag = 'R' AND l_discount < 0.01", dates="d")
def common_days(spark, sf_dir):
    days = table(spark, sf_dir, "lineitem").filter("l_discount < 0.01").select(F.col("l_shipdate").cast("date").alias("d"), "l_returnflag")
    return days.filter("l_returnflag = 'A'").select("d").intersect(days.filter("l_returnflag = 'R'").select("d"))


_QUARTERS = "q AS (SELECT o_custkey % 50 AS k, date_trunc('quarter', o_orderdate)::DATE AS p, round(sum(o_totalprice), 2) AS sales, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS profit, count(DISTINCT o_orderpriority) * 5.0::DOUBLE AS promoter FROM orders GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p DESC) AS back FROM q)"


def _growth_sql(c: str, n: int) -> str:
    now, then = f"max({c}) FILTER (WHERE back = 1)", f"max({c}) FILTER (WHERE back = {n + 1})"
    return f"round(({now} - {then}) / nullif(abs({then}), 0), 6)"


@BOOK.add("w21_quarterly_growth", f"WITH {_QUARTERS} SELECT k, {', '.join(f'{_growth_sql(c, n)} AS {c}_{name}' for c in ('sales', 'profit') for name, n in (('qoq', 1), ('yoy', 4)))}, max(promoter) FILTER (WHERE back = 1) - max(promoter) FILTER (WHERE back = 5) AS promoter_change FROM n GROUP BY k")
def quarterly(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("k"), F.trunc("o_orderdate", "quarter").alias("p")).agg(F.round(F.sum("o_totalprice"), 2).alias("sales"), F.round(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))), 2).alias("profit"), (F.count_distinct("o_orderpriority") * 5.0).alias("promoter"))
    back = rows.withColumn("back", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("p"))))
    at = lambda c, n: F.max(F.when(F.col("back") == n, F.col(c)))
    grown = lambda c, n: F.round(F.try_divide(at(c, 1) - at(c, n + 1), F.abs(at(c, n + 1))), 6)
    return back.groupBy("k").agg(*(grown(c, n).alias(f"{c}_{name}") for c in ("sales", "profit") for name, n in (("qoq", 1), ("yoy", 4))), (at("promoter", 1) - at("promoter", 5)).alias("promoter_change"))


@BOOK.add("a25_freshness", "WITH l AS (SELECT p_brand AS k, max(CAST(l_shipdate AS DATE)) AS last FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), a AS (SELECT k, DATE '2001-11-05' - last AS age FROM l) SELECT count(*) AS funds, count(*) FILTER (WHERE age > 1) AS stale, max(age) AS oldest FROM a")
def freshness(spark, sf_dir):
    rows = nav(spark, sf_dir, "brand").groupBy("k").agg(F.datediff(F.lit("2001-11-05").cast("date"), F.max("d")).alias("age"))
    return rows.agg(F.count("*").alias("funds"), F.count_if(F.col("age") > 1).alias("stale"), F.max("age").cast("long").alias("oldest"))
