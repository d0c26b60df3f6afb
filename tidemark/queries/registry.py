"""Queries of the fund registry: statuses, saved snapshots, the star of five dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import metrics, tables
from tidemark.operators import pages as ops
from tidemark.operators.screener import star
from tidemark.operators.series import growth
from tidemark.plans.relations import HOLDINGS_SQL, NUDGE, TRADES_SQL, holdings, nav, nav_sql, table, trades
from tidemark.queries import holdings as pages
from tidemark.queries import metrics as metric_pages
from tidemark.queries.book import Book
from tidemark.queries.metrics import ORACLE_METRICS
from tidemark.queries.screener import TRIGRAMS as trigram_sql
from tidemark.sources.scratch import scratch

BOOK = Book()
SOURCES = ("nav", "holdings", "metadata")
TODAY = "2001-11-05"
#: Sizes by which a scheme's source is unavailable and pending in these queries.
_TURNS = {"nav": (7, 3), "holdings": (5, 4), "metadata": (6, 9)}
_STATUSES = ", ".join(f"CASE WHEN p_size % {a} = 0 THEN 'unavailable' WHEN p_size % {b} = 0 THEN 'pending' ELSE 'available' END AS {s}_status" for s, (a, b) in _TURNS.items())
_REGISTRY = f"registry AS (SELECT p_partkey AS code, {_STATUSES} FROM part WHERE p_size > 10)"
_NAMES = "names AS (SELECT p_partkey AS code, p_name || ' ' || p_partkey AS name FROM part WHERE p_size <= 45)"
_SHOWN = ", ".join(f"{s}_status" for s in SOURCES)


def _registry(spark, sf_dir):
    status = lambda a, b: F.when(F.col("p_size") % a == 0, "unavailable").when(F.col("p_size") % b == 0, "pending").otherwise("available")
    return table(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("code"), *(status(*turn).alias(f"{s}_status") for s, turn in _TURNS.items()))


def _names(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("p_size <= 45").select(F.col("p_partkey").alias("code"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"))


@BOOK.add("z19_tracked", f"WITH {_REGISTRY}, {_NAMES} SELECT name, code, {_SHOWN} FROM registry JOIN names USING (code)")
def tracked(spark, sf_dir):
    """Tracked funds by name; those without a name do not show."""
    return tables.tracked(_registry(spark, sf_dir), _names(spark, sf_dir)).select("name", "code", *(f"{s}_status" for s in SOURCES))


@BOOK.add("z19_unavailable", f"WITH {_REGISTRY}, {_NAMES} SELECT name, code FROM registry JOIN names USING (code) WHERE 'unavailable' IN (nav_status, holdings_status, metadata_status)")
def unavailable(spark, sf_dir):
    """Tracked funds with a source that could not be had."""
    rows = tables.tracked(_registry(spark, sf_dir), _names(spark, sf_dir))
    return rows.filter(tables.any_status("unavailable", *(f"{s}_status" for s in SOURCES))).select("name", "code")


_CHANGES = "changes AS (SELECT CASE WHEN p_size > 30 THEN upper(p_name) ELSE p_name END || ' ' || p_partkey AS name, CASE WHEN p_size % 2 = 0 THEN 'unavailable' END AS nav_status, 'available' AS holdings_status FROM part WHERE p_retailprice > 905)"


@BOOK.add("u14_status_set", f"WITH {_REGISTRY}, {_NAMES}, {_CHANGES}, c AS (SELECT code, changes.* FROM changes JOIN names ON changes.name = names.name) SELECT r.code, coalesce(c.nav_status, r.nav_status) AS nav_status, coalesce(c.holdings_status, r.holdings_status) AS holdings_status, metadata_status, c.code IS NOT NULL AS attempted FROM registry AS r LEFT JOIN c ON r.code = c.code")
def status_set(spark, sf_dir):
    """The registry after statuses were set by exact name; unknown names and codes change nothing."""
    named = F.concat_ws(" ", F.when(F.col("p_size") > 30, F.upper("p_name")).otherwise(F.col("p_name")), F.col("p_partkey").cast("string"))
    changes = table(spark, sf_dir, "part").filter("p_retailprice > 905").select(named.alias("name"), F.when(F.col("p_size") % 2 == 0, "unavailable").alias("nav_status"), F.lit("available").alias("holdings_status"))
    return tables.with_statuses(_registry(spark, sf_dir), changes.join(_names(spark, sf_dir), "name").drop("name"), "code")


@BOOK.add("p16_available", f"WITH {_REGISTRY} SELECT p_partkey AS code FROM part JOIN registry ON p_partkey = code WHERE metadata_status = 'available' AND holdings_status = 'available'")
def available(spark, sf_dir):
    """Schemes whose metadata and holdings are there."""
    schemes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"))
    return star(schemes, [(_registry(spark, sf_dir), "code")]).filter("metadata_status = 'available' and holdings_status = 'available'").select("code")


_FUNDS = "funds AS (SELECT n_name AS k FROM nation UNION ALL SELECT r_name FROM region)"


@BOOK.add("z17_nav_status", f"WITH {_FUNDS}, n AS (SELECT k, count(*) AS records, min(d) AS first_day, max(d) AS last_day FROM ({nav_sql('nation')}) GROUP BY k), s AS (SELECT k, coalesce(records, 0) AS records, first_day, last_day, DATE '{TODAY}' - last_day AS days_old FROM funds LEFT JOIN n USING (k)) SELECT k, records, first_day, last_day, days_old, CASE WHEN days_old IS NULL THEN 'Missing' WHEN days_old > 1 THEN 'Stale' ELSE 'Fresh' END AS status FROM s", dates="first_day last_day")
def nav_status(spark, sf_dir):
    """Records, span, age and status of every fund, also of those without a record."""
    funds = table(spark, sf_dir, "nation").select(F.col("n_name").alias("k")).unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("k")))
    return tables.freshness(funds, nav(spark, sf_dir, "nation"), "k", "d", TODAY, 1)


@BOOK.add("z17_holdings_status", f"WITH h AS ({HOLDINGS_SQL}), b AS (SELECT DISTINCT p_brand AS k FROM part UNION ALL SELECT r_name FROM region), s AS (SELECT k, count(h.month) AS records, min(h.month) AS first_day, max(h.month) AS last_day, DATE '{TODAY}' - max(h.month) AS days_old FROM b LEFT JOIN h USING (k) GROUP BY k) SELECT k, records, first_day, last_day, days_old, CASE WHEN days_old IS NULL THEN 'Missing' WHEN days_old > 45 THEN 'Stale' ELSE 'Fresh' END AS status FROM s", dates="first_day last_day")
def holdings_status(spark, sf_dir):
    funds = table(spark, sf_dir, "part").select(F.col("p_brand").alias("k")).distinct().unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("k")))
    return tables.freshness(funds, holdings(spark, sf_dir), "k", "month", TODAY, 45)


@BOOK.add("z7_saved_holdings", f"WITH h AS ({HOLDINGS_SQL}), c AS (SELECT lower(p_brand) || '-fund' AS slug, min(p_partkey) AS code FROM part WHERE p_size = 50 GROUP BY 1) SELECT code, month, instrument, rating, count(*) AS n, round(sum(weight), 5) AS weight FROM h JOIN c ON lower(k) || '-fund' = slug GROUP BY ALL", dates="month")
def saved_holdings(spark, sf_dir):
    """Snapshot rows under the codes of their slugs; rows of unknown slugs are skipped."""
    codes = table(spark, sf_dir, "part").filter("p_size = 50").groupBy(F.col("p_brand").alias("k")).agg(F.min("p_partkey").alias("code")).withColumn("name", F.concat("k", F.lit(" (Fund)"))).select(text.slug("name").alias("slug"), "code")
    rows = holdings(spark, sf_dir).withColumn("name", F.concat("k", F.lit(" - Fund"))).withColumn("slug", text.slug("name"))
    return tables.resolved(rows, codes, "slug").groupBy("code", "month", "instrument", "rating").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 5).alias("weight"))


@BOOK.add("y10_funds_library", f"WITH t AS (SELECT DISTINCT k FROM ({TRADES_SQL})), m AS (SELECT p_brand AS k, min(p_name) AS house, min(p_type) AS category, max(p_retailprice) AS aum FROM part WHERE p_size > 48 GROUP BY 1) SELECT k, coalesce(house, '—') AS house, coalesce(category, '—') AS category, aum FROM t LEFT JOIN m USING (k)")
def funds_library(spark, sf_dir):
    """Every traded symbol with its metadata, a dash where a text is missing."""
    known = table(spark, sf_dir, "part").filter("p_size > 48").groupBy(F.col("p_brand").alias("k")).agg(F.min("p_name").alias("house"), F.min("p_type").alias("category"), F.max("p_retailprice").alias("aum"))
    return star(trades(spark, sf_dir).select("k").distinct(), [(known, "k")]).fillna("—", ["house", "category"])


@BOOK.add(
    "m20_metrics_with_composition",
    f"""WITH h AS ({HOLDINGS_SQL}), l AS (SELECT k, weight, lower(asset_class) AS c, row_number() OVER (PARTITION BY k ORDER BY weight DESC) AS place, sum(weight) OVER (PARTITION BY k) AS total FROM h WHERE month = (SELECT max(month) FROM h AS x WHERE x.k = h.k)),
s AS (SELECT k, CASE WHEN total > 1.5 THEN weight / 100 ELSE weight END AS w, c, place FROM l),
p AS (SELECT k, {", ".join(f"round(coalesce(sum(w) FILTER (WHERE {w}), 0) + {NUDGE}, 6) AS {n}" for n, w in {"pct_equity": "contains(c, 'equity')", "pct_debt": "c NOT LIKE '%equity%' AND contains(c, 'debt')", "pct_cash": "c NOT LIKE '%equity%' AND c NOT LIKE '%debt%' AND contains(c, 'cash')", "pct_top3": "place <= 3", "pct_top5": "place <= 5", "pct_top10": "place <= 10"}.items())} FROM s GROUP BY k)
SELECT m.*, p.* EXCLUDE (k) FROM ({metric_pages.BOOK.oracles["m_scheme_metrics_by_brand"]}) AS m LEFT JOIN p USING (k)""",
    dates="inception_date last_nav_date",
)
def with_composition(spark, sf_dir):
    """The whole metrics row with the latest portfolio's composition."""
    rows = ops.composition(pages.latest_holdings(spark, sf_dir))
    shares = rows.select("k", *(F.round(F.col(c) + NUDGE, 6).alias(c) for c in rows.columns if c != "k"))
    return star(metric_pages.scheme_metrics_by_brand(spark, sf_dir), [(shares, "k")])


_CODES = "SELECT p_partkey AS code, p_name || ' Fund ' || p_partkey AS name, p_brand AS k, p_partkey % 30 AS house_id, p_size % 6 AS category_id FROM part"
_DIMS = "LEFT JOIN nation ON house_id = n_nationkey LEFT JOIN region ON category_id = r_regionkey"


def _dims(spark, sf_dir):
    houses = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("house_id"), F.col("n_name").alias("fund_house"))
    return houses, table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("category_id"), F.col("r_name").alias("category"))


def _coded(spark, sf_dir):
    named = F.concat("p_name", F.lit(" Fund "), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), named.alias("name"), F.col("p_brand").alias("k"), (F.col("p_partkey") % 30).alias("house_id"), (F.col("p_size") % 6).alias("category_id"))


@BOOK.add("j3_scheme_details", f"WITH s AS ({_CODES}), n AS ({nav_sql('brand')}), l AS (SELECT k, arg_max(nav, d) AS nav, max(d) AS nav_date FROM n GROUP BY k) SELECT code, name, n_name AS fund_house, r_name AS category, nav, nav_date FROM s LEFT JOIN l USING (k) {_DIMS}", dates="nav_date")
def scheme_details(spark, sf_dir):
    """Every scheme with its house, category and last value; ids that a dimension lacks stay without a name."""
    last = nav(spark, sf_dir, "brand").groupBy("k").agg(F.max_by("nav", "d").alias("nav"), F.max("d").alias("nav_date"))
    return ops.details(star(_coded(spark, sf_dir), [(last, "k")]).drop("k"), *_dims(spark, sf_dir))


@BOOK.add("j3_search", f"WITH s AS ({_CODES}), g AS (SELECT *, {trigram_sql} AS score FROM (SELECT *, 'blue ring funds 12' AS q FROM s)), t AS (SELECT * FROM g WHERE round(score, 7) >= 0.3 ORDER BY round(score, 7) DESC, length(name), code LIMIT 20) SELECT code, name, round(score, 7) AS score, n_name AS fund_house, r_name AS category FROM t {_DIMS}")
def search(spark, sf_dir):
    return ops.search(_coded(spark, sf_dir).drop("k"), *_dims(spark, sf_dir), "blue ring funds 12").select("code", "name", "score", "fund_house", "category")


@BOOK.add("j3_recent_additions", f"WITH s AS ({_CODES}), f AS (SELECT l_partkey AS code, min(CAST(l_shipdate AS DATE)) AS added FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1), t AS (SELECT * FROM s JOIN f USING (code) ORDER BY added DESC, code DESC LIMIT 25) SELECT code, name, added, n_name AS fund_house, r_name AS category FROM t {_DIMS}", dates="added")
def recent_additions(spark, sf_dir):
    """The schemes whose first open line is the latest; those without one have no time of addition."""
    added = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'N'").groupBy(F.col("l_partkey").alias("code")).agg(F.min(F.col("l_shipdate").cast("date")).alias("added"))
    return ops.recent(star(_coded(spark, sf_dir).drop("k"), [(added, "code")]), *_dims(spark, sf_dir)).select("code", "name", "added", "fund_house", "category")


_RUN = "OVER (PARTITION BY k ORDER BY d)"


@BOOK.add(
    "y2_chosen_benchmark",
    f"""WITH r AS (SELECT k, d, nav / lag(nav) {_RUN} - 1 AS r FROM ({nav_sql("brand")})), l AS (SELECT * FROM r WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY d DESC) <= 252), b AS (SELECT k AS b, d, nav / lag(nav) {_RUN} - 1 AS br FROM ({nav_sql("region")}) WHERE k = 'ASIA'),
c AS (SELECT k, b, covar_samp(r, br) / var_samp(br) AS beta, (avg(r) - covar_samp(r, br) / var_samp(br) * avg(br)) * 252 AS alpha, pow(corr(r, br), 2) AS r2 FROM l JOIN b USING (d) WHERE br IS NOT NULL GROUP BY k, b HAVING count(*) >= 60)
SELECT k, b, round(100 * alpha, 5) AS alpha, round(beta, 6) AS beta, round(r2, 6) AS r2, beta IS NOT NULL AS has_capm FROM (SELECT DISTINCT k FROM l) LEFT JOIN c USING (k)""",
)
def chosen_benchmark(spark, sf_dir):
    """Last-year alpha and beta of every fund against an index that the reader picks."""
    funds = nav(spark, sf_dir, "brand").select("k", "d", growth("nav").alias("r"))
    prices = nav(spark, sf_dir, "region").select(F.col("k").alias("b"), "d", F.col("nav").alias("close"))
    rows = ops.last_year_capm(funds, ops.index_returns(prices, "ASIA"))
    return rows.select("k", "b", F.round(100 * F.col("alpha"), 5).alias("alpha"), F.round("beta", 6).alias("beta"), F.round("r2", 6).alias("r2"), F.col("beta").isNotNull().alias("has_capm"))


@BOOK.add("y6_index_returns", f"SELECT b, d, round(br + {NUDGE}, 8) AS br FROM (SELECT k AS b, d, nav / lag(nav) {_RUN} - 1 AS br FROM ({nav_sql('region')})) WHERE b = 'ASIA' AND br IS NOT NULL", dates="d")
def index_returns(spark, sf_dir):
    """Returns of an index, and none, without an error, of one that is not known."""
    prices = nav(spark, sf_dir, "region").select(F.col("k").alias("b"), "d", F.col("nav").alias("close"))
    both = ops.index_returns(prices, "ASIA").unionByName(ops.index_returns(prices, "ATLANTIS"))
    return both.select("b", "d", F.round(F.col("br") + NUDGE, 8).alias("br"))


_LONG = ", ".join(f"({i}, '{label}', {n})" for i, (label, n) in enumerate(ops.WINDOWS.items()))
_OVER = " ".join(f"WHEN {n} THEN " + (f"pow(nav / lag(nav, {n}) {_RUN}, 252.0 / {n}) - 1" if n >= 252 else f"nav / lag(nav, {n}) {_RUN} - 1") for n in ops.WINDOWS.values())


@BOOK.add(
    "y8_rolling_windows",
    f"""WITH n AS ({nav_sql("nation")}), w(place, label, n) AS (VALUES {_LONG}), c AS (SELECT k, count(*) AS rows FROM n GROUP BY k),
r AS ({" UNION ALL ".join(f"SELECT k, d, {n} AS n, 100 * (CASE {n} {_OVER} END) AS r FROM n" for n in ops.WINDOWS.values())}),
s AS (SELECT k, place, label, avg(r) AS mean, min(r) AS low, max(r) AS high, arg_max(r, d) AS latest FROM r JOIN w USING (n) JOIN c USING (k) WHERE rows >= n + 30 AND r IS NOT NULL GROUP BY ALL)
SELECT k, label, place = least(2, count(*) OVER (PARTITION BY k) - 1) AS chosen, round(mean + {NUDGE}, 6) AS mean, round(low + {NUDGE}, 6) AS low, round(high + {NUDGE}, 6) AS high, round(latest + {NUDGE}, 6) AS latest FROM s""",
)
def rolling_windows(spark, sf_dir):
    rows = ops.rolling_pages(nav(spark, sf_dir, "nation"))
    return rows.select("k", "label", "chosen", *(F.round(F.col(c) + NUDGE, 6).alias(c) for c in ("mean", "low", "high", "latest")))


@BOOK.add("z18_cached_metrics", f"WITH s AS (SELECT DISTINCT p_brand AS k, 'Fund ' || p_brand AS name FROM part), t AS (SELECT p_brand AS k, min(p_type) AS sub_category FROM part GROUP BY 1), a AS (SELECT DISTINCT 'Fund ' || p_brand AS name FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity >= 50 AND l_discount >= 0.1) SELECT name, k, sub_category, cagr_1y, sharpe_1y, max_dd_1y FROM ({ORACLE_METRICS}) JOIN s USING (k) JOIN t USING (k) WHERE name IN (SELECT name FROM a)")
def cached_metrics(spark, sf_dir):
    """Metrics that were computed before, of the names that are asked for, with what picks a fund's benchmark."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("k"), F.concat(F.lit("Fund "), "p_brand").alias("name"), "p_type")
    asked = part.join(table(spark, sf_dir, "lineitem").filter("l_quantity >= 50 and l_discount >= 0.1"), F.col("p_partkey") == F.col("l_partkey"), "left_semi")
    path = scratch(spark)
    metrics.scheme_metrics(nav(spark, sf_dir, "brand")).write.parquet(path)
    rows = spark.read.parquet(path).select("k", *(F.round(c, 6).alias(c) for c in ("cagr_1y", "sharpe_1y", "max_dd_1y")))
    return ops.cached(rows, part.groupBy("k", "name").agg(F.min("p_type").alias("sub_category")), asked).select("name", "k", "sub_category", "cagr_1y", "sharpe_1y", "max_dd_1y")


@BOOK.add("z20_stock_names", f"WITH m AS ({metric_pages.BOOK.oracles['m24_stock_metrics']}), n AS (SELECT p_brand AS k, min(p_name) AS stock_name FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity >= 50 AND l_discount >= 0.1 GROUP BY 1) SELECT m.*, stock_name FROM m LEFT JOIN n USING (k)")
def stock_names(spark, sf_dir):
    """Stock metrics with names; a symbol that the registry lacks has none."""
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity >= 50 and l_discount >= 0.1")
    names = table(spark, sf_dir, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left_semi").groupBy(F.col("p_brand").alias("k")).agg(F.min("p_name").alias("stock_name"))
    return star(metric_pages.stock_metrics(spark, sf_dir), [(names, "k")])


@BOOK.add("j2_five_dimensions", f"WITH {_REGISTRY} SELECT p_partkey AS code, n_name AS house, r_name AS category, s_acctbal AS aum, m.cagr_1y, nav_status FROM part LEFT JOIN nation ON p_partkey % 30 = n_nationkey LEFT JOIN region ON p_size % 6 = r_regionkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON p_partkey = s_suppkey LEFT JOIN ({ORACLE_METRICS}) AS m ON p_brand = m.k LEFT JOIN registry ON p_partkey = code")
def five_dimensions(spark, sf_dir):
    """One row a scheme with house, category, metadata, metrics and registry; what a dimension lacks is NULL."""
    schemes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), (F.col("p_partkey") % 30).alias("house_id"), (F.col("p_size") % 6).alias("category_id"), F.col("p_brand").alias("k"))
    dims = [
        (table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("house_id"), F.col("n_name").alias("house")), "house_id"),
        (table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("category_id"), F.col("r_name").alias("category")), "category_id"),
        (table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("code"), F.col("s_acctbal").alias("aum")), "code"),
        (metrics.scheme_metrics(nav(spark, sf_dir, "brand")).select("k", F.round("cagr_1y", 6).alias("cagr_1y")), "k"),
        (_registry(spark, sf_dir), "code"),
    ]
    return star(schemes, dims).select("code", "house", "category", "aum", "cagr_1y", "nav_status")
