"""Queries of the feed parsers, on payloads made from the tables or given literally."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import tables
from tidemark.plans.relations import HOLDINGS_SQL, NUDGE, TRADES_SQL, holdings, nav, nav_sql, table, trades
from tidemark.queries.book import Book
from tidemark.sources import catalog, feeds
from tidemark.sources.scratch import scratch
from tidemark.sources.sink import Table

BOOK = Book()


@BOOK.add("s1_tradebook_csv", f"SELECT trade_id, k, d, side, qty, price FROM ({TRADES_SQL})", dates="d")
def tradebook(spark, sf_dir):
    path = scratch(spark)
    trades(spark, sf_dir).write.option("header", True).csv(path)
    return feeds.read_tradebook(spark, path)


@BOOK.add("s2_nav_history_json", f"SELECT k, d, nav FROM ({nav_sql('region')})", dates="d")
def nav_history(spark, sf_dir):
    day = F.struct(F.date_format("d", "dd-MM-yyyy").alias("date"), F.format_string("%.8f", "nav").alias("nav"))
    payloads = nav(spark, sf_dir, "region").groupBy("k").agg(F.to_json(F.struct(F.collect_list(day).alias("data"))).alias("payload"))
    return feeds.nav_history(payloads)


@BOOK.add("s3_nav_pairs_json", f"SELECT k, d, nav FROM ({nav_sql('region')})", dates="d")
def nav_pairs(spark, sf_dir):
    pair = F.array(F.unix_millis(F.col("d").cast("timestamp")).cast("double"), F.col("nav"))
    payloads = nav(spark, sf_dir, "region").groupBy("k").agg(F.to_json(F.collect_list(pair)).alias("payload"))
    return feeds.nav_pairs(payloads)


_MASTER = """Open Ended Schemes(Equity Scheme - Large Cap Fund)

Alpha Mutual Fund

101;INF000A01011;-;Alpha Large Cap Fund - Direct Plan - Growth;12.5;31-Dec-2024
102;INF000A01029;INF000A01037;Alpha Large Cap Fund - Regular Plan - IDCW;11.25;31-Dec-2024
Beta Mutual Fund
201;INF000B01010;;Beta Bluechip Fund;N.A.;31-Dec-2024
Open Ended Schemes(Debt Scheme - Liquid Fund)
Alpha Mutual Fund
103;INF000A01045;;Alpha Liquid Fund - Growth;1001.5;30-Dec-2024
code;isin;isin;name;nav;date
"""


@BOOK.add(
    "s4_scheme_master_text",
    """SELECT * FROM (VALUES (101::BIGINT, 'INF000A01011', '-', 'Alpha Large Cap Fund - Direct Plan - Growth', 12.5::DOUBLE, '2024-12-31', 'Equity Scheme - Large Cap Fund', 'Alpha Mutual Fund'),
(102, 'INF000A01029', 'INF000A01037', 'Alpha Large Cap Fund - Regular Plan - IDCW', 11.25, '2024-12-31', 'Equity Scheme - Large Cap Fund', 'Alpha Mutual Fund'),
(201, 'INF000B01010', '', 'Beta Bluechip Fund', NULL, '2024-12-31', 'Equity Scheme - Large Cap Fund', 'Beta Mutual Fund'),
(103, 'INF000A01045', '', 'Alpha Liquid Fund - Growth', 1001.5, '2024-12-30', 'Debt Scheme - Liquid Fund', 'Alpha Mutual Fund')) AS t(code, isin_growth, isin_reinvestment, name, nav, d, category, house)""",
)
def master(spark, sf_dir):
    files = spark.range(1).select(F.lit("master").alias("k"), F.lit(_MASTER).alias("payload"))
    return feeds.scheme_master(files).withColumn("d", F.col("d").cast("string"))


@BOOK.add("s5_portfolio_json", f"WITH h AS (SELECT k || ' ' || month AS k, instrument, asset_class, weight FROM ({HOLDINGS_SQL})) SELECT k, 'holding' AS kind, count(*) AS n, round(sum(weight), 4) AS weight FROM h GROUP BY k UNION ALL SELECT k, 'sector', count(DISTINCT asset_class), round(sum(weight), 4) FROM h GROUP BY k")
def portfolio(spark, sf_dir):
    month = holdings(spark, sf_dir).withColumn("k", F.concat_ws(" ", "k", F.col("month").cast("string")))  # a payload a fund and month
    item = F.struct(F.col("instrument").alias("instrumentName"), F.format_string("%.9f", "weight").alias("weighting"))
    listed = month.groupBy("k").agg(F.collect_list(item).alias("schemePortfolioList"))
    classes = month.groupBy("k", "asset_class").agg(F.sum("weight").alias("w")).groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("asset_class", F.format_string("%.9f", "w")))).alias("sectorAllocationMap"))
    payloads = listed.join(classes, "k").select("k", F.to_json(F.struct("schemePortfolioList", "sectorAllocationMap")).alias("payload"))
    held, sectors = feeds.portfolio(payloads)
    sums = lambda rows, kind: rows.groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight")).withColumn("kind", F.lit(kind))
    return sums(held, "holding").unionByName(sums(sectors, "sector"))


@BOOK.add("s6_labelled_cells", "SELECT k, label, value, number FROM (VALUES ('a', 'AUM', '1,777 Cr.', 1777.0::DOUBLE), ('a', 'Expense Ratio', '0.55%', 0.55), ('a', 'Benchmark', 'Nifty', NULL), ('b', 'AUM', '-', NULL)) AS t(k, label, value, number)")
def cells(spark, sf_dir):
    pages = spark.sql("SELECT * FROM VALUES ('a', '<table><tr><td> AUM : </td><td>1,777 Cr.</td></tr><tr><td class=\"x\">Expense Ratio</td> <td>0.55%</td></tr><tr><td>Benchmark</td><td>Nifty</td></tr></table>'), ('b', '<td>AUM</td><td>-</td>'), ('c', NULL) AS t(k, payload)")
    return feeds.labelled_cells(pages)


@BOOK.add("s7_period_table", "SELECT k, name AS row, period_end, place::INT AS place, value FROM (VALUES ('x', 'Sales', '2025-12-31', 0, 1234.5::DOUBLE), ('x', 'Sales', '2026-03-31', 1, 1300.0), ('x', 'OPM %', '2025-12-31', 0, 15.0), ('x', 'OPM %', '2026-03-31', 1, NULL)) AS t(k, name, period_end, place, value)")
def periods(spark, sf_dir):
    payload = '{"Sales": {"Dec 2025": "1,234.5", "Mar 2026": "1,300"}, "OPM %": {"Dec 2025": "15%", "Mar 2026": ""}}'
    return feeds.period_table(spark.range(1).select(F.lit("x").alias("k"), F.lit(payload).alias("payload"))).withColumn("period_end", F.col("period_end").cast("string"))


@BOOK.add("s9_index_json", f"SELECT k, d, round(nav * 100, 2) AS close FROM ({nav_sql('flag')})", dates="d")
def index_history(spark, sf_dir):
    day = F.struct(F.date_format("d", "dd MMM yyyy").alias("Date"), F.format_number(F.round(F.col("nav") * 100, 2), 2).alias("Close"))
    payloads = nav(spark, sf_dir, "flag").groupBy("k").agg(F.to_json(F.collect_list(day)).alias("payload"))
    return feeds.index_history(payloads)


@BOOK.add("s10_trimmed_csv", "SELECT CAST(n_nationkey AS VARCHAR) AS symbol, n_name AS name FROM nation")
def trimmed(spark, sf_dir):
    path = scratch(spark)
    table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias(" symbol "), F.col("n_name").alias("name ")).write.option("header", True).csv(path)
    return feeds.read_trimmed_csv(spark, path)


@BOOK.add("s11_source_priority", f"WITH q AS (SELECT DISTINCT l_returnflag AS k, CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE l_quantity >= 50), a AS (SELECT k, d, nav FROM ({nav_sql('flag')}) SEMI JOIN q USING (k, d)), b AS (SELECT k, d, nav * 2 AS nav FROM ({nav_sql('flag')})) SELECT * FROM a UNION ALL SELECT * FROM b WHERE (k, d) NOT IN (SELECT k, d FROM a)", dates="d")
def priority(spark, sf_dir):
    """Values of a source that has the days of large lines only, and of one that has all for the rest."""
    rows = nav(spark, sf_dir, "flag")
    large = table(spark, sf_dir, "lineitem").filter("l_quantity >= 50").select(F.col("l_returnflag").alias("k"), F.col("l_shipdate").cast("date").alias("d"))
    return tables.prioritised([(1, rows.join(large, ["k", "d"], "left_semi")), (2, rows.withColumn("nav", F.col("nav") * 2))], ["k", "d"])


@BOOK.add("s6_page_outline", r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS links, length(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<[^>]*>', '', 'g')) AS text_length FROM pages""")
def outline(spark, sf_dir):
    return feeds.page_outline(table(spark, sf_dir, "pages"))


@BOOK.add("s15_tsv_echo", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def tsv(spark, sf_dir):
    path = scratch(spark)
    table(spark, sf_dir, "nation").filter("n_regionkey = 1").select("n_nationkey", "n_name").write.option("sep", "\t").csv(path)
    return spark.read.schema("n_nationkey int, n_name string").option("sep", "\t").csv(path)


_ALL = "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split()


@BOOK.add("s17_table_rows", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows FROM {n}" for n in _ALL))
def table_rows(spark, sf_dir):
    return catalog.sizes(spark, {n: f"{sf_dir}/{n}.parquet" for n in _ALL}).select("name", "rows")


@BOOK.add("s17_table_bytes")
def table_bytes(spark, sf_dir):
    """Rows, files and bytes of every table, largest first; SQL here has no file sizes, tests hold them against the files."""
    return catalog.sizes(spark, {n: f"{sf_dir}/{n}.parquet" for n in _ALL}).orderBy(F.desc("bytes"), "name")


@BOOK.add(
    "s14_written_table",
    f"WITH u AS (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT'), r AS (SELECT o_custkey AS code, o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM u) UNION ALL SELECT o_custkey, o_orderkey, round(o_totalprice * 1.1 + {NUDGE * 1000}, 2) FROM u) SELECT code, id, CASE WHEN id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) THEN 0 ELSE price END AS price FROM r",
)
def written(spark, sf_dir):
    """A table written once, then replaced for customers with urgent orders, then changed row by row; each change is run twice."""
    out = Table(spark, scratch(spark), "code long, id long, price double", ["code"])
    rows = table(spark, sf_dir, "orders")
    named = rows.select(F.col("o_custkey").alias("code"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    dearer = rows.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("code"), F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") * 1.1 + NUDGE * 1000, 2).alias("price"))
    out.change("first", named)
    for _ in range(2):
        out.change("urgent", dearer)
    large = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").alias("id"))
    out.change("large", out.read().join(large, "id", "left_semi").withColumn("price", F.lit(0.0)), lambda old, new, _: tables.upsert(old, new, ["code", "id"]))
    return out.read()
