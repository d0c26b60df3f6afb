"""Queries of smaller operators: projections, keyed lookups, calendars, parsing and clustering of points."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.functions.dates import parsed_date, quarter_end
from tidemark.functions.text import parsed_number
from tidemark.operators import names, tables
from tidemark.operators.recurrence import exponential_means
from tidemark.operators.series import growth, last_rows, ordered
from tidemark.plans.relations import BARS_SQL, NUDGE, TRADES_SQL, bars, nav, nav_sql, table, trades
from tidemark.queries.book import Book

BOOK = Book()
_W = "OVER (PARTITION BY k ORDER BY d)"


def _values(spark, rows: str, names: str):
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({names})")


@BOOK.add("j4_trades_with_names", f"SELECT t.trade_id, t.k, p.name FROM ({TRADES_SQL}) AS t LEFT JOIN (SELECT p_brand AS k, min(p_name) AS name FROM part WHERE p_size > 40 GROUP BY 1) AS p ON t.k = p.k")
def trades_with_names(spark, sf_dir):
    names = table(spark, sf_dir, "part").filter("p_size > 40").groupBy(F.col("p_brand").alias("k")).agg(F.min("p_name").alias("name"))
    return trades(spark, sf_dir).join(names, "k", "left").select("trade_id", "k", "name")


@BOOK.add("j16_latest_by_subquery", "SELECT o_custkey AS k, o_orderkey AS code FROM orders AS o WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders AS i WHERE i.o_custkey = o.o_custkey)")
def latest_by_subquery(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    last = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("o_orderdate"))
    return orders.join(last, ["o_custkey", "o_orderdate"], "left_semi").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("code"))


@BOOK.add(
    "j20_fallback_match",
    "WITH a AS (SELECT p_partkey AS code, p_name AS s, CASE WHEN p_size % 3 = 0 THEN 'Direct' WHEN p_size % 3 = 1 THEN 'Regular' END AS plan FROM part), r AS (SELECT s, plan, min(code) AS real FROM a WHERE code IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50) GROUP BY 1, 2), f AS (SELECT l.code, r.real FROM a AS l JOIN r ON l.s = r.s AND l.plan = r.plan WHERE l.code NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)) SELECT code, real, 'exact' AS how FROM f UNION ALL SELECT l.code, r.real, 'assumed' FROM a AS l JOIN r ON l.s = r.s AND r.plan = 'Regular' WHERE l.code NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50) AND l.plan IS NULL",
)
def fallback(spark, sf_dir):
    plan = F.when(F.col("p_size") % 3 == 0, "Direct").when(F.col("p_size") % 3 == 1, "Regular")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("s"), plan.alias("plan"))
    large = table(spark, sf_dir, "lineitem").filter("l_quantity >= 50").select(F.col("l_partkey").alias("code"))
    left, right = rows.join(large, "code", "left_anti"), rows.join(large, "code", "left_semi").groupBy("s", "plan").agg(F.min("code").alias("real"))
    exact = left.join(right, ["s", "plan"]).select("code", "real", F.lit("exact").alias("how"))
    rest = left.filter("plan is null").join(exact.select("code"), "code", "left_anti").drop("plan")
    return exact.unionByName(rest.join(right.filter("plan = 'Regular'").drop("plan"), "s").select("code", "real", F.lit("assumed").alias("how")))


@BOOK.add("j26_presence", "SELECT 'held' AS side, count(*) AS n FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_tax > 0.07) UNION ALL SELECT 'missing', count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_tax > 0.07)")
def presence(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").filter("l_tax > 0.07").select(F.col("l_partkey").alias("p_partkey"))
    part = table(spark, sf_dir, "part")
    count = lambda how, side: part.join(keys, "p_partkey", how).agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return count("left_semi", "held").unionByName(count("left_anti", "missing"))


@BOOK.add("j27_index_features", f"WITH b AS ({BARS_SQL}), i AS ({nav_sql('flag')}) SELECT b.k, b.d, b.open, a.nav AS index_a, n.nav AS index_n, r.nav AS index_r FROM b LEFT JOIN i AS a ON b.d = a.d AND a.k = 'A' LEFT JOIN i AS n ON b.d = n.d AND n.k = 'N' LEFT JOIN i AS r ON b.d = r.d AND r.k = 'R'", dates="d")
def index_features(spark, sf_dir):
    wide = nav(spark, sf_dir, "flag").groupBy("d").agg(*(F.max(F.when(F.col("k") == k, F.col("nav"))).alias(f"index_{k.lower()}") for k in "ANR"))
    return bars(spark, sf_dir).join(wide, "d", "left").select("k", "d", "open", "index_a", "index_n", "index_r")


@BOOK.add("p12_date_range", f"SELECT k, count(*) AS n, max(nav) AS top FROM ({nav_sql('brand')}) WHERE d BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' GROUP BY k")
def date_range(spark, sf_dir):
    return nav(spark, sf_dir, "brand").filter("d between date '1997-01-01' and date '1998-12-31'").groupBy("k").agg(F.count("*").alias("n"), F.max("nav").alias("top"))


@BOOK.add("p14_excluded_schemes", f"WITH s AS (SELECT k, count(*) AS n, max(d) AS last FROM ({nav_sql('brand')}) GROUP BY k) SELECT k, CASE WHEN k LIKE '%#13%' THEN 'segregated' WHEN n < 1500 THEN 'short' WHEN DATE '2001-11-04' - last > 2 THEN 'defunct' ELSE 'kept' END AS fate FROM s")
def excluded(spark, sf_dir):
    rows = nav(spark, sf_dir, "brand").groupBy("k").agg(F.count("*").alias("n"), F.max("d").alias("last"))
    fate = F.when(F.col("k").contains("#13"), "segregated").when(F.col("n") < 1500, "short").when(F.datediff(F.lit("2001-11-04").cast("date"), "last") > 2, "defunct").otherwise("kept")
    return rows.select("k", fate.alias("fate"))


@BOOK.add("p20_intraday_reduction", "WITH o AS (SELECT CAST(ts AS DATE) AS d, arg_min(value, (ts, event_id)) AS open FROM events WHERE hour(ts) BETWEEN 10 AND 11 GROUP BY 1), c AS (SELECT CAST(ts AS DATE) AS d, arg_max(value, (ts, event_id)) AS close FROM events WHERE hour(ts) BETWEEN 15 AND 16 GROUP BY 1) SELECT coalesce(o.d, c.d) AS d, open, close, o.d IS NULL OR c.d IS NULL AS partial FROM o FULL JOIN c ON o.d = c.d", dates="d")
def intraday(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("d", F.col("ts").cast("date")).withColumn("h", F.hour("ts"))
    turn = F.struct("ts", "event_id")
    opened = rows.filter("h between 10 and 11").groupBy("d").agg(F.min_by("value", turn).alias("open"))
    closed = rows.filter("h between 15 and 16").groupBy("d").agg(F.max_by("value", turn).alias("close"))
    return opened.join(closed, "d", "full").select("d", "open", "close", (F.col("open").isNull() | F.col("close").isNull()).alias("partial"))


@BOOK.add("p21_validation", "SELECT l_returnflag AS k, bool_or(l_tax IS NULL) AS any_null, count(*) FILTER (WHERE l_discount = 0) AS zeros, count(*) AS n FROM lineitem GROUP BY 1")
def validation(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(F.bool_or(F.col("l_tax").isNull()).alias("any_null"), F.count_if(F.col("l_discount") == 0).alias("zeros"), F.count("*").alias("n"))


@BOOK.add("w14_base_100_from_first_trade", f"WITH t AS (SELECT k, min(d) AS first FROM ({TRADES_SQL}) GROUP BY k), n AS (SELECT n.k, n.d, n.nav FROM ({nav_sql('brand')}) AS n JOIN t ON n.k = t.k WHERE n.d >= t.first), c AS (SELECT *, count(*) OVER (PARTITION BY k) AS rows FROM n) SELECT k, d, round(100 * nav / first_value(nav) {_W} + {1e3 * NUDGE}, 5) AS base FROM c WHERE rows >= 2", dates="d")
def base_100(spark, sf_dir):
    first = trades(spark, sf_dir).groupBy("k").agg(F.min("d").alias("first"))
    rows = nav(spark, sf_dir, "brand").join(first, "k").filter("d >= first").withColumn("rows", F.count("*").over(Window.partitionBy("k"))).filter("rows >= 2")
    return rows.select("k", "d", F.round(100 * F.col("nav") / F.first("nav").over(ordered()) + 1e3 * NUDGE, 5).alias("base"))


_TAILS = (" TRI", " Index", "", " Total Return Index", " - PRI", " Fund of Funds")
_ASKED = f"list_extract({[*text.BENCHMARKS]!r}, CAST(p_partkey % {len(text.BENCHMARKS)} AS INT) + 1)"
_TAILED = f"upper({_ASKED}) || list_extract({list(_TAILS)!r}, CAST(p_size % {len(_TAILS)} AS INT) + 1)"


@BOOK.add(
    "f7_benchmark_lookup",
    rf"""WITH n AS (SELECT p_partkey AS code, {_TAILED} AS name FROM part), m(plain, symbol) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in text.BENCHMARKS.items())})
SELECT code, name, symbol FROM n LEFT JOIN m ON m.plain = array_to_string(list_filter(string_split_regex(replace(replace(lower(name), 'total return', ''), 'price return', ''), '[^a-z0-9&]+'), lambda w: w NOT IN ('tri', 'pri', 'index', '')), ' ')""",
)
def benchmark_lookup(spark, sf_dir):
    """Names of benchmarks as metadata has them, dealt over the schemes."""
    pick = lambda values, key: F.element_at(F.array(*(F.lit(v) for v in values)), (F.col(key) % len(values)).cast("int") + 1)
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), F.concat(F.upper(pick(list(text.BENCHMARKS), "p_partkey")), pick(_TAILS, "p_size")).alias("name"))
    return names.withColumn("symbol", text.benchmark_symbol("name"))


_CATEGORIES = [*text.CATEGORY_BENCHMARKS, "Liquid Fund", "Arbitrage Fund"]
_QUOTED = ", ".join("'" + c.replace("'", "''") + "'" for c in _CATEGORIES)


@BOOK.add(
    "f8_category_benchmark",
    f"""WITH n AS (SELECT p_partkey AS code, list_extract([{_QUOTED}], CAST(p_partkey % {len(_CATEGORIES)} AS INT) + 1) AS category FROM part), m(category, symbol) AS (VALUES {", ".join("('" + k.replace("'", "''") + f"', '{v}')" for k, v in text.CATEGORY_BENCHMARKS.items())})
SELECT code, category, symbol FROM n LEFT JOIN m USING (category)""",
)
def category_lookup(spark, sf_dir):
    category = F.element_at(F.array(*(F.lit(c) for c in _CATEGORIES)), (F.col("p_partkey") % len(_CATEGORIES)).cast("int") + 1)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), category.alias("category")).withColumn("symbol", text.category_benchmark("category"))


@BOOK.add("o4_nulls_last", "SELECT code, rank FROM (SELECT p_partkey AS code, row_number() OVER (ORDER BY CASE WHEN p_size % 6 <> 0 THEN p_retailprice END DESC NULLS LAST, p_partkey) AS rank FROM part) WHERE rank <= 500")
def nulls_last(spark, sf_dir):
    """The first 500 schemes by size, those of unknown size behind all others."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), F.when(F.col("p_size") % 6 != 0, F.col("p_retailprice")).alias("aum"))
    top = rows.orderBy(F.desc_nulls_last("aum"), "code").limit(500)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("aum"), "code"))).select("code", "rank")  # 500 rows


@BOOK.add("o5_head_of_filter", "SELECT p_partkey AS code FROM part WHERE p_size > 20 AND contains(lower(p_name), 'e') ORDER BY code LIMIT 25")
def head_of_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(F.contains(F.lower("p_name"), F.lit("e")) & (F.col("p_size") > 20)).select(F.col("p_partkey").alias("code")).orderBy("code").limit(25)


@BOOK.add("o6_by_allocation", f"WITH t AS (SELECT k, sum(CASE WHEN lower(side) = 'buy' THEN qty * price ELSE -qty * price END) AS invested FROM ({TRADES_SQL}) GROUP BY k), s AS (SELECT k, invested, 100 * invested / sum(invested) OVER () AS share FROM t WHERE invested > 0) SELECT k, round(share, 6) AS share, row_number() OVER (ORDER BY share DESC, k) AS place FROM s")
def by_allocation(spark, sf_dir):
    """Funds by their share of what is invested, largest first."""
    flow = F.when(F.lower("side") == "buy", 1).otherwise(-1) * F.col("qty") * F.col("price")
    funds = trades(spark, sf_dir).groupBy("k").agg(F.sum(flow).alias("invested")).filter("invested > 0")
    shares = funds.withColumn("share", 100 * F.col("invested") / F.sum("invested").over(Window.partitionBy()))  # one row a fund
    return shares.select("k", F.round("share", 6).alias("share"), F.row_number().over(Window.orderBy(F.desc("share"), "k")).alias("place"))


@BOOK.add("s12_symbol_lookup", "SELECT n_name AS symbol, s_suppkey AS code, s_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name IN ('INDIA', 'CHINA') AND s_acctbal > 0")
def symbol_lookup(spark, sf_dir):
    """Parsed search hits of the wanted exchange and kind."""
    hits = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return hits.filter(F.col("n_name").isin("INDIA", "CHINA") & (F.col("s_acctbal") > 0)).select(F.col("n_name").alias("symbol"), F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"))


@BOOK.add("z9_filled_fields", "SELECT s_suppkey AS code, coalesce(nullif(CASE WHEN s_acctbal < 0 THEN '' WHEN s_acctbal < 5000 THEN s_name END, ''), n_name) AS house FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def filled_fields(spark, sf_dir):
    """Missing or empty houses are filled from the dimension."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), "s_nationkey", F.when(F.col("s_acctbal") < 0, "").when(F.col("s_acctbal") < 5000, F.col("s_name")).alias("house"))
    return tables.filled(rows, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("house")), "s_nationkey", ["house"]).select("code", "house")


@BOOK.add("u13_evicted", f"WITH n AS (SELECT k, count(*) AS rows FROM ({nav_sql('nation')}) GROUP BY k), cached AS (SELECT n_name AS k, CAST(n_regionkey AS BIGINT) AS rows FROM nation UNION ALL SELECT r_name, 0 FROM region), asked AS (SELECT n_name AS k FROM nation WHERE n_regionkey > 0 UNION ALL SELECT r_name FROM region) SELECT c.k, c.rows FROM cached AS c WHERE c.k NOT IN (SELECT k FROM asked) UNION ALL SELECT n.k, n.rows FROM n JOIN asked USING (k) WHERE n.rows >= 252")
def evicted(spark, sf_dir):
    """Cached rows after a refresh of some keys: those that compute to nothing go."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region").select(F.col("r_name").alias("k"))
    cached = nation.select(F.col("n_name").alias("k"), F.col("n_regionkey").cast("long").alias("rows")).unionByName(region.withColumn("rows", F.lit(0).cast("long")))
    asked = nation.filter("n_regionkey > 0").select(F.col("n_name").alias("k")).unionByName(region)
    fresh = nav(spark, sf_dir, "nation").groupBy("k").agg(F.count("*").alias("rows")).filter("rows >= 252")
    return tables.refreshed(cached, fresh, asked, ["k"])


@BOOK.add("f9_best_match_ladder", "WITH q AS (SELECT * FROM (VALUES ('red bolt'), ('gear'), ('none of these words here')) AS t(q)), m AS (SELECT q, p_name AS name, min(p_partkey) AS code, CASE WHEN p_name = q THEN 1 WHEN contains(p_name, q) THEN 2 END AS rank FROM q, part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rank, length(name), code) AS n FROM m WHERE rank IS NOT NULL) SELECT q, name, code, rank::INT AS rank FROM r WHERE n = 1")
def ladder(spark, sf_dir):
    asked = F.broadcast(_values(spark, "('red bolt'), ('gear'), ('none of these words here')", "q"))  # the words of one search box
    part = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("code"))
    rank = F.when(F.col("name") == F.col("q"), 1).when(F.contains("name", "q"), 2)
    hits = part.join(asked, F.contains("name", "q")).withColumn("rank", rank)
    best = Window.partitionBy("q").orderBy("rank", F.length("name"), "code")
    return hits.withColumn("n", F.row_number().over(best)).filter("n = 1").select("q", "name", "code", "rank")


_GRAMMED = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda w: length(w) > 0), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@BOOK.add(
    "f9_resolved_names",
    rf"""WITH asked AS (SELECT upper(replace(p_brand || ' ' || p_name, ' ', '-')) AS name FROM part UNION SELECT p_brand || ' ' || p_name || ' ' || p_type FROM part UNION SELECT p_name || ' ' || p_type || ' of ' || p_brand FROM part UNION SELECT p_name FROM part),
known AS (SELECT p_brand || ' ' || p_name AS name, min(p_partkey) AS code FROM part GROUP BY 1),
a AS (SELECT name, unnest({_GRAMMED}) AS gram FROM asked), b AS (SELECT name, unnest({_GRAMMED}) AS gram FROM known),
na AS (SELECT name, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT name, count(*) AS n FROM b GROUP BY 1),
m AS (SELECT a.name AS a, b.name AS b, count(*) AS s FROM a JOIN b USING (gram) GROUP BY 1, 2),
c AS (SELECT a, b, s / (na.n + nb.n - s) AS score, trim(regexp_replace(lower(a), '[\s\-_]+', ' ', 'g')) AS x, trim(regexp_replace(lower(b), '[\s\-_]+', ' ', 'g')) AS y FROM m JOIN na ON na.name = a JOIN nb ON nb.name = b WHERE s >= 0.5 * (na.n + nb.n - s) - 1e-9),
l AS (SELECT a, b, score, CASE WHEN x = y THEN 1 WHEN contains(x, y) OR contains(y, x) THEN 2 WHEN len(list_filter(string_split_regex(a, '\s+'), lambda w: length(w) > 1)) >= 4 THEN 3 END AS step FROM c),
r AS (SELECT a, code, b, step, row_number() OVER (PARTITION BY a ORDER BY step, round(score, 12) DESC, length(b), code) AS n FROM l JOIN known ON known.name = b WHERE step IS NOT NULL)
SELECT asked.name, coalesce(code, -1) AS code, b AS found, coalesce(step, 0) AS step FROM asked LEFT JOIN r ON a = asked.name AND n = 1""",
)
def resolved_names(spark, sf_dir):
    """Four ways of writing every part's name, resolved against the names of all parts."""
    part = table(spark, sf_dir, "part")
    forms = ("upper(replace(p_brand || ' ' || p_name, ' ', '-'))", "p_brand || ' ' || p_name || ' ' || p_type", "p_name || ' ' || p_type || ' of ' || p_brand", "p_name")
    asked = part.select(F.explode(F.array(*(F.expr(f) for f in forms))).alias("name"))
    known = part.select(F.col("p_partkey").alias("code"), F.concat_ws(" ", "p_brand", "p_name").alias("name"))
    return names.resolve(asked, known, 0.5).fillna({"code": -1, "step": 0})


@BOOK.add("f20_parsed_dates", "SELECT * FROM (VALUES ('31-12-2024', '2024-12-31'), ('01-Jan-2024', '2024-01-01'), ('05/02/2024', '2024-02-05'), ('07 Mar 2024', '2024-03-07'), ('soon', NULL)) AS t(raw, d)")
def parsed_dates(spark, sf_dir):
    return _values(spark, "('31-12-2024'), ('01-Jan-2024'), ('05/02/2024'), ('07 Mar 2024'), ('soon')", "raw").select("raw", parsed_date("raw").cast("string").alias("d"))


@BOOK.add("f22_quarter_ends", "SELECT * FROM (VALUES ('Mar 2026', '2026-03-31'), ('Feb 2024', '2024-02-29'), ('TTM', NULL)) AS t(label, d)")
def quarter_ends(spark, sf_dir):
    return _values(spark, "('Mar 2026'), ('Feb 2024'), ('TTM')", "label").select("label", quarter_end("label").cast("string").alias("d"))


@BOOK.add("f11_parsed_numbers", "SELECT * FROM (VALUES ('1,777 Cr.', 1777.0::DOUBLE), ('15%', 15.0), ('-3.5', -3.5), ('n/a', NULL)) AS t(raw, n)")
def parsed_numbers(spark, sf_dir):
    return _values(spark, "('1,777 Cr.'), ('15%'), ('-3.5'), ('n/a')", "raw").select("raw", parsed_number("raw").alias("n"))


@BOOK.add("f16_slugify", "SELECT DISTINCT p_type AS name, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("name"), F.trim(F.regexp_replace(F.lower("p_type"), "[^a-z0-9]+", "-"), F.lit("-")).alias("slug")).distinct()


@BOOK.add("f27_calendar_parts", "SELECT year(d) AS year, month(d) AS month, monthname(d) AS name, dayofweek(d) + 1 AS weekday, count(*) AS n FROM (SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem) GROUP BY ALL")
def calendar_parts(spark, sf_dir):
    d = F.col("l_shipdate").cast("date")
    return table(spark, sf_dir, "lineitem").groupBy(F.year(d).cast("long").alias("year"), F.month(d).cast("long").alias("month"), F.date_format(d, "MMMM").alias("name"), F.dayofweek(d).cast("long").alias("weekday")).agg(F.count("*").alias("n"))


@BOOK.add("f28_fetch_gaps", f"WITH s AS (SELECT k, max(d) AS last FROM ({nav_sql('brand')}) GROUP BY k), r AS (SELECT DISTINCT p_brand AS k FROM part UNION ALL SELECT r_name FROM region) SELECT r.k, CASE WHEN s.last IS NULL THEN 'cold' WHEN DATE '2001-11-08' - s.last >= 5 THEN 'forward' ELSE 'none' END AS fetch FROM r LEFT JOIN s ON r.k = s.k")
def fetch_gaps(spark, sf_dir):
    last = nav(spark, sf_dir, "brand").groupBy("k").agg(F.max("d").alias("last"))
    need = F.when(F.col("last").isNull(), "cold").when(F.datediff(F.lit("2001-11-08").cast("date"), "last") >= 5, "forward").otherwise("none")
    asked = table(spark, sf_dir, "part").select(F.col("p_brand").alias("k")).distinct().unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("k")))
    return asked.join(last, "k", "left").select("k", need.alias("fetch"))


@BOOK.add("u10_nav_guard", f"WITH n AS (SELECT k, arg_max(nav, d) AS nav FROM ({nav_sql('nation')}) GROUP BY k), r AS (SELECT k, arg_max(nav, d) AS nav FROM ({nav_sql('region')}) GROUP BY k) SELECT n_name AS code, r_name AS match, coalesce(abs(n.nav - r.nav) / r.nav <= 0.05, true) AS trusted FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN n ON n.k = n_name LEFT JOIN r ON r.k = r_name")
def nav_guard(spark, sf_dir):
    """Each code against the one it is to be merged into: trusted if their last values differ by 5 percent at most or one is not known."""
    last = lambda kind, key, value: nav(spark, sf_dir, kind).groupBy(F.col("k").alias(key)).agg(F.max_by("nav", "d").alias(value))
    pairs = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("code"), F.col("r_name").alias("match"))
    both = pairs.join(last("nation", "code", "x"), "code", "left").join(last("region", "match", "y"), "match", "left")
    return both.select("code", "match", F.coalesce(F.abs(F.col("x") - F.col("y")) / F.col("y") <= 0.05, F.lit(True)).alias("trusted"))


@BOOK.add("y11_buy_and_hold", f"SELECT k, round(100000 * arg_max(nav, d) / arg_min(nav, d), 3) AS final, round(100 * (arg_max(nav, d) / arg_min(nav, d) - 1), 5) AS gain FROM ({nav_sql('brand')}) GROUP BY k")
def buy_and_hold(spark, sf_dir):
    ratio = F.max_by("nav", "d") / F.min_by("nav", "d")
    return nav(spark, sf_dir, "brand").groupBy("k").agg(F.round(100000 * ratio, 3).alias("final"), F.round(100 * (ratio - 1), 5).alias("gain"))


@BOOK.add("y12_chart_window", f"WITH n AS (SELECT * FROM ({nav_sql('brand')})), l AS (SELECT n.* FROM n JOIN (SELECT k, max(d) AS last FROM n GROUP BY k) AS m ON n.k = m.k WHERE n.d > m.last - 365) SELECT k, count(*) AS n, round(min(nav) - 0.05 * (max(nav) - min(nav)), 5) AS low, round(max(nav) + 0.05 * (max(nav) - min(nav)), 5) AS high FROM l GROUP BY k")
def chart_window(spark, sf_dir):
    rows = nav(spark, sf_dir, "brand").withColumn("last", F.max("d").over(Window.partitionBy("k"))).filter(F.col("d") > F.date_sub("last", 365))
    pad = 0.05 * (F.max("nav") - F.min("nav"))
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.round(F.min("nav") - pad, 5).alias("low"), F.round(F.max("nav") + pad, 5).alias("high"))


@BOOK.add("i38_rolling_variants", f"WITH b AS ({BARS_SQL}), t AS (SELECT *, lag(close) {_W} AS prev, row_number() {_W} AS n FROM b), r AS (SELECT *, greatest(high - low, abs(high - prev), abs(low - prev)) AS tr, greatest(close - prev, 0) AS up, greatest(prev - close, 0) AS down FROM t), s AS (SELECT k, d, n, close, avg(tr) OVER w AS atr, avg(up) OVER w AS up, avg(down) OVER w AS down FROM r WINDOW w AS (PARTITION BY k ORDER BY d ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)) SELECT k, d, round(atr + {1e3 * NUDGE}, 5) AS atr, round(100 * atr / close + {1e3 * NUDGE}, 5) AS natr, round(100 * up / nullif(up + down, 0) + {1e3 * NUDGE}, 5) AS rsi FROM s WHERE n > 14", dates="d")
def rolling_variants(spark, sf_dir):
    rows = bars(spark, sf_dir).withColumn("prev", F.lag("close").over(ordered())).withColumn("n", F.row_number().over(ordered()))
    reach = F.when(F.col("prev").isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("prev")), F.abs(F.col("low") - F.col("prev"))))
    rows = rows.withColumn("tr", reach).withColumn("u", F.greatest(F.col("close") - F.col("prev"), F.lit(0.0))).withColumn("w", F.greatest(F.col("prev") - F.col("close"), F.lit(0.0)))
    rows = rows.withColumns({c: F.avg(x).over(last_rows(14)) for c, x in (("atr", "tr"), ("up", "u"), ("down", "w"))}).filter("n > 14")
    show = lambda c: F.round(c + 1e3 * NUDGE, 5)
    return rows.select("k", "d", show(F.col("atr")).alias("atr"), show(100 * F.col("atr") / F.col("close")).alias("natr"), show(F.try_divide(100 * F.col("up"), F.col("up") + F.col("down"))).alias("rsi"))


_WEEK = f"(SELECT k, max(d) AS d, arg_max(close, d) AS close, sum(volume) AS volume FROM ({BARS_SQL}) GROUP BY k, date_trunc('week', d))"


@BOOK.add(
    "i38_exponential_variants",
    f"""WITH RECURSIVE b AS (SELECT *, lag(close) {_W} AS prev, row_number() {_W} AS n FROM {_WEEK}),
e AS (SELECT k, d, n, close, volume, close AS fast, close AS slow, 0.0::DOUBLE AS signal, 0.0::DOUBLE AS obv FROM b WHERE n = 1
  UNION ALL SELECT b.k, b.d, b.n, b.close, b.volume, e.fast + 2.0 / 13 * (b.close - e.fast), e.slow + 2.0 / 27 * (b.close - e.slow),
    e.signal + 2.0 / 10 * ((e.fast + 2.0 / 13 * (b.close - e.fast)) - (e.slow + 2.0 / 27 * (b.close - e.slow)) - e.signal), e.obv + sign(b.close - b.prev) * b.volume FROM e JOIN b ON b.k = e.k AND b.n = e.n + 1)
SELECT k, d, round(fast - slow + {1e3 * NUDGE}, 6) AS macd, round(signal + {1e3 * NUDGE}, 6) AS signal, round(obv, 3) AS obv FROM e""",
    dates="d",
)
def exponential_variants(spark, sf_dir):
    """Exponential means that begin with the first value, their difference and its mean, and volume signed by the change of price, of weekly bars."""
    close = bars(spark, sf_dir).groupBy("k", F.trunc("d", "week").alias("_week")).agg(F.max("d").alias("d"), F.max_by("close", "d").alias("close"), F.sum("volume").alias("volume")).drop("_week")
    rows = exponential_means(close, "close", {"fast": 2 / 13, "slow": 2 / 27}, span="year").withColumn("macd", F.col("fast") - F.col("slow"))
    rows = exponential_means(rows, "macd", {"signal": 2 / 10}, span="year")
    turn = F.coalesce(F.signum(F.col("close") - F.lag("close").over(ordered())), F.lit(0.0))
    obv = F.sum(turn * F.col("volume")).over(ordered())
    return rows.select("k", "d", F.round(F.col("macd") + 1e3 * NUDGE, 6).alias("macd"), F.round(F.col("signal") + 1e3 * NUDGE, 6).alias("signal"), F.round(obv, 3).alias("obv"))


@BOOK.add("c2_clusters_of_funds")
def clusters_of_funds(spark, sf_dir):
    """Funds grouped by standardised risk and return, with their first principal component."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = nav(spark, sf_dir, "brand").withColumn("r", growth("nav"))
    points = rows.groupBy("k").agg(F.stddev_samp("r").alias("risk"), F.avg("r").alias("gain"), F.min("r").alias("worst")).na.drop()
    steps = [VectorAssembler(inputCols=["risk", "gain", "worst"], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), PCA(k=1, inputCol="x", outputCol="pc"), KMeans(k=3, seed=1, featuresCol="x", predictionCol="cluster")]
    fitted = Pipeline(stages=steps).fit(points).transform(points)
    return fitted.select("k", "cluster", F.round(vector_to_array("pc")[0], 6).alias("component"))
