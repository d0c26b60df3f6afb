"""Queries of data-quality operators and of table changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import stem
from tidemark.operators import quality as ops
from tidemark.operators import tables
from tidemark.plans.relations import NUDGE, nav, nav_sql, table
from tidemark.queries.book import Book, stem_sql

BOOK = Book()
_W = "OVER (PARTITION BY k ORDER BY d)"
_DIRTY = f"dirty AS (SELECT k, d, CASE WHEN day(d) = 13 AND month(d) = 5 THEN nav * 3 WHEN year(d) < 1998 AND k < 'Brand#2' THEN nav / 10 WHEN year(d) >= 2000 AND k LIKE 'Brand#2%' THEN nav / 10 WHEN year(d) >= 1999 AND k = 'Brand#3' THEN nav * 1000 ELSE nav END AS nav FROM ({nav_sql('brand')}))"


def _dirty(spark, sf_dir):
    """The brands' series with spikes every 13 May; some have a tenth of the scale before 1998, some a split in 2000, one a jump that no repair makes plausible."""
    spike = (F.dayofmonth("d") == 13) & (F.month("d") == 5)
    value = F.when(spike, F.col("nav") * 3).when((F.year("d") < 1998) & (F.col("k") < "Brand#2"), F.col("nav") / 10)
    value = value.when((F.year("d") >= 2000) & F.col("k").like("Brand#2%"), F.col("nav") / 10).when((F.year("d") >= 1999) & (F.col("k") == "Brand#3"), F.col("nav") * 1000).otherwise(F.col("nav"))
    return nav(spark, sf_dir, "brand").select("k", "d", value.alias("nav"))


_GLITCH = f"{_DIRTY}, n AS (SELECT *, lag(nav) {_W} AS b, lead(nav) {_W} AS a FROM dirty), g AS (SELECT k, d, nav, greatest(nav / greatest(a, b), least(a, b) / nav) AS times FROM n WHERE a > 0 AND b > 0 AND nav > 0 AND (nav / greatest(a, b) > 2 OR least(a, b) / nav > 2))"


@BOOK.add("w8_glitches", f"WITH {_GLITCH} SELECT k, d, round(nav, 6) AS nav, round(times, 5) AS times FROM g", dates="d")
def glitches(spark, sf_dir):
    return ops.glitches(_dirty(spark, sf_dir)).select("k", "d", F.round("nav", 6).alias("nav"), F.round("times", 5).alias("times"))


@BOOK.add("u8_glitch_delete", f"WITH {_GLITCH} SELECT k, count(*) AS rows, max(d) AS last_day FROM dirty AS x WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.k = x.k AND g.d = x.d) GROUP BY k", dates="last_day")
def glitch_delete(spark, sf_dir):
    return ops.without_glitches(_dirty(spark, sf_dir)).groupBy("k").agg(F.count("*").alias("rows"), F.max("d").alias("last_day"))


_BREAK = f"{_GLITCH}, c AS (SELECT * FROM dirty AS x WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.k = x.k AND g.d = x.d)), b AS (SELECT k, d, log10(nav / lag(nav) {_W}) AS l, count(*) OVER (PARTITION BY k) AS n FROM c), p AS (SELECT k, d, CAST(round(l) AS INT) AS power FROM b WHERE n >= 30 AND round(l) >= 1 AND abs(l - round(l)) < 0.04)"


@BOOK.add("w9_scale_breaks", f"WITH {_BREAK} SELECT * FROM p", dates="d")
def breaks(spark, sf_dir):
    return ops.scale_breaks(ops.without_glitches(_dirty(spark, sf_dir)))


@BOOK.add("u8_rescaled", f"WITH {_BREAK}, s AS (SELECT c.k, c.d, c.nav, coalesce(sum(power) OVER (PARTITION BY c.k ORDER BY c.d ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS later FROM c LEFT JOIN p ON c.k = p.k AND c.d = p.d), e AS (SELECT k, pow(arg_max(nav, d) / arg_min(nav * pow(10, later), d), 365.25 / (max(d) - min(d))) - 1 AS growth FROM s GROUP BY k) SELECT s.k, s.d, round(nav * CASE WHEN growth BETWEEN -0.1 AND 0.6 THEN pow(10, later) ELSE 1 END + {1e4 * NUDGE}, 4) AS nav FROM s JOIN e ON s.k = e.k", dates="d")
def rescaled(spark, sf_dir):
    return ops.rescaled(ops.without_glitches(_dirty(spark, sf_dir))).select("k", "d", F.round(F.col("nav") + 1e4 * NUDGE, 4).alias("nav"))


_OLD = "old AS (SELECT p_partkey AS code, p_name AS name, p_retailprice AS nav, p_size AS size FROM part WHERE p_size <= 35)"
_NEW = "new AS (SELECT p_partkey AS code, upper(p_name) AS name, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice * 2 END AS nav, p_size + 100 AS size FROM part WHERE p_size > 20)"


def _old(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("p_size <= 35").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("nav"), F.col("p_size").alias("size"))


def _new(spark, sf_dir):
    rows = table(spark, sf_dir, "part").filter("p_size > 20")
    return rows.select(F.col("p_partkey").alias("code"), F.upper("p_name").alias("name"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_retailprice") * 2).alias("nav"), (F.col("p_size") + 100).alias("size"))


for _name, _change, _sql in (
    ("u1_upsert", tables.upsert, "SELECT * FROM new UNION ALL SELECT * FROM old WHERE code NOT IN (SELECT code FROM new)"),
    ("u2_insert_absent", tables.insert_absent, "SELECT * FROM new WHERE code NOT IN (SELECT code FROM old)"),
    ("u3_partial_upsert", tables.partial_upsert, "SELECT coalesce(o.code, n.code) AS code, coalesce(n.name, o.name) AS name, coalesce(n.nav, o.nav) AS nav, coalesce(n.size, o.size) AS size FROM old AS o FULL JOIN new AS n ON o.code = n.code"),
):

    @BOOK.add(_name, f"WITH {_OLD}, {_NEW} {_sql}")
    def change(spark, sf_dir, change=_change):
        return change(_old(spark, sf_dir), _new(spark, sf_dir), ["code"])


@BOOK.add("u4_replace_keys", f"WITH {_OLD}, {_NEW}, few AS (SELECT * FROM new WHERE nav IS NOT NULL) SELECT * FROM old WHERE code NOT IN (SELECT code FROM few) UNION ALL SELECT * FROM few")
def replace_keys(spark, sf_dir):
    return tables.replace_keys(_old(spark, sf_dir), _new(spark, sf_dir).filter("nav is not null"), ["code"])


@BOOK.add("u7_delete_keys", f"WITH {_OLD} SELECT * FROM old WHERE code NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def delete_keys(spark, sf_dir):
    gone = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("code"))
    return _old(spark, sf_dir).join(gone, "code", "left_anti")


@BOOK.add("u5_dimension_ids", "WITH known AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation WHERE n_regionkey < 2), fresh AS (SELECT DISTINCT name FROM (SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region) WHERE name NOT IN (SELECT name FROM known)) SELECT id, name FROM known UNION ALL SELECT (SELECT max(id) FROM known) + row_number() OVER (ORDER BY name), name FROM fresh")
def dimension_ids(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    known = nation.filter("n_regionkey < 2").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return tables.with_ids(known, nation.select(F.col("n_name").alias("name")).unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("name"))))


@BOOK.add("u6_synthetic_codes", "WITH known AS (SELECT CAST(n_nationkey AS BIGINT) - 5 AS code, n_name AS name FROM nation WHERE n_regionkey < 3), m AS (SELECT n_name AS name, n_nationkey AS place FROM nation WHERE n_regionkey >= 3) SELECT code, name FROM known UNION ALL SELECT least((SELECT min(code) FROM known), 0) - row_number() OVER (ORDER BY place), name FROM m")
def synthetic_codes(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    known = nation.filter("n_regionkey < 3").select((F.col("n_nationkey").cast("long") - 5).alias("code"), F.col("n_name").alias("name"))
    return tables.synthetic_codes(known, nation.select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("name")))


@BOOK.add("u9_code_merge", f"WITH r AS (SELECT CASE WHEN k = 'Brand#2' THEN 'Brand#1' WHEN k = 'Brand#4' THEN 'Brand#3' ELSE k END AS k, d, nav, k IN ('Brand#2', 'Brand#4') AS moved FROM ({nav_sql('brand')})), p AS (SELECT *, row_number() OVER (PARTITION BY k, d ORDER BY moved) AS n FROM r) SELECT k, count(*) AS rows, count(*) FILTER (WHERE moved) AS moved FROM p WHERE n = 1 GROUP BY k")
def code_merge(spark, sf_dir):
    mapping = spark.sql("SELECT * FROM VALUES ('Brand#2', 'Brand#1'), ('Brand#4', 'Brand#3') AS t(old, new)")
    rows = nav(spark, sf_dir, "brand").withColumn("moved", F.col("k").isin("Brand#2", "Brand#4"))
    return tables.rekeyed(rows, mapping, "k", ["d"]).groupBy("k").agg(F.count("*").alias("rows"), F.count_if("moved").alias("moved"))


@BOOK.add("u11_status", "SELECT p_partkey AS code, CASE WHEN l.k IS NULL THEN 'pending' ELSE 'available' END AS nav_status FROM part LEFT JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A') AS l ON p_partkey = l.k")
def status(spark, sf_dir):
    seen = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_partkey").alias("k")).distinct()
    return table(spark, sf_dir, "part").join(seen, F.col("p_partkey") == F.col("k"), "left").select(F.col("p_partkey").alias("code"), tables.status_of(F.col("k").isNotNull()).alias("nav_status"))


@BOOK.add("u12_backfill_plan", "WITH s AS (SELECT p_partkey AS code, unnest(['nav', 'holdings', 'metadata']) AS source, unnest([p_size % 2 = 0, p_size % 3 = 0, p_size % 5 = 0]) AS wanted FROM part) SELECT code, source FROM s WHERE wanted ORDER BY code, source LIMIT 50")
def backfill_plan(spark, sf_dir):
    wants = F.array(*(F.struct(F.lit(s).alias("source"), (F.col("p_size") % n == 0).alias("wanted")) for s, n in (("nav", 2), ("holdings", 3), ("metadata", 5))))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), F.inline(wants))
    return rows.filter("wanted").orderBy("code", "source").limit(50).select("code", "source")


_SCHEMES = "SELECT p_partkey AS code, 'IN' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || '1' AS isin_growth, CASE WHEN p_partkey % 2 = 0 THEN 'IN' || lpad(CAST(p_partkey // 2 AS VARCHAR), 9, '0') || '1' END AS isin_reinvestment FROM part WHERE p_size <= 35"


@BOOK.add("j17_isin_resolution", f"WITH s AS ({_SCHEMES}), t AS (SELECT DISTINCT 'IN' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || '1' AS isin FROM orders), m AS (SELECT t.isin, s.code, CASE WHEN s.isin_growth = t.isin THEN 1 ELSE 2 END AS p FROM t LEFT JOIN s ON s.isin_growth = t.isin OR s.isin_reinvestment = t.isin), r AS (SELECT *, row_number() OVER (PARTITION BY isin ORDER BY p, code) AS n FROM m) SELECT isin, code FROM r WHERE n = 1")
def isin_resolution(spark, sf_dir):
    isin = lambda c: F.concat(F.lit("IN"), F.lpad(c.cast("long").cast("string"), 9, "0"), F.lit("1"))
    part = table(spark, sf_dir, "part").filter("p_size <= 35")
    key = F.col("p_partkey")
    growth = part.select(isin(key).alias("isin"), key.alias("code"))
    again = part.filter("p_partkey % 2 = 0").select(isin(key / 2).alias("isin"), key.alias("code"))
    asked = table(spark, sf_dir, "orders").select(isin(F.col("o_custkey")).alias("isin")).distinct()
    return asked.join(tables.prioritised([(1, growth), (2, again)], ["isin"]), "isin", "left").select("isin", "code")


@BOOK.add("j18_case_insensitive_twins", "SELECT -p.p_partkey AS synthetic, q.p_partkey AS code FROM part AS p JOIN part AS q ON lower(upper(p.p_name) || p.p_partkey % 7) = lower(q.p_name || q.p_partkey % 7) WHERE p.p_size > 45 AND q.p_size <= 45")
def twins(spark, sf_dir):
    named = lambda f: F.lower(F.concat(f(F.col("p_name")), (F.col("p_partkey") % 7).cast("string")))
    part = table(spark, sf_dir, "part")
    a = part.filter("p_size > 45").select((-F.col("p_partkey")).alias("synthetic"), named(F.upper).alias("n"))
    b = part.filter("p_size <= 45").select(F.col("p_partkey").alias("code"), named(lambda c: c).alias("n"))
    return tables.joined_by_pieces(a, b, "n").select("synthetic", "code")


_STEM = stem_sql("{}")


@BOOK.add("j19_unique_stem_match", f"WITH a AS (SELECT p_partkey AS code, {_STEM.format('p_name')} AS s, p_size AS plan, p_brand < 'Brand#2' AS asked FROM part), u AS (SELECT s, plan, count(*) AS n, min(code) AS real FROM a WHERE NOT asked GROUP BY 1, 2 HAVING count(*) = 1) SELECT a.code, u.real FROM a JOIN u ON a.s = u.s AND a.plan = u.plan WHERE a.asked")
def unique_stem(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), stem("p_name").alias("s"), F.col("p_size").alias("plan"), (F.col("p_brand") < "Brand#2").alias("asked"))
    known = rows.filter("not asked").withColumnRenamed("code", "real")
    return tables.unique_matches(rows.filter("asked"), known, ["s", "plan"], "real").select("code", "real")
