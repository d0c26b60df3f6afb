"""Queries of the streaming operators; each runs a stream to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.relations import table
from tidemark.queries.book import Book
from tidemark.sources.scratch import scratch
from tidemark.sources.sink import Table
from tidemark.streaming import stops
from tidemark.streaming import streams as ops

BOOK = Book()


@BOOK.add("t4_stream_bars", "SELECT CAST(ts AS DATE) AS d, event_type, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS n FROM events GROUP BY 1, 2", dates="d")
def stream_bars(spark, sf_dir):
    return ops.to_end(ops.bars(ops.events(spark, sf_dir)), "complete")


@BOOK.add("t2_stream_first_of_each", "SELECT user_id, event_type FROM events GROUP BY 1, 2")
def stream_distinct(spark, sf_dir):
    out = Table(spark, scratch(spark), "user_id long, event_type string", ["user_id", "event_type"])
    fresh = ops.first_of_each(ops.events(spark, sf_dir).select("ts", "user_id", "event_type"), ["user_id", "event_type"], "1 day")
    ops.inserted(fresh, out)
    return out.read()


@BOOK.add("t6_stream_replaced", "SELECT user_id, event_id, value FROM events WHERE event_type = 'signup' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase') UNION ALL SELECT user_id, event_id, value FROM events WHERE event_type = 'purchase'")
def stream_replaced(spark, sf_dir):
    """Snapshots of signups, of which a stream of purchases replaces those of its users; other types count as failed fetches."""
    out = Table(spark, scratch(spark), "user_id long, event_id long, value double", ["user_id"])
    out.change("first", table(spark, sf_dir, "events").filter("event_type = 'signup'").select("user_id", "event_id", "value"))
    ops.replaced(ops.events(spark, sf_dir), out, "event_type = 'purchase'")
    return out.read()


@BOOK.add("t1_stream_newer_than", "WITH known AS (SELECT user_id, max(ts) AS mark FROM events WHERE ts < TIMESTAMP '2024-01-15' AND event_type = 'signup' GROUP BY 1) SELECT event_id, e.user_id FROM events AS e LEFT JOIN known AS k ON e.user_id = k.user_id WHERE mark IS NULL OR ts > mark")
def stream_newer(spark, sf_dir):
    known = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).filter("ts < timestamp '2024-01-15' and event_type = 'signup'")
    return ops.to_end(ops.newer_than(ops.events(spark, sf_dir), known, "user_id").select("event_id", "user_id"))


@BOOK.add("t3_stream_refreshed_metrics", "SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error') GROUP BY 1")
def stream_refreshed(spark, sf_dir):
    touched = ops.events(spark, sf_dir).filter("event_type = 'error'")
    return ops.refreshed(touched, table(spark, sf_dir, "events"), "user_id", lambda rows: rows.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")))


@BOOK.add("t5_stream_positions", "WITH m AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE event_type IN ('click', 'error')), c AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'click' AND before IS DISTINCT FROM 'click') AS opened, count(*) FILTER (WHERE event_type = 'error' AND before = 'click') AS closed FROM m GROUP BY 1) SELECT user_id, coalesce(opened, 0) AS opened, coalesce(closed, 0) AS closed, coalesce(opened > closed, false) AS holding FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN c USING (user_id)")
def stream_positions(spark, sf_dir):
    return ops.to_end(ops.positions(ops.events(spark, sf_dir)), "update")


_STOP = 0.2


@BOOK.add(
    "t5_stream_stops",
    f"""WITH RECURSIVE r AS (SELECT CAST(user_id AS VARCHAR) AS k, event_id AS id, value AS price, event_type = 'click' AS entry, event_type = 'error' AS leave, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
  FROM events WHERE value IS NOT NULL AND ts < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR),
s AS (SELECT k, n, CASE WHEN entry THEN id END AS opened, CASE WHEN entry THEN price END AS paid, CASE WHEN entry THEN price END AS high, NULL::BIGINT AS was, NULL::DOUBLE AS cost, NULL::DOUBLE AS top, NULL::BIGINT AS closed, NULL::DOUBLE AS got, NULL::VARCHAR AS why FROM r WHERE n = 1
  UNION ALL
  SELECT k, n, CASE WHEN NOT out THEN CASE WHEN opened IS NULL THEN CASE WHEN entry THEN id END ELSE opened END END, CASE WHEN NOT out THEN CASE WHEN opened IS NULL THEN CASE WHEN entry THEN price END ELSE paid END END, CASE WHEN NOT out THEN CASE WHEN opened IS NULL THEN CASE WHEN entry THEN price END ELSE high END END,
         CASE WHEN out THEN opened END, CASE WHEN out THEN paid END, CASE WHEN out THEN high END, CASE WHEN out THEN id END, CASE WHEN out THEN price END, CASE WHEN out THEN CASE WHEN leave THEN 'signal' ELSE 'stop' END END
  FROM (SELECT r.*, s.opened, s.paid, greatest(s.high, r.price) AS high, s.opened IS NOT NULL AND (r.leave OR r.price <= greatest(s.high, r.price) * (1 - {_STOP})) AS out FROM s JOIN r ON r.k = s.k AND r.n = s.n + 1))
SELECT k, was AS opened, closed, cost AS entry_price, got AS exit_price, top AS high, why FROM s WHERE closed IS NOT NULL""",
)
def stream_stops(spark, sf_dir):
    """Per user a position that a click opens and an error or a trailing stop closes, of all rows but the last hour's, which the watermark has not passed."""
    rows = ops.events(spark, sf_dir).select(F.col("user_id").alias("k"), "ts", F.col("event_id").alias("id"), F.col("value").alias("price"), (F.col("event_type") == "click").alias("entry"), (F.col("event_type") == "error").alias("leave"))
    return ops.to_end(stops.stop_trades(rows, "1 hour", _STOP), store=stops.STORE)
