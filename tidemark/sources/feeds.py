"""Parsers of feed payloads: each takes rows (key, payload) and gives typed rows.

A payload that does not fit gives no rows or NULL values, never an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import epoch_millis_date, parsed_date, quarter_end
from tidemark.functions.text import parsed_number

TRADEBOOK = "trade_id long, k string, d date, side string, qty double, price double"


def read_tradebook(spark: SparkSession, path: str) -> DataFrame:
    """A tradebook CSV with a header, read with its schema: no inference pass."""
    return spark.read.schema(TRADEBOOK).option("header", True).csv(path)


def read_trimmed_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV whose header names are padded with spaces."""
    rows = spark.read.option("header", True).csv(path)
    return rows.toDF(*(c.strip() for c in rows.columns))


def nav_history(payloads: DataFrame) -> DataFrame:
    """k, d, nav of {"data": [{"date": "31-12-2024", "nav": "12.5"}]}."""
    parsed = F.from_json("payload", "data array<struct<date:string,nav:string>>")
    rows = payloads.select("k", F.explode(parsed["data"]).alias("x"))
    return rows.select("k", F.col("x.date").alias("day"), F.col("x.nav").try_cast("double").alias("nav")).select("k", parsed_date("day").alias("d"), "nav").filter("nav is not null")


def nav_pairs(payloads: DataFrame) -> DataFrame:
    """k, d, nav of [[epoch milliseconds, nav], ...]; of rows of one day the last stays, missing values go."""
    pairs = payloads.select("k", F.posexplode(F.from_json("payload", "array<array<double>>")).alias("at", "x"))
    rows = pairs.select("k", "at", F.element_at("x", 1).cast("long").alias("ms"), F.element_at("x", 2).alias("nav")).filter("nav is not null")
    return rows.groupBy("k", epoch_millis_date("ms").alias("d")).agg(F.max_by("nav", "at").alias("nav"))


def scheme_master(files: DataFrame) -> DataFrame:
    """code, isins, name, nav, d, category and house of a sectioned text of 'code;isin;isin;name;nav;date' lines.

    Lines without semicolons are headings for the lines below: those with
    '(...)' name a category, others a fund house.  Order within a file is the
    position in its text, whatever the partitions.
    """
    lines = files.select("k", F.posexplode(F.split("payload", "\n")).alias("at", "line")).withColumn("line", F.trim("line")).filter("line <> ''")
    below = Window.partitionBy("k").orderBy("at")
    heading = ~F.col("line").contains(";")
    category = F.when(heading & F.col("line").contains("("), F.regexp_extract("line", r"\(([^)]*)\)", 1))
    house = F.when(heading & ~F.col("line").contains("("), F.col("line"))
    rows = lines.withColumn("category", F.last(category, ignorenulls=True).over(below)).withColumn("house", F.last(house, ignorenulls=True).over(below))
    part = F.split("line", ";")
    rows = rows.filter(~heading).select("category", "house", part.getItem(0).try_cast("long").alias("code"), part.getItem(1).alias("isin_growth"), part.getItem(2).alias("isin_reinvestment"), part.getItem(3).alias("name"), part.getItem(4).try_cast("double").alias("nav"), part.getItem(5).alias("day"))
    return rows.filter("code is not null").select("code", "isin_growth", "isin_reinvestment", "name", "nav", parsed_date("day").alias("d"), "category", "house")


def portfolio(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Holdings (k, instrument, weight) and sectors (k, sector, weight) of a portfolio object."""
    shape = "schemePortfolioList array<struct<instrumentName:string,weighting:string>>, sectorAllocationMap map<string,string>"
    parsed = payloads.select("k", F.from_json("payload", shape).alias("p"))
    holdings = parsed.select("k", F.explode("p.schemePortfolioList").alias("x")).select("k", F.coalesce("x.instrumentName", F.lit("")).alias("instrument"), F.col("x.weighting").try_cast("double").alias("weight"))
    sectors = parsed.select("k", F.explode("p.sectorAllocationMap").alias("sector", "w")).select("k", "sector", F.col("w").try_cast("double").alias("weight"))
    return holdings, sectors


def labelled_cells(pages: DataFrame) -> DataFrame:
    """k, label, value of '<td>label</td><td>value</td>' pairs in html, numbers parsed where there are any."""
    pair = r"(?s)<td[^>]*>([^<]*)</td>\s*<td[^>]*>([^<]*)</td>"
    labels, values = (F.regexp_extract_all("payload", F.lit(pair), F.lit(i)) for i in (1, 2))
    rows = pages.select("k", F.inline(F.arrays_zip(labels.alias("label"), values.alias("value"))))
    clean = rows.select("k", F.regexp_replace(F.trim("label"), r"[\s:+]+$", "").alias("label"), F.trim("value").alias("value"))
    return clean.withColumn("number", parsed_number("value"))


def period_table(payloads: DataFrame) -> DataFrame:
    """k, row, period_end, place, value of {"row": {"Mar 2026": "1,234"}}; ``place`` keeps the columns' order."""
    rows = payloads.select("k", F.explode(F.from_json("payload", "map<string,map<string,string>>")).alias("row", "cells"))
    cells = rows.select("k", "row", F.posexplode(F.map_entries("cells")).alias("place", "c"))
    return cells.select("k", "row", F.col("c.key").alias("period"), "place", F.col("c.value").alias("raw")).select("k", "row", quarter_end("period").alias("period_end"), "place", parsed_number("raw").alias("value"))


def index_history(payloads: DataFrame) -> DataFrame:
    """k, d, close of [{"Date": "01 Jan 2024", "Close": "1,234.5"}], one row a day."""
    rows = payloads.select("k", F.explode(F.from_json("payload", "array<struct<Date:string,Close:string>>")).alias("x"))
    typed = rows.select("k", F.col("x.Date").alias("day"), F.col("x.Close").alias("raw")).select("k", parsed_date("day").alias("d"), parsed_number("raw").alias("close"))
    return typed.groupBy("k", "d").agg(F.max("close").alias("close"))


def page_outline(pages: DataFrame) -> DataFrame:
    """page_id, title, links, paragraphs and script-free text length of raw html pages."""
    body = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", ""), "<[^>]*>", "")
    return pages.select("page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))).cast("long").alias("links"), F.length(body).cast("long").alias("text_length"))
