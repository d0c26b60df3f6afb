"""License scan by an exact set-similarity join, in DataFrame operations only (operator 2).

Two scans over the whole texts, whose words are runs of letters, digits and
characters beyond ASCII after A-Z are lower-cased.

* Base: every place where a phrase's words stand consecutively, over line ends.
* Templates: every block that holds at least ``CONTAINMENT`` of a template's
  distinct words.  A block is any run of words ``REACH`` times as long as the
  template, wherever its lines end, so a notice is found however it is wrapped
  or marked as a comment.  The join is exact: the templates' words are ordered by the number of
  texts that hold them, rarest first; a text with such a block must share one of
  the template's first words (prefix filter), hold enough of its words (length
  filter), and have enough words left after the first shared one (positional
  filter).  In what remains a block that meets the threshold can be made to begin
  with a word of the template, so blocks from each of these are counted in full.

Texts are taken apart once; the templates' words in each text and, where they
are enough for some template, their places are written as a table, which the
count of words and the join read.  The templates are a fixed list, so their
index may be broadcast; texts never are.  The score is the highest containment
of a template, 1 with a base phrase.

Defined results: a null text is empty, with no words, labels or places and
score 0; repeated rows repeat; a null id is kept; labels of nothing are "".
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.base import read, written

#: Words: what stands between ASCII characters other than letters and digits.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Statements by which licenses are named or granted.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
)
#: Least share of a template's distinct words in a block.
CONTAINMENT = 0.8
#: Words in a block, as a multiple of the template's.
REACH = 2


def lowered(text: str) -> Column:
    """The text with A-Z lower-cased; no other character turns into a letter of ASCII."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("�")))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def _strings(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _vocabulary(templates: tuple) -> list[str]:
    return sorted({w for _, text in templates for w in text.split()})


def _template_index(spark: SparkSession, templates: tuple, order: list[str], containment: float) -> DataFrame:
    """token, template, label, place of the token in the template's order, size, least and all tokens: prefixes only."""
    rows = []
    for k, (label, text) in enumerate(templates):
        tokens = sorted(set(text.split()), key=order.index)
        least = math.ceil(containment * len(tokens) - 1e-9)
        for place, token in enumerate(tokens[: len(tokens) - least + 1]):
            rows.append(F.struct(F.lit(token).alias("token"), F.lit(k).alias("template"), F.lit(label).alias("label"), F.lit(place).alias("place"), F.lit(len(tokens)).alias("size"), F.lit(least).alias("least"), F.lit(REACH * len(text.split())).alias("width"), _strings(tokens).alias("tokens")))
    return spark.range(1).select(F.inline(F.array(*rows)))


def _least(text: str, containment: float) -> int:
    return math.ceil(containment * len(set(text.split())) - 1e-9)


def template_blocks(texts: DataFrame, templates: tuple = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, text_hash, label and highest containment of every template that a block of texts(doc_id, text_hash, held, marks) meets."""
    vocabulary = _vocabulary(templates)
    held = texts.select(F.explode("held").alias("token"))
    frequency = {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}  # a row for each word of the templates
    order = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    index = F.broadcast(_template_index(texts.sparkSession, templates, order, containment))
    ordered = texts.filter(F.size("marks") > 0).select("doc_id", "text_hash", "marks", F.array_intersect(_strings(order), "held").alias("held"))
    shared = ordered.select("doc_id", "text_hash", "marks", "held", F.posexplode("held").alias("at", "token")).join(index, "token")
    left = 1 + F.least(F.col("size") - F.col("place") - 1, F.size("held") - F.col("at") - 1)
    passing = shared.filter((F.size("held") >= F.col("least")) & (F.col("place") == F.array_position("tokens", F.element_at(F.array_intersect("tokens", "held"), 1)) - 1) & (left >= F.col("least")))
    counted = passing.filter(F.size(F.array_intersect("tokens", "held")) >= F.col("least"))
    own = counted.withColumn("own", F.filter("marks", lambda m: F.array_contains(F.col("tokens"), m["word"]))).drop("marks", "held")
    block = lambda m, k: F.filter(F.slice("own", k + 1, F.col("width")), lambda x: x["at"] < m["at"] + F.col("width"))
    best = own.withColumn("both", F.array_max(F.transform("own", lambda m, k: F.size(F.array_distinct(F.transform(block(m, k), lambda x: x["word"]))))))
    return best.filter(F.col("both") >= F.col("least")).select("doc_id", "text_hash", "label", (F.col("both") / F.col("size")).alias("containment"))


def _places(words: Column, phrase: str) -> Column:
    parts = phrase.split()
    at = F.sequence(F.lit(0), F.size(words) - len(parts))
    same = lambda i: F.slice(words, i + 1, len(parts)) == _strings(parts)
    return F.when(F.size(words) >= len(parts), F.filter(at, same)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, templates: tuple = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    likely = "|".join(phrase.replace(" ", GAP) for phrase in PHRASES)
    low = docs.select("doc_id", "text_hash", lowered("text").alias("low"))
    whole = low.select("doc_id", "text_hash", _words(F.col("low")).alias("words"), F.col("low").rlike(likely).alias("likely"))
    none = F.array().cast("array<int>")
    found = {label: F.when(F.col("likely"), _places(F.col("words"), phrase)).otherwise(none) for phrase, label in PHRASES.items()}
    vocabulary = _strings(_vocabulary(templates))
    whole = whole.withColumn("held", F.array_intersect(vocabulary, "words"))
    enough = reduce(lambda a, b: a | b, (F.size(F.array_intersect(_strings(sorted(set(text.split()))), "held")) >= _least(text, containment) for _, text in templates))
    marks = F.when(enough, F.filter(F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda m: F.array_contains(vocabulary, m["word"])))
    places = written(whole.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), *(v.alias(k) for k, v in found.items()), "held", F.coalesce(marks, F.array().cast("array<struct<at:int,word:string>>")).alias("marks")))
    every = F.flatten(F.array(*(F.col(f"`{k}`") for k in found)))
    base = places.select("doc_id", "text_hash", "n_words", every.alias("at"), F.array_sort(F.array_compact(F.array(*(F.when(F.size(F.col(f"`{k}`")) > 0, F.lit(k)) for k in found)))).alias("base"))
    blocks = template_blocks(places.select("doc_id", "text_hash", "held", "marks"), templates, containment)
    per_doc = blocks.groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    both = base.join(per_doc, base["doc_id"].eqNullSafe(per_doc["doc_id"]) & (base["text_hash"] == per_doc["text_hash"]), "left")
    joined = lambda c: F.array_join(c, ",")
    return both.select(
        base["doc_id"],
        "n_words",
        F.size("at").cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"),
        joined("base").alias("base_labels"),
        joined(F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def _phrase_sql(phrase: str) -> str:
    n = len(phrase.split())
    return f"list_filter(range(0, len(words) - {n - 1}), lambda i: words[i + 1 : i + {n}] = {phrase.split()!r})"


def _template_sql() -> str:
    return ", ".join(f"({k}, '{label}', {sorted(set(text.split()))!r}, {REACH * len(text.split())})" for k, (label, text) in enumerate(TEMPLATES))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES = {
    "op2_licenses": rf"""
WITH low AS (
  SELECT doc_id, {_LOWER} AS low FROM documents
), worded AS (
  SELECT doc_id, regexp_extract_all(low, '{WORD}') AS words FROM low
), placed AS (
  SELECT doc_id, len(words) AS n_words, {", ".join(f"{_phrase_sql(p)} AS p{k}" for k, p in enumerate(PHRASES))} FROM worded
), template(id, label, tokens, width) AS (VALUES {_template_sql()}
), mark AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM worded
), near AS (
  SELECT doc_id, id, label, len(tokens) AS size, count(DISTINCT word) OVER (PARTITION BY doc_id, id ORDER BY i RANGE BETWEEN CURRENT ROW AND width - 1 FOLLOWING) AS met
  FROM mark JOIN template ON list_contains(tokens, word)
), met AS (
  SELECT doc_id, label, met * 1.0::DOUBLE / size AS containment FROM near WHERE met >= ceil({CONTAINMENT} * size - 1e-9)
), more AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(containment) AS best FROM met GROUP BY doc_id
), based AS (
  SELECT doc_id, n_words, list_concat({", ".join(f"p{k}" for k in range(len(PHRASES)))}) AS at,
         list_filter([{", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in enumerate(PHRASES.values()))}], lambda x: x IS NOT NULL) AS base
  FROM placed
)
SELECT b.doc_id, b.n_words::BIGINT AS n_words, len(b.at)::BIGINT AS n_base,
       list_min(b.at)::BIGINT AS first_word, list_max(b.at)::BIGINT AS last_word,
       array_to_string(list_sort(b.base), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(b.base, coalesce(m.labels, [])))), ',') AS labels,
       CASE WHEN len(b.base) > 0 THEN 1.0 ELSE coalesce(m.best, 0.0) END::DOUBLE AS score
FROM based AS b LEFT JOIN more AS m ON b.doc_id = m.doc_id
"""
}
QUERIES = {"op2_licenses": op2_licenses}
