"""Divergence of sources by term shares, priced by inclusion-exclusion over supports (operator 11).

A text's terms are its runs of letters, A-Z as a-z.  A lang keeps the terms that
stand in at least ``LEAST_DOCS`` of its documents, V of them.  A group (lang,
source), and the lang itself, gives each kept term the share
``p = 1 + floor(10**9 (count + 2) / (N + 2 V))``, and two shares differ by
``f(p, q) = floor((p - q)**2 / (p + q))``.

The sum of f over all kept terms of two groups g and h is never taken over the
V terms.  With ``g0`` and ``h0`` the shares of a count of 0,

    V f(g0, h0)                                       constant of terms that neither has
    + sum over g's terms of f(p, h0) - f(g0, h0)      from the histogram of g's counts
    + sum over h's terms of f(g0, q) - f(g0, h0)      from the histogram of h's counts
    + sum over shared terms of f(p, q) - f(p, h0) - f(g0, q) + f(g0, h0)

so terms that one side has cost a step for each distinct count, and only shared
terms are met one by one.  These come from posting lists: sources are dealt to
blocks of about ``BLOCK``, a term has a list for each two blocks, and a task adds
up its lists' pairs before it sends a row for each pair of sources.  So no pair
of a term's sources is ever written, and no row holds more than two blocks.

The result has a row for each two sources of a lang, as asked for; the counts
behind it are summed per task before they are shuffled.  Shares are quotients
of whole numbers of up to 38 digits; all else fits 64 bits, as a share is at
most 10**9 + 1.

Defined results: null text, lang and source count as ''; every row is a
document, repeated ones and ones without id included; a lang without kept terms
gives its sources pairs of value 0 and no terms; a lang with one source has no
pairs; ties go by the bytes of the item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.base import byte_slices, read, smallable, written
from tidemark.llm.runs import Runs
from tidemark.llm.wordhash import Words, folded, spelled

#: Fewest documents of a kept term, and ranks of the part ``term``.
LEAST_DOCS, TOP = 10, 10
#: Bytes of text counted together, sources in a block, and pairs of sources that a task prices together.
SLICE, BLOCK, PAIRS = 4 << 20, 256, 1 << 20
_POSTINGS = "lang string, source string, term string, n long, docs long"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to lang, source, term, occurrences and documents, summed within the task."""
    groups: dict[tuple[str, str], int] = {}
    runs = Runs(2)

    def rows(merged):
        (group, _, n, docs), terms = merged
        langs, sources = (np.array([k[i] for k in groups], object) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(langs[group], pa.string()), pa.array(sources[group], pa.string()), terms, pa.array(n), pa.array(docs)], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        own = np.array([groups.setdefault(k, len(groups)) for k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.int64)
        texts = batch.column(2)
        for a, b in byte_slices(texts, SLICE):
            words = Words(texts.slice(a, b - a), "letters")
            if not len(words.rows):
                continue
            terms, first, place = np.unique(words.hashes, return_index=True, return_inverse=True)
            in_doc, n = np.unique(words.rows.astype(np.int64) * len(terms) + place, return_counts=True)
            key, at = np.unique(own[a:b][in_doc // len(terms)] * len(terms) + in_doc % len(terms), return_inverse=True)
            term = key % len(terms)
            summed = [key // len(terms), terms[term].view(np.int64), np.bincount(at, n, len(key)).astype(np.int64), np.bincount(at, minlength=len(key))]
            for merged in runs.add(summed, spelled(folded(words.data), words.starts[first[term]], words.ends[first[term]])):
                yield rows(merged)
    for merged in runs.rest():
        yield rows(merged)


def postings(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, lead) of all kept terms; lead marks one row of each lang and term."""
    found = docs.select("lang", "source", "text").mapInArrow(_counts, _POSTINGS).repartition("lang", "term")
    summed = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    every = summed.select("*", F.sum("docs").over(term).alias("in_docs"), F.sum("n").over(term).alias("lang_n"), (F.min("source").over(term) == F.col("source")).alias("lead"))
    return written(every.filter(F.col("in_docs") >= least_docs).drop("docs", "in_docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 (count + 2) / (total + 2 terms)), 1 where nothing is counted."""
    over = (total + 2 * terms).cast("decimal(20,0)")
    return F.when(terms == 0, F.lit(1)).otherwise(1 + F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)"), over)).cast("long")


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting lists (lang, low, high, sources, blocks, shares, zeros) to lang, one, two and the summed corrections of shared terms."""
    known: dict[tuple[str, str], int] = {}
    runs = Runs(2)

    def rows(merged):
        one, two, value = merged[0]
        names = list(known)
        langs, sources = (np.array([k[i] for k in names], object) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(langs[one], pa.string()), pa.array(sources[one], pa.string()), pa.array(sources[two], pa.string()), pa.array(value)], ["lang", "one", "two", "value"])

    def f(p, q):
        return (p - q) ** 2 // (p + q)

    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("sources")
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.cumsum(size) - size
        row = np.repeat(np.arange(len(size)), size)
        flat = lists.flatten()
        names = flat.field("source").dictionary_encode()
        langs = batch.column("lang").dictionary_encode()
        lang_of = langs.indices.to_numpy()[row]
        pair = lang_of.astype(np.int64) * len(names.dictionary) + names.indices.to_numpy()
        each, back = np.unique(pair, return_inverse=True)
        lang_names, source_names = langs.dictionary.to_pylist(), names.dictionary.to_pylist()
        code = np.array([known.setdefault((lang_names[x // len(source_names)], source_names[x % len(source_names)]), len(known)) for x in each.tolist()], np.int64)[back]
        block, p, zero = (flat.field(x).to_numpy() for x in ("block", "p", "zero"))
        low, high = (batch.column(x).to_numpy() for x in ("low", "high"))
        # entry i of a list meets the entries after it, in parts of rows that hold about PAIRS pairs
        after = (begin + size)[row] - np.arange(len(row)) - 1
        ends = np.cumsum(after)
        at = 0
        while at < len(row):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
            n = after[at:to]
            i = np.repeat(np.arange(at, to), n)
            j = i + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            two_blocks = low[row[i]] != high[row[i]]
            own = ~two_blocks | (block[i] != block[j])  # lists of two blocks leave pairs within a block to that block's own
            i, j = i[own], j[own]
            value = f(p[i], p[j]) - f(p[i], zero[j]) - f(zero[i], p[j]) + f(zero[i], zero[j])
            one, two = np.minimum(code[i], code[j]), np.maximum(code[i], code[j])
            key, place = np.unique(one * len(known) + two, return_inverse=True)
            summed = np.zeros(len(key), np.int64)
            np.add.at(summed, place, value)
            if len(key):
                for merged in runs.add([key // len(known), key % len(known), summed]):
                    yield rows(merged)
            at = to
    for merged in runs.rest():
        yield rows(merged)


def overlaps(kept: DataFrame, langs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, one, two, value): the corrections of shared terms for one < two, from kept(lang, term, source, p, zero)."""
    blocks = langs.select("lang", F.ceil(F.col("sources") / block).cast("int").alias("blocks"))
    dealt = kept.join(smallable(blocks), "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lists = met.groupBy("lang", "term", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).agg(F.collect_list(F.struct("source", "block", "p", "zero")).alias("sources"))
    found = lists.filter(F.size("sources") > 1).select("lang", "low", "high", "sources").mapInArrow(_priced, "lang string, one string, two string, value long")
    return found.groupBy("lang", F.least("one", "two").alias("one"), F.greatest("one", "two").alias("two")).agg(F.sum("value").alias("value"))


def _one_sided(histogram: str, zero: str, other: str) -> Column:
    """Over a group's histogram of shares: how much its terms add to a pair in which the other side has none of them."""
    return F.aggregate(histogram, F.lit(0).cast("long"), lambda sum_, x: sum_ + x["m"] * (apart(x["p"], F.col(other)) - apart(F.col(zero), F.col(other))))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """docs(lang, source, text) to lang, source, part, item, value and rank."""
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    terms = postings(docs, least_docs)
    groups = docs.select("lang", "source").distinct()
    lang_sums = terms.filter("lead").groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("terms"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(lang_sums, "lang", "left").fillna(0, ["lang_total", "terms"])
    totals = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").fillna(0, ["total"]).join(langs, "lang")
    groups = written(groups.withColumn("zero", share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))))

    shares = terms.join(smallable(groups.select("lang", "source", "total", "terms", "lang_total", "zero")), ["lang", "source"])
    shares = shares.withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))

    steps = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    histograms = steps.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "m")).alias("h"))
    each = groups.join(histograms, ["lang", "source"], "left").select("lang", "source", "terms", "zero", F.coalesce("h", F.array().cast("array<struct<p:bigint,m:bigint>>")).alias("h"))
    each = written(each)
    other = each.select("lang", F.col("source").alias("two"), F.col("zero").alias("zero_two"), F.col("h").alias("h_two"))
    met = each.withColumnsRenamed({"source": "one", "h": "h_one", "zero": "zero_one"}).join(other, "lang").filter("one < two")
    sums = met.select("lang", "one", "two", (F.col("terms") * apart(F.col("zero_one"), F.col("zero_two")) + _one_sided("h_one", "zero_one", "zero_two") + _one_sided("h_two", "zero_two", "zero_one")).alias("apart"))
    both = sums.join(overlaps(shares.select("lang", "term", "source", "p", "zero"), langs, block), ["lang", "one", "two"], "left")
    valued = both.select("lang", "one", "two", (F.col("apart") + F.coalesce("value", F.lit(0))).alias("value"))
    sides = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item"))))
    best = (F.col("value").desc(), F.col("item"))
    group = Window.partitionBy("lang", "source").orderBy(*best)
    pairs = valued.select("lang", sides.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", F.row_number().over(group))

    against = share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    marked = shares.withColumn("q", against).filter(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    marked = marked.withColumn("rank", F.row_number().over(group)).filter(F.col("rank") <= top)
    return pairs.unionByName(marked)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SHARE = "1 + 1000000000::HUGEINT * ({0} + 2) // ({1} + 2 * terms)"
_APART = "(p - q) * (p - q) // (p + q)"
ORACLES = {
    "op11_divergence": rf"""
WITH term AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), place AS (
  SELECT r, lang, source, unnest(terms) AS term FROM term
), kept AS (
  SELECT lang, term, count(*) AS n FROM place GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCS}
), lang AS (
  SELECT lang, sum(n) AS total, count(*) AS terms FROM kept GROUP BY lang
), counted AS (
  SELECT lang, source, term, count(*) AS n FROM place SEMI JOIN kept USING (lang, term) GROUP BY ALL
), grouped AS (
  SELECT DISTINCT lang, source FROM term
), summed AS (
  SELECT lang, source, sum(n) AS total FROM counted GROUP BY ALL
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_SHARE.format("coalesce(c.n, 0)", "coalesce(s.total, 0)")} AS p, {_SHARE.format("k.n", "l.total")} AS q
  FROM grouped AS g JOIN kept AS k USING (lang) JOIN lang AS l USING (lang)
  LEFT JOIN counted AS c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN summed AS s ON s.lang = g.lang AND s.source = g.source
), two AS (
  SELECT a.lang, a.source, b.source AS item, a.p, b.p AS q FROM dense AS a JOIN dense AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
), valued AS (
  SELECT lang, source, item, sum({_APART}) AS value FROM two GROUP BY ALL
), part AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v.value, 0)::BIGINT AS value
  FROM grouped AS a JOIN grouped AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN valued AS v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ({_APART})::BIGINT FROM dense WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM part QUALIFY part = 'pair' OR rank <= {TOP}
"""
}
QUERIES = {"op11_divergence": op11_divergence}
