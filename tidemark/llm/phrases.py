"""Phrase collocations from merged count tries (operator 12).

A phrase is a run of words within a piece of text.  Each task counts its texts
in a trie of limited depth, whose nodes are words, and serialises it as rows
``a, b, c, times`` in order of the path.  The tries of all tasks are merged by
prefix range: rows are range-partitioned by path and equal paths added up, so a
hot first word is spread over partitions.  The depths are counted one after
another, as a phrase can be frequent only if its parts are: a path joins the
trie of depth 2 or 3 only if the shorter phrases on it may be frequent, which a
Bloom filter of at most ``2 ** BITS`` bits answers, whatever the size of the
corpus.  A wrong yes costs a row and changes no count.

Frequent phrases then meet their parts: rows of depth 2 and 3 in one range
partitioning lie behind their parent, so one walk in order of the path hands
the left parts down, and the right parts come by the suffix link from ``a b c``
to ``b c``.

Words are numbered by 64 bits of their spelling and language.  That no two
share a number is checked over the whole vocabulary; if some do, it is counted
again with other numbers.

Defined results: a null text is empty, a null lang is ``und``; rows are counted
one by one, whatever their ids; a language without candidates has no rows; ties
go by the bytes of the phrase.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.base import byte_slices, read, written, written_by_batches
from tidemark.llm.runs import Runs
from tidemark.llm.wordhash import PIECE_ENDS, Spans, Words, folded, mix, spelled

#: Least occurrences of a phrase, percentage of them within one longer phrase that makes it a part of that, and phrases reported of a language.
LEAST, COVERED, TOP = 10, 50, 2000
#: Bytes of text counted together, log2 of a filter's most bits, bits of a filter for each member.
SLICE, BITS, BITS_EACH = 512 << 10, 27, 16
#: Texts that are sent to a task's Python at a time.
SENT = 1000
#: Rows at which a task merges its runs, and that a merge may leave.
MERGE, SEND = 400_000, 250_000
#: Groups that rank a language's candidates before the last ranking.
SALTS = 64

_UND = "und"


def _hash_of(word: str) -> np.uint64:
    data = np.frombuffer(word.encode(), np.uint8)
    return Spans(data, fold=False).hashes(np.array([0]), np.array([len(data)]))[0]


class Numbered:
    """The words of some texts in order: numbers, and whether the next word follows in the same piece."""

    def __init__(self, langs: list[str], texts: pa.Array, seed: int):
        self.words = words = Words(texts, "piece")
        if not len(words.rows):
            self.numbers, self.goes_on = np.zeros(0, np.int64), np.zeros(0, bool)
            return
        spelling = Spans(folded(words.data) ^ np.uint8(seed), fold=False).hashes(words.starts, words.ends)
        own = {x: _hash_of(x) for x in set(langs)}
        self.numbers = mix(spelling ^ mix(np.array([own[x] for x in langs], np.uint64) + np.uint64(seed))[words.rows]).view(np.int64)
        breaks = np.r_[0, np.cumsum(PIECE_ENDS[words.data])]
        self.goes_on = np.r_[(words.rows[1:] == words.rows[:-1]) & (breaks[words.starts[1:]] == breaks[words.ends[:-1]]), False]


def _slices(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[list[str], Numbered]]:
    for batch in batches:
        langs = [x if x is not None else _UND for x in batch.column(0).to_pylist()]
        for a, b in byte_slices(batch.column(1), SLICE):
            yield langs[a:b], Numbered(langs[a:b], batch.column(1).slice(a, b - a), seed)


def _roots(seed: int):
    """The words of a task's texts: number, lang, word, times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        runs = Runs(1, MERGE, SEND)

        def rows(merged):
            (number, times, lang), words = merged
            names = np.array(list(langs), object)
            return pa.RecordBatch.from_arrays([pa.array(number), pa.array(names[lang // times], pa.string()), words, pa.array(times)], ["number", "lang", "word", "times"])

        for own, some in _slices(batches, seed):
            if not len(some.numbers):
                continue
            number, at, times = np.unique(some.numbers, return_index=True, return_counts=True)
            words = some.words
            lang = np.array([langs.setdefault(x, len(langs)) for x in own])[words.rows[at]]
            names = spelled(folded(words.data), words.starts[at], words.ends[at])
            for merged in runs.add([number, times, lang * times], names):  # lang follows from the number: its sum over times is told apart again
                yield rows(merged)
        for merged in runs.rest():
            yield rows(merged)

    return count


def words(docs: DataFrame) -> tuple[DataFrame, int]:
    """(number, lang, word, times) of all words of docs(lang, text), and the seed by which no two share a number."""
    for turn in range(8):
        found = docs.select("lang", "text").mapInArrow(_roots(turn), "number long, lang string, word string, times long")
        table = written_by_batches(found.groupBy("number", "lang", "word").agg(F.sum("times").alias("times")), SENT)
        if table.groupBy("number").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            return table, turn
    raise RuntimeError("no numbering of the words without a clash")


class Gate:
    """A Bloom filter with two bits a member."""

    def __init__(self, bits: np.ndarray):
        self._bits, self._mask = bits, np.uint64(len(bits) * 64 - 1)

    def _has(self, places: np.ndarray) -> np.ndarray:
        places = places & self._mask
        return (self._bits[(places >> np.uint64(6)).astype(np.int64)] >> (places & np.uint64(63))) & np.uint64(1) == 1

    def holds(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.view(np.uint64)
        return self._has(keys) & self._has(mix(keys))


def _two_bits(bits: int):
    """Keys to the words of the filter that they set: place, word."""

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            places = np.r_[keys, mix(keys)] & np.uint64(bits - 1)
            yield pa.RecordBatch.from_arrays([pa.array((places >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (places & np.uint64(63))).view(np.int64))], ["place", "word"])

    return set_bits


def gate(keys: DataFrame) -> Gate:
    """A filter of keys(key): at most 2 ** BITS bits, so at most 2 ** (BITS - 6) rows come to the driver."""
    bits = 1 << min(BITS, max(10, math.ceil(math.log2(BITS_EACH * max(1, keys.count())))))
    found = keys.mapInArrow(_two_bits(bits), "place long, word long").groupBy("place").agg(F.bit_or("word").alias("word")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found.column("place").to_numpy()] = found.column("word").to_numpy().view(np.uint64)
    return Gate(out)


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(mix(first.view(np.uint64)) * np.uint64(0xD1342543DE82EF95) + second.view(np.uint64)).view(np.int64)


def _paths(depth: int, seed: int, allowed):
    """Serialised tries of one depth: the paths whose shorter phrases pass the gate, in order, and how often each was seen."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "c"][:depth]
        runs = Runs(depth, MERGE, SEND)

        def rows(merged):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in merged[0]], [*names, "times"])

        for _, some in _slices(batches, seed):
            numbers, on = some.numbers, some.goes_on
            if len(numbers) < depth:
                continue
            if depth == 2:
                may = allowed.value.holds(numbers)
                at = np.flatnonzero(on[:-1] & may[:-1] & may[1:])
            else:
                may = np.zeros(len(numbers), bool)
                pairs = np.flatnonzero(on[:-1])
                may[pairs] = allowed.value.holds(pair_key(numbers[pairs], numbers[pairs + 1]))
                at = np.flatnonzero(may[:-2] & may[1:-1])
            if not len(at):
                continue
            alone, place = np.unique(numbers, return_inverse=True)
            key = place[at].astype(np.int64) * len(alone) + place[at + 1]
            if depth == 3:
                twos, key = np.unique(key, return_inverse=True)
                key = key.astype(np.int64) * len(alone) + place[at + 2]
            key, times = np.unique(key, return_counts=True)
            last = alone[key % len(alone)]
            two = key // len(alone)
            path = [alone[two], last] if depth == 2 else [alone[twos[two] // len(alone)], alone[twos[two] % len(alone)], last]
            for merged in runs.add([*path, times]):
                yield rows(merged)
        for merged in runs.rest():
            yield rows(merged)

    return count


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(pair_key(batch.column("a").to_numpy(), batch.column("b").to_numpy()))], ["key"])


def paths(docs: DataFrame, depth: int, seed: int, allowed: Gate, least: int) -> DataFrame:
    """The merged trie's paths of one depth that were seen at least ``least`` times."""
    names = ["a", "b", "c"][:depth]
    held = docs.sparkSession.sparkContext.broadcast(allowed)
    tries = written_by_batches(docs.select("lang", "text").mapInArrow(_paths(depth, seed, held), ", ".join(f"{x} long" for x in (*names, "times"))), SENT)
    held.destroy()
    return written(tries.repartitionByRange(*names).groupBy(*names).agg(F.sum("times").alias("times")).filter(F.col("times") >= least))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hands the values of a path of depth 2 to the paths below it, which follow it; gives those of depth 3."""
    kept = None
    for batch in batches:
        parent = batch.column("parent").to_numpy(zero_copy_only=False)
        if not len(parent):
            continue
        table = pa.Table.from_batches([batch])
        if kept is not None:
            table = pa.concat_tables([kept, table]).combine_chunks()
            parent = np.r_[True, parent]
        above = np.maximum.accumulate(np.where(parent, np.arange(len(parent)), 0))
        down = np.flatnonzero(~parent)
        if len(down):
            at, up = pa.array(down), pa.array(above[down])
            own, left = table.select(["b", "c", "times"]).take(at), table.select(["times", "l", "lang", "phrase"]).take(up).rename_columns(["two", "one", "lang", "left"])
            for part in pa.Table.from_arrays([*own.columns, *left.columns], names=[*own.column_names, *left.column_names]).to_batches():
                yield part
        kept = table.slice(above[-1], 1)


def _floor(a: str, l: Column, r: Column) -> Column:
    """floor(1000000 a a / (l r)) in whole numbers of up to 38 digits."""
    whole = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (whole(F.col(a)) * whole(F.col(a))).cast("decimal(30,0)"), whole(l) * whole(r))


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """docs(lang, text) to the best phrases of each lang: lang, rank, phrase, a, l, r, n, score."""
    docs = docs.select(F.coalesce("lang", F.lit(_UND)).alias("lang"), "text")
    vocabulary, seed = words(docs)
    totals = vocabulary.groupBy("lang").agg(F.sum("times").alias("n"))
    frequent = written(vocabulary.filter(F.col("times") >= least))
    twos = paths(docs, 2, seed, gate(frequent.select(F.col("number").alias("key"))), least)
    threes = paths(docs, 3, seed, gate(twos.select("a", "b").mapInArrow(_keyed, "key long")), least)

    word = lambda side, times, name: frequent.select(F.col("number").alias(side), F.col("times").alias(times), F.col("word").alias(name), *([F.col("lang")] if side == "a" else []))
    pairs = twos.join(word("a", "l", "first"), "a").join(word("b", "r", "last"), "b")
    pairs = written(pairs.select("a", "b", "times", "l", "r", "lang", F.concat_ws(" ", "first", "last").alias("phrase"), "last"))

    parents = pairs.select("a", "b", F.lit(None).cast("long").alias("c"), "times", "l", "lang", "phrase", F.lit(True).alias("parent"))
    below = threes.select("a", "b", "c", "times", F.lit(None).cast("long").alias("l"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("phrase"), F.lit(False).alias("parent"))
    ordered = written(parents.unionByName(below)).repartitionByRange("a", "b").sortWithinPartitions("a", "b", F.col("c").asc_nulls_first())
    walked = ordered.mapInArrow(_walk, "b long, c long, times long, two long, one long, lang string, left string")
    linked = pairs.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("times").alias("right_two"), F.col("r").alias("right_one"), "last")
    whole = walked.join(linked, ["b", "c"])
    cuts = whole.select("lang", F.concat_ws(" ", "left", "last").alias("phrase"), F.col("times").alias("a"), F.struct(_floor("times", F.col("one"), F.col("right_two")).alias("score"), F.lit(1).alias("k"), F.col("one").alias("l"), F.col("right_two").alias("r")).alias("x"), F.struct(_floor("times", F.col("two"), F.col("right_one")).alias("score"), F.lit(2).alias("k"), F.col("two").alias("l"), F.col("right_one").alias("r")).alias("y"))
    longer = cuts.withColumn("cut", F.least("x", "y")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    parts = threes.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("c").alias("b")))).alias("p"), "times")
    inside = parts.groupBy("p.a", "p.b").agg(F.max("times").alias("most"))
    free = pairs.join(inside, ["a", "b"], "left").filter(100 * F.coalesce("most", F.lit(0)) < covered * F.col("times"))
    shorter = free.select("lang", "phrase", F.col("times").alias("a"), "l", "r", _floor("times", F.col("l"), F.col("r")).alias("score"))

    best = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    salted = shorter.unionByName(longer).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).filter(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES = {
    "op12_collocations": rf"""
WITH piece AS (
  SELECT coalesce(lang, '{_UND}') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece
), run AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM worded, (VALUES (1), (2), (3)) AS depth(k)
), counted AS (
  SELECT lang, k, phrase, count(*) AS f FROM run GROUP BY ALL
), total AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang
), candidate AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE k > 1 AND f >= {LEAST}
), cut AS (
  SELECT lang, k, phrase, a, w, c, array_to_string(w[1 : c], ' ') AS head, array_to_string(w[c + 1 :], ' ') AS tail FROM candidate, (VALUES (1), (2)) AS spot(c) WHERE c < k
), priced AS (
  SELECT cut.lang, cut.k, cut.phrase, a, w, c, x.f AS l, y.f AS r, 1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS score
  FROM cut JOIN counted AS x ON x.lang = cut.lang AND x.phrase = head JOIN counted AS y ON y.lang = cut.lang AND y.phrase = tail
), least AS (
  SELECT * FROM priced QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), part AS (
  SELECT lang, array_to_string(w[i : i + 1], ' ') AS phrase, max(a) AS most FROM candidate, (VALUES (1), (2)) AS spot(i) WHERE k = 3 GROUP BY ALL
), free AS (
  SELECT least.* FROM least LEFT JOIN part ON part.lang = least.lang AND part.phrase = least.phrase AND k = 2 WHERE 100 * coalesce(most, 0) < {COVERED} * a
)
SELECT free.lang, row_number() OVER (PARTITION BY free.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM free JOIN total ON total.lang = free.lang
QUALIFY rank <= {TOP}
"""
}
QUERIES = {"op12_collocations": op12_collocations}
