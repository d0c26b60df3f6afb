"""Benchmark decontamination by a BM25 index of test items (operator 4).

The test items are indexed; every training passage is a query.  Passages are
windows of twice the longest item's words, one starting at each half, so that
every item-long stretch of a text lies in a window whole.  An item's score for
a window is the BM25 impact of the distinct words they share, as a share of the
item's score for itself; all items of at least ``threshold`` are found.

The search is block-max WAND, run for many windows at once.  Items are in
blocks.  The most frequent words are non-essential as long as they alone could
not bring any item near the threshold.  The essential words of a window add up
the maxima of the blocks in their posting lists; blocks whose sum, with the most
that non-essential words could add there, stays below the threshold are skipped,
and only in the others items are scored, first with the same kind of bound and
then exactly.  Pruning never loses an item above the threshold.

A match is then verified: the item's words are split into question and answer
(the last ``ANSWER`` of them), and both must overlap with the window in runs of
``RUN`` words.

The index of ``ITEMS`` items is broadcast, so its size is bounded; larger item
tables are searched part by part.  Document frequencies, the mean length and the
window are those of all items, so parts find what one index would.

Defined results: null or empty texts have no window, items without words match
nothing; repeated rows each match; equal items all match; a null id is carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.base import SLICE, byte_slices, read
from tidemark.llm.base import written_by_bytes as written
from tidemark.llm.wordhash import Words, chained

#: Least share of an item's own score, and least overlaps of question and answer.
THRESHOLD, QUESTION, RESPONSE = 0.6, 0.5, 0.5
#: BM25's parameters; an item's share of words that count as its answer; words in a verified run.
K1, B, ANSWER, RUN = 1.2, 0.75, 0.25, 3
#: Items in one broadcast index and bytes of their texts, items in a block, and the most that non-essential words may reach.
ITEMS, ITEM_BYTES, BLOCK, IDLE = 20_000, 32 << 20, 8, 0.3


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    n = min(n, len(words))
    return np.unique(chained(words, n)) if n else words


@dataclass
class Stats:
    """Of all items: their number, mean and largest number of words, and in how many of them each of some words (ascending) stands."""

    items: int
    mean: float
    longest: int
    words: np.ndarray
    frequency: np.ndarray


@dataclass
class Index:
    """Posting lists of words over items, their block maxima, and what verification needs."""

    ids: np.ndarray
    terms: np.ndarray
    essential: np.ndarray
    begin: np.ndarray
    item: np.ndarray
    impact: np.ndarray
    block_begin: np.ndarray
    block: np.ndarray
    block_impact: np.ndarray
    rest: np.ndarray
    block_rest: np.ndarray
    stride: int
    runs: list[tuple[np.ndarray, np.ndarray, int, int]]

    @classmethod
    def build(cls, ids: np.ndarray, texts: pa.Array, stats: Stats) -> Index:
        words = Words(texts, "alnum")
        n = len(ids)
        sizes = np.bincount(words.rows, minlength=n)
        terms, at = np.unique(words.hashes, return_inverse=True)
        pairs, tf = np.unique(at * n + words.rows, return_counts=True)
        term, item = pairs // n, pairs % n
        df = stats.frequency[np.searchsorted(stats.words, terms)]
        idf = np.log1p((stats.items - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[item] / stats.mean))
        impact /= np.bincount(item, impact, n)[item]
        begin = np.searchsorted(term, np.arange(len(terms) + 1))
        rest, essential = np.zeros(n), np.ones(len(terms), bool)
        for t in np.argsort(-df, kind="stable").tolist():
            mine = slice(begin[t], begin[t + 1])
            if (rest[item[mine]] + impact[mine]).max() > IDLE:
                break
            rest[item[mine]] += impact[mine]
            essential[t] = False
        blocks = max(1, -(-n // BLOCK))
        keys, back = np.unique(term * blocks + item // BLOCK, return_inverse=True)
        peak = np.zeros(len(keys))
        np.maximum.at(peak, back, impact)
        block_rest = np.zeros(blocks)
        np.maximum.at(block_rest, np.arange(n) // BLOCK, rest)
        ends = np.searchsorted(words.rows, np.arange(n + 1))
        runs = []
        for k in range(n):
            own = words.hashes[ends[k] : ends[k + 1]]
            cut = len(own) - max(1, round(ANSWER * len(own))) if len(own) > 1 else len(own)
            runs.append((_runs(own[:cut], RUN), _runs(own[cut:], RUN), min(RUN, cut), min(RUN, len(own) - cut)))
        return cls(ids, terms, essential, begin, item, impact, np.searchsorted(keys // blocks, np.arange(len(terms) + 1)), keys % blocks, peak, rest, block_rest, max(8, stats.longest), runs)

    @staticmethod
    def _spread(begin: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the lists of some words, and whose they are."""
        counts = begin[which + 1] - begin[which]
        owner = np.repeat(np.arange(len(which)), counts)
        return begin[which][owner] + np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner], owner

    def matches(self, texts: pa.Array, threshold: float) -> list[tuple[int, int, int, float, float, float]]:
        """(row, item, first word, score, question overlap, answer overlap) of each pair of window and item."""
        words = Words(texts, "alnum")
        if not len(words.hashes) or not len(self.terms):
            return []
        at = np.minimum(np.searchsorted(self.terms, words.hashes), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[at] == words.hashes)
        first = np.searchsorted(words.rows, np.arange(len(texts) + 1))
        half = (np.arange(len(words.rows)) - first[words.rows]) // self.stride
        base = np.cumsum(np.bincount(words.rows, minlength=len(texts)) // self.stride + 2)
        base = np.r_[0, base[:-1]]
        window = base[words.rows] + half
        # every word counts in the window that starts with its half and in the one before
        n, slots = len(self.terms), np.concatenate([window[known], window[known][half[known] > 0] - 1])
        both = np.concatenate([at[known], at[known][half[known] > 0]])
        pairs = np.unique(slots * n + both)
        slot, term = pairs // n, pairs % n
        main = self.essential[term]
        places, owner = self._spread(self.block_begin, term[main])
        blocks = len(self.block_rest)
        keys, back = np.unique(slot[main][owner] * blocks + self.block[places], return_inverse=True)
        bound = np.bincount(back, self.block_impact[places], len(keys)) + self.block_rest[keys % blocks]
        keys = keys[bound >= threshold]
        if not len(keys):
            return []
        live = np.isin(slot, keys // blocks)
        slot, term = slot[live], term[live]
        items = len(self.rest)
        for part in (self.essential[term], np.ones(len(term), bool)):  # by bound, then exactly
            places, owner = self._spread(self.begin, term[part])
            mine = slot[part][owner]
            inside = np.isin(mine * blocks + self.item[places] // BLOCK, keys)
            pair, back = np.unique(mine[inside] * items + self.item[places][inside], return_inverse=True)
            score = np.bincount(back, self.impact[places][inside], len(pair))
            if not part.all():
                pair = pair[score + self.rest[pair % items] >= threshold]
                keys = np.unique(pair // items * blocks + pair % items // BLOCK)
        out = []
        good = score >= threshold - 1e-12
        for p, s in zip(pair[good].tolist(), score[good].tolist(), strict=True):
            w, k = divmod(p, items)
            row = int(np.searchsorted(base, w, side="right") - 1)
            start = first[row] + (w - base[row]) * self.stride
            own = words.hashes[start : min(start + 2 * self.stride, first[row + 1])]
            question, answer, nq, na = self.runs[k]
            shares = [float(np.isin(runs, chained(own, n)).mean()) if len(runs) else 1.0 for runs, n in ((question, nq), (answer, na))]
            out.append((row, k, int(start - first[row]), s, *shares))
        return out


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, text) to (part, word, items, words, longest): in how many of some items each word stands; word null: the items themselves."""
    names = ["part", "word", "items", "words", "longest"]
    for batch in batches:
        for a, b in byte_slices(batch.column("text"), SLICE):
            words, part = Words(batch.column("text").slice(a, b - a), "alnum"), batch.column("part").slice(a, b - a)
            pairs = np.unique(np.rec.fromarrays([words.hashes.view(np.int64), words.rows]))
            counts = np.bincount(words.rows, minlength=b - a)
            ones = pa.array(np.ones(len(pairs), np.int64))
            yield pa.RecordBatch.from_arrays([part.take(pa.array(pairs.f1)), pa.array(pairs.f0), ones, *[pa.nulls(len(pairs), pa.int64())] * 2], names)
            yield pa.RecordBatch.from_arrays([part, pa.nulls(b - a, pa.int64()), pa.array(np.ones(b - a, np.int64)), pa.array(counts), pa.array(counts)], names)


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of docs(doc_id, text) and items(item_id, text): doc_id, item_id, first_word, score, question, answer."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    parts = max(1, -(-size["n"] // ITEMS), -(-size["bytes"] // ITEM_BYTES))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int").alias("part"))
    counts = items.select("part", "text").mapInArrow(_item_words, "part int, word long, items long, words long, longest long")
    counts = written(counts.groupBy("part", "word").agg(F.sum("items").alias("items"), F.sum("words").alias("words"), F.max("longest").alias("longest")))
    total = counts.filter("word is null").agg(F.sum("items"), F.sum("words"), F.max("longest")).first()
    frequency = written(counts.filter("word is not null").groupBy("word").agg(F.sum("items").alias("items")))
    found = None
    for k in range(parts):
        some = items.filter(F.col("part") == k).select("item_id", "text").orderBy("item_id", "text").toArrow().combine_chunks()
        texts = some.column(1).combine_chunks() if some.num_rows else pa.array([], pa.string())
        mine = frequency.join(counts.filter(F.col("part") == k).select("word"), "word", "left_semi").toArrow()
        word, df = mine.column("word").to_numpy().view(np.uint64), mine.column("items").to_numpy()
        order = np.argsort(word)
        stats = Stats(total[0] or 0, max((total[1] or 0) / max(total[0] or 0, 1), 1e-9), total[2] or 0, word[order], df[order])
        held = spark.sparkContext.broadcast(Index.build(some.column(0).to_numpy() if some.num_rows else np.zeros(0), texts, stats))

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                for a, b in byte_slices(batch.column("text"), SLICE):
                    hits = [(ids[a + r], None if index.ids[i] != index.ids[i] else int(index.ids[i]), w, s, q, r2) for r, i, w, s, q, r2 in index.matches(batch.column("text").slice(a, b - a), threshold)]
                    if hits:
                        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*hits, strict=True), kinds, strict=True)], ["doc_id", "item_id", "first_word", "score", "question", "answer"])

        part = rows.mapInArrow(search, "doc_id long, item_id long, first_word long, score double, question double, answer double")
        if parts > 1:  # one index at a time is sent out
            part = written(part)
            held.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Verified leaks, once for each document and item: doc_id, item_id, score."""
    verified = leaks(docs, items).filter((F.col("question") >= QUESTION) & (F.col("answer") >= RESPONSE))
    return verified.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak of a benchmark item into a document."""
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {"op4_decontam": op4_decontam}
ORACLES: dict[str, str] = {}
