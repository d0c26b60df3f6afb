"""Exact top-k search by BM25 with block-max pruning, per shard (operator 10).

Queries are whole texts of rows; the collection is every row.  A shard is a
bounded batch of rows within a task.  Its inverted index, a posting list for each
word, is made once and written as a row of a table; document frequencies and the
mean length are summed over all shards, so scores do not depend on how rows are
dealt to them.  In a shard, rows that share frequent words, such as texts of one
language, form groups; each list has its BM25 impacts and its maximum by group.

The search of a shard is block-max WAND.  Groups whose bound, the sum of a query's
list maxima, stays below the query's k-th best score so far are skipped, and none
of their postings are read.  In the others rarer words are added up by row first;
where these sums and the maxima of the frequent words can reach the score, what
the frequent words add comes from a product of matrices for many queries at once.
All this is in single precision, which bounds a score within a known rounding;
only rows whose bound reaches the score are added up exactly, from their own
words.  A share of the rows is searched first, and its k-th best scores are
thresholds for all other shards.  The best rows are merged exactly, as no
shard drops one of its k best that reaches the threshold, and all scores are
global.

Queries travel in broadcast blocks of at most ``QUERY_WORDS`` words in all; a
block reads the written index, not the texts, and its broadcasts go with it.

Defined results: null and empty texts have no words, find nothing and are not
found; score ties go to the smaller id; repeated rows are found each; query rows
that share an id are one query of all their words; rows with a null id are
neither queries nor results; a row finds itself.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.base import byte_slices, read, written, written_by_bytes, written_by_files
from tidemark.llm.wordhash import Words

#: Results a query, BM25's parameters, and the words in one broadcast block of queries.
TOP, K1, B, QUERY_WORDS = 10, 1.2, 0.75, 4_000_000
#: Decimals of a score, and what rounding may have added to a threshold.
DIGITS, SLACK = 9, 1e-8
#: One row of so many goes ahead to give thresholds, in so many times fewer tasks where there are more than cores.
AHEAD, FEWER = 8, 4
#: Bytes of text in a shard, rows in a block (by which reading is counted), and the most rows in a group.
SHARD_BYTES, BLOCK, GROUP = 32 << 20, 16, 2048
#: Kinds of rows that a shard tells apart, and rounds for that.
KINDS, ROUNDS = 6, 3
#: The share of a group's rows, and of all rows (in geometric mean), from which a word is added up by matrices, the most such words, and the most values of these matrices.
FREQUENT, MOST, IMPACTS = 0.035, 1200, 1 << 23
#: Queries that are looked up together, those in one product of matrices, and the most sums of them.
AT_ONCE, TOGETHER, SUMS = 1024, 256, 1 << 19
#: Rows of a group that may reach a query's score before the score is raised, as a multiple of k, and the most postings that are added up at once.
RAISED, POSTINGS = 4, 1 << 20


def _distinct(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, row, times) of the distinct words of each text, by word then row, and each text's number of words."""
    parts, sizes = [], np.zeros(len(texts), np.int64)
    for a, b in byte_slices(texts):
        words = Words(texts.slice(a, b - a), "alnum")
        sizes[a:b] = np.bincount(words.rows, minlength=b - a)
        order = np.argsort(words.hashes, kind="stable")  # rows ascend as they are
        word, row = words.hashes[order], words.rows[order]
        first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (row[1:] != row[:-1])]) if len(word) else np.zeros(0, np.int64)
        parts.append((word[first], (a + row[first]).astype(np.int32), np.diff(np.r_[first, len(order)]).astype(np.int32)))
    word, row, times = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.uint64)] * 3
    parts.clear()
    order = np.argsort(word, kind="stable")  # slices follow each other, so rows stay in order
    return word[order], row[order], times[order], sizes


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(ids, texts) of consecutive rows, of about SHARD_BYTES together."""
    ids, texts, held = [], [], 0
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, before + SHARD_BYTES - held, side="right")))
            ids.append(batch.column("doc_id").slice(at, to - at))
            texts.append(batch.column("text").slice(at, to - at))
            held += sizes[to - 1] - before
            at = to
            if held >= SHARD_BYTES:
                yield pa.concat_arrays(ids).to_numpy(), pa.concat_arrays(texts)
                ids, texts, held = [], [], 0
    if ids:
        yield pa.concat_arrays(ids).to_numpy(), pa.concat_arrays(texts)


def _query_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        word, row, _, _ = _distinct(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(word.view(np.int64))], ["query", "word"])


class Index(NamedTuple):
    """Posting lists of a shard's rows: words ascend, and list i is rows and times from begin[i] to begin[i + 1].

    Rows are laid by likeness and then by length; groups: where each group of them begins, and the last ends.
    """

    ids: np.ndarray
    sizes: np.ndarray
    groups: np.ndarray
    words: np.ndarray
    begin: np.ndarray
    row: np.ndarray
    times: np.ndarray


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start, so many as counted, one range after another."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def _by(values: np.ndarray) -> np.ndarray:
    """The stable order of small numbers."""
    return np.argsort(values.astype(np.uint16) if not len(values) or values.max() < 1 << 16 else values, kind="stable")


def _kinds(term: np.ndarray, row: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """A number for each of n rows, mostly equal for rows that share frequent words, such as texts of one language: rounds of spherical means.

    It decides what is read together, and no score.
    """
    often = np.flatnonzero(counts > FREQUENT * n)
    often = often[np.argsort(-counts[often], kind="stable")][: min(MOST, IMPACTS // max(1, n))]
    if not len(often):
        return np.zeros(n, np.int64)
    column = np.full(len(counts), -1)
    column[often] = np.arange(len(often))
    kept = column[term] >= 0
    has = np.zeros((n, len(often)), np.float32)
    has[row[kept], column[term[kept]]] = 1
    norm = np.sqrt(has.sum(1))
    has /= np.maximum(norm, 1)[:, None]
    full = has[norm >= np.median(norm)]
    middle, near = full[:1], full @ full[0]
    while len(middle) < KINDS:  # each time the row that is least like those chosen
        middle = np.r_[middle, full[near.argmin()][None]]
        near = np.maximum(near, full @ middle[-1])
    for _ in range(ROUNDS):
        kind = (has @ middle.T).argmax(1)
        middle = np.array([has[kind == c].sum(0) for c in range(KINDS)])
        middle /= np.maximum(np.sqrt((middle**2).sum(1)), 1e-9)[:, None]
    return (has @ middle.T).argmax(1)


def _indexed(ids: np.ndarray, texts: pa.Array) -> Index:
    word, row, times, sizes = _distinct(texts)
    n = len(ids)
    begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
    words, begin = word[begin], np.r_[begin, len(word)]
    counts = np.diff(begin)
    term = np.repeat(np.arange(len(words), dtype=np.int32), counts)
    least = np.full(n, len(words), np.int64)
    least[row[::-1]] = term[::-1]  # terms ascend, so the least is written last
    kind = _kinds(term, row, counts, n)
    order = np.lexsort((ids, least, sizes, kind))  # copies side by side
    place = np.empty(n, np.int32)
    place[order] = np.arange(n)
    row = place[row]
    sort = np.argsort(term.astype(np.int64) * n + row)
    ends = np.flatnonzero(np.diff(kind[order])) + 1
    groups = [np.linspace(a, b, -(-(b - a) // GROUP) + 1).astype(np.int64) for a, b in itertools.pairwise([0, *ends.tolist(), n]) if a < b]
    return Index(ids[order], sizes[order], np.unique(np.concatenate(groups)) if groups else np.zeros(1, np.int64), words, begin, row[sort], times[sort])


#: A row of the written index: a shard's rows and words, and its parts; words and counts are arrays for the sums over all shards.
INDEX = "n long, n_words long, ids binary, sizes binary, groups binary, words array<long>, counts array<int>, row binary, times binary"


def _least_type(values: np.ndarray) -> np.ndarray:
    return values.astype(next(t for t in ("<u1", "<u2", "<u4") if not len(values) or values.max() <= np.iinfo(t).max))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards as rows of INDEX."""
    for ids, texts in _shards(batches):
        x = _indexed(ids, texts)
        whole = [pa.array([len(x.ids)], pa.int64()), pa.array([int(x.sizes.sum())], pa.int64())]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x.words)], pa.int32()), pa.array(v)) for v in (x.words.view(np.int64), np.diff(x.begin).astype(np.int32))]
        ids, sizes, groups, row, times = (pa.array([v.tobytes()], pa.binary()) for v in (x.ids.astype("<i8"), x.sizes.astype("<i8"), x.groups.astype("<i8"), _least_type(x.row), _least_type(x.times)))
        yield pa.RecordBatch.from_arrays([*whole, ids, sizes, groups, *lists, row, times], [c.split()[0] for c in INDEX.split(", ")])


def _indices(batches: Iterator[pa.RecordBatch]) -> Iterator[Index]:
    """What _index has written."""
    for batch in batches:
        for i in range(batch.num_rows):
            raw = {c: np.frombuffer(batch.column(c)[i].as_buffer(), "<i8") for c in ("ids", "sizes", "groups")}
            words, counts = (batch.column(c)[i].values.to_numpy() for c in ("words", "counts"))
            begin = np.r_[0, np.cumsum(counts, dtype=np.int64)]
            lists = [np.frombuffer(b, f"<u{max(1, b.size // max(1, begin[-1]))}").astype(np.int32) for b in (batch.column(c)[i].as_buffer() for c in ("row", "times"))]
            yield Index(**raw, words=words.view(np.uint64), begin=begin, row=lists[0], times=lists[1])


#: What a group's list holds of a row, read eight bytes at a time.
POSTING = np.dtype([("row", np.int32), ("impact", np.float32)])


#: A group's list: its maximum, its column (or -1) among the frequent ones, where it starts and how much it holds, read sixteen bytes at a time.
LIST = np.dtype([("peak", np.float32), ("column", np.int32), ("start", np.int32), ("held", np.int32)])


class Part(NamedTuple):
    """A group of rows from low to high: lists, by places that piece has for words of the shard (or -1), their postings, and the number of frequent ones."""

    low: int
    high: int
    piece: np.ndarray
    lists: np.ndarray
    postings: np.ndarray
    frequent: int


class Shard:
    """The index of some rows for the words of some queries.

    Every posting list is cut by groups of rows, each part with its maximum.  A group's most
    frequent words also have a column each of all impacts, for products of matrices.
    """

    def __init__(self, ids: np.ndarray, texts: pa.Array, vocabulary: np.ndarray, idf: np.ndarray, mean: float):
        self._open(_indexed(ids, texts), vocabulary, idf, mean)

    @classmethod
    def of(cls, index: Index, vocabulary: np.ndarray, idf: np.ndarray, mean: float) -> Shard:
        shard = cls.__new__(cls)
        shard._open(index, vocabulary, idf, mean)
        return shard

    def _open(self, index: Index, vocabulary: np.ndarray, idf: np.ndarray, mean: float) -> None:
        self.ids, self.rows = index.ids, len(index.ids)
        at = np.minimum(np.searchsorted(vocabulary, index.words), max(0, len(vocabulary) - 1))
        known = np.flatnonzero(vocabulary[at] == index.words) if len(vocabulary) else np.zeros(0, np.int64)
        self.local = np.full(len(vocabulary), -1, np.int32)  # a word of the queries as a word of the shard
        self.local[at[known]] = np.arange(len(known))
        counts = np.diff(index.begin)[known]
        mine = _ranges(index.begin[known], counts)
        term, row, times = np.repeat(np.arange(len(known), dtype=np.int32), counts), index.row[mine], index.times[mine]
        self.idf, self.norm = idf[at[known]], K1 * (1 - B + B * index.sizes / mean)
        impact = (self.idf[term] * times * (K1 + 1) / (times + self.norm[row])).astype(np.float32)
        by_row = _by(row)
        self.row_term, self.row_times = term[by_row], times[by_row]
        self.row_begin = np.r_[0, np.cumsum(np.bincount(row, minlength=self.rows))]
        group = np.searchsorted(index.groups, row, side="right") - 1
        by_group = _by(group)  # words and rows stay in order
        cuts = np.searchsorted(group[by_group], np.arange(len(index.groups)))
        width = min(MOST, IMPACTS // max(1, self.rows))
        self.exact = np.zeros((width, self.rows), np.float32)
        self.parts = []
        for (a, b), (low, high) in zip(itertools.pairwise(cuts.tolist()), itertools.pairwise(index.groups.tolist()), strict=True):
            some = by_group[a:b]
            own, rows, values = term[some], row[some] - np.int32(low), impact[some]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
            piece = np.full(len(known), -1, np.int32)
            piece[own[first]] = np.arange(len(first))
            held = np.diff(np.r_[first, len(own)])
            often = np.flatnonzero(held * np.exp(-self.idf[own[first]]) > FREQUENT**2 * (high - low))  # by the share of these rows and of all, from which queries come
            often = often[np.argsort(-held[often], kind="stable")][:width]
            column = np.full(len(first), -1, np.int32)
            column[often] = np.arange(len(often))
            dense = np.repeat(column, held)
            kept = dense >= 0
            self.exact[dense[kept], rows[kept] + low] = values[kept]
            postings = np.empty(len(own), POSTING)
            postings["row"], postings["impact"] = rows, values
            lists = np.empty(len(first), LIST)
            lists["peak"], lists["column"], lists["start"], lists["held"] = np.maximum.reduceat(values, first) if len(first) else values, column, first, held
            self.parts.append(Part(low, high, piece, lists.view(np.complex128), postings.view(np.int64), len(often)))
        self.blocks = -(-self.rows // BLOCK)
        self.mark = np.zeros(len(known), np.uint64)
        self.read = self.all = 0  # blocks of which rows were scored exactly, and blocks in all, over all queries

    def found(self, terms: np.ndarray, begin: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the k best rows that can be among the best, in order; query i is terms from begin[i] to begin[i + 1].

        least: scores that others have already.
        """
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for a in range(0, len(begin) - 1, AT_ONCE):
            b = min(a + AT_ONCE, len(begin) - 1)
            words = self.local[terms[begin[a] : begin[b]]].astype(np.int64)
            owner = np.repeat(np.arange(b - a), np.diff(begin[a : b + 1]))
            owner, words = owner[words >= 0], words[words >= 0]
            floor = np.maximum(least[a:b], 0.0)
            near = [x for part in self.parts for x in self._near(part, owner, words, floor, k)]
            self.all += self.blocks * (b - a)
            if not near:
                continue
            q, row, sums = (np.concatenate(x) for x in zip(*near, strict=True))
            able = np.flatnonzero(sums >= ((floor - SLACK) * _less(np.bincount(owner, minlength=b - a)))[q])
            able = able[np.argsort(q[able], kind="stable")]
            q, row = q[able], row[able]
            self.read += len(np.unique(q * self.blocks + row // BLOCK))
            scores = self._scores(owner, words, q, row)
            good = np.flatnonzero((scores > 0) & (scores >= least[a:b][q]))
            good = good[np.lexsort((self.ids[row[good]], -scores[good], q[good]))]
            good = good[np.arange(len(good)) - np.searchsorted(q[good], q[good]) < k]
            out.append((q[good] + a, self.ids[row[good]], scores[good]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _near(self, part: Part, owner: np.ndarray, words: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, row, sum in single precision) of rows of a group that may reach the queries' floors, which rise to what k rows reach."""
        at = part.piece[words]
        has = np.flatnonzero(at >= 0)
        at = at[has].astype(np.int64)
        first = np.searchsorted(owner[has], np.arange(len(floor) + 1))
        n, width = np.diff(first), part.high - part.low
        some, less = np.flatnonzero(n), _less(n)
        if not len(some):
            return
        lists = part.lists[at].view(LIST)
        peak, column, start, held = (lists[c] for c in LIST.names)
        bound, of_frequent = np.zeros((2, len(floor)), np.float32)
        bound[some] = np.add.reduceat(peak, first[some])
        of_frequent[some] = np.add.reduceat(np.where(column >= 0, peak, np.float32(0)), first[some])
        live = np.flatnonzero((bound > 0) & (bound >= (floor - SLACK) * less))
        load = np.zeros(len(floor), np.int64)
        load[some] = np.add.reduceat(np.where(column >= 0, 0, held), first[some], dtype=np.int64)
        load, to = np.cumsum(load[live]), 0
        while to < len(live):
            c, to = to, min(to + max(1, min(TOGETHER, SUMS // width)), max(to + 1, np.searchsorted(load, POSTINGS + (load[to - 1] if to else 0), side="right")))
            some = live[c:to]
            mine = _ranges(first[some], n[some])
            i = np.repeat(np.arange(len(some)), n[some])
            rare = np.flatnonzero(column[mine] < 0)
            counts = held[mine[rare]]
            posts = part.postings[_ranges(start[mine[rare]], counts)].view(POSTING)
            sums = np.zeros((len(some), width), np.float32)
            np.add.at(sums.reshape(-1), np.repeat(i[rare] * width, counts) + posts["row"], posts["impact"])
            hot = np.flatnonzero(sums.max(1) + of_frequent[some] >= (floor[some] - SLACK) * less[some] ** 2)
            some, sums = some[hot], sums[hot]
            if not len(some):
                continue
            mine = _ranges(first[some], n[some])
            i, col = np.repeat(np.arange(len(some)), n[some]), column[mine]
            weights = np.zeros((len(some), part.frequent), np.float32)
            weights.reshape(-1)[(i * part.frequent + col)[col >= 0]] = 1
            sums += weights @ self.exact[: part.frequent, part.low : part.high]
            limit = np.maximum((floor[some] - SLACK) * less[some], 1e-30).astype(np.float32)
            reach = sums >= limit[:, None]
            count = np.count_nonzero(reach, axis=1)
            many = np.flatnonzero(count >= k)
            if len(many):  # k rows reach these sums
                kth = np.partition(sums[many], width - k, axis=1)[:, width - k] * less[some[many]]
                floor[some[many]] = np.maximum(floor[some[many]], kth)
                many = many[count[many] > RAISED * k]
                limit = np.maximum((floor[some] - SLACK) * less[some], 1e-30).astype(np.float32)
                reach[many] = sums[many] >= limit[many, None]
            able = np.flatnonzero(count)
            q, row = np.divmod(np.flatnonzero(reach[able]), width)
            yield some[able[q]], row + part.low, sums[able[q], row]

    def _scores(self, owner: np.ndarray, words: np.ndarray, q: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The scores of pairs of query and row, by query; the words of a row are added up in one order."""
        scores, held = np.zeros(len(q)), np.diff(self.row_begin)[row]
        at = 0
        while at < len(q):  # a query is a bit, so that 64 of them share the marks
            to = min(np.searchsorted(q, q[at] + 64), max(at + 1, at + np.searchsorted(np.cumsum(held[at : at + POSTINGS]), POSTINGS)))
            ours = slice(*np.searchsorted(owner, [q[at], q[to - 1] + 1]))
            np.bitwise_or.at(self.mark, words[ours], np.uint64(1) << (owner[ours] - q[at]).astype(np.uint64))
            posts = _ranges(self.row_begin[row[at:to]], held[at:to])
            pair = np.repeat(np.arange(to - at), held[at:to])
            hit = np.flatnonzero(self.mark[self.row_term[posts]] >> (q[at:to] - q[at]).astype(np.uint64)[pair] & np.uint64(1))
            posts, pair = posts[hit], pair[hit]
            times = self.row_times[posts]
            sums = np.bincount(pair, self.idf[self.row_term[posts]] * times * (K1 + 1) / (times + self.norm[row[at:to]][pair]), to - at)
            scores[at:to] = np.round(sums, DIGITS)  # equal texts get equal scores in any shard
            self.mark[words[ours]] = 0
            at = to
        return scores

    def search(self, queries: list[np.ndarray], least: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, ids, scores) of what is found, for each query that finds something."""
        terms = np.concatenate(queries) if queries else np.zeros(0, np.int32)
        q, ids, scores = self.found(terms, np.r_[0, np.cumsum([len(x) for x in queries], dtype=np.int64)], least, k)
        for a, b in itertools.pairwise(np.flatnonzero(np.diff(q, prepend=-1, append=-1)).tolist()):
            yield int(q[a]), ids[a:b], scores[a:b]


def _less(n: np.ndarray) -> np.ndarray:
    """The least share of a sum of so many positive values that rounding in single precision leaves, and of its inverse."""
    return 1 - (n + 8) * 2.0**-23


def top_k(docs: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """For queries(doc_id, text), the k best rows of docs(doc_id, text): query_id, rank, doc_id, score."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    asked = queries.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    share = F.pmod(F.xxhash64("doc_id"), F.lit(AHEAD)) == 0
    tasks = rows.rdd.getNumPartitions()
    fewer = rows.filter(share).coalesce(max(1, tasks // FEWER, min(tasks, docs.sparkSession.sparkContext.defaultParallelism)))
    shards = [written_by_bytes(x.mapInArrow(_index, INDEX)) for x in (fewer, rows.filter(~share))]
    both = shards[0].unionByName(shards[1])
    total = both.agg(F.sum("n").alias("rows"), F.sum("n_words").alias("words")).first()
    n, mean = (total["rows"], max(total["words"] / total["rows"], 1e-9)) if total["rows"] else (0, 1.0)
    counts = written(both.select(F.inline(F.arrays_zip("words", "counts"))).groupBy(F.col("words").alias("word")).agg(F.sum("counts").alias("rows")))
    words = asked.mapInArrow(_query_words, "query long, word long").distinct()
    df = F.col("rows")
    weighed = written(words.join(counts, "word").select("query", "word", F.log1p((n - df + 0.5) / (df + 0.5)).alias("idf")))
    parts = max(1, -(-weighed.count() // QUERY_WORDS))
    found = None
    for part in range(parts):
        some = weighed.filter(F.pmod(F.xxhash64("query"), F.lit(parts)) == part).toArrow()
        hits = _search(shards, [some.column(c).to_numpy() for c in range(3)], mean, k)
        found = hits if found is None else found.unionByName(hits)
    return _best(found, k).select("query_id", "rank", "doc_id", "score")


def _best(hits: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return hits.withColumn("rank", place).filter(F.col("rank") <= k)


def _search(shards: list[DataFrame], weighed: list[np.ndarray], mean: float, k: int) -> DataFrame:
    """Rows with the k best for a block of queries, given as (query, word, idf).

    A share of the rows goes first; its k-th best scores are thresholds for the
    others, so tasks return about the rows that can still be among the best.
    """
    query, word, idf = weighed
    vocabulary, first, term = np.unique(word.view(np.uint64), return_index=True, return_inverse=True)
    order = np.lexsort((term, query))
    names, begin = np.unique(query[order], return_index=True)
    spark = shards[0].sparkSession
    held = spark.sparkContext.broadcast((vocabulary, idf[first], names, term[order].astype(np.int32), np.r_[begin, len(order)]))

    def searched(some: DataFrame, least: np.ndarray) -> DataFrame:
        floor = spark.sparkContext.broadcast(least)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # query, row, score
            for at, index in enumerate(_indices(batches)):
                vocabulary, idf, names, terms, begin = held.value
                reached = reached if at else floor.value.copy()
                more = Shard.of(index, vocabulary, idf, mean).found(terms, begin, reached, k)
                q, docs, scores = (np.concatenate(x) for x in zip(best, more, strict=True))
                order = np.lexsort((docs, -scores, q))
                place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
                best = [x[order[place < k]] for x in (q, docs, scores)]
                kth = order[place == k - 1]
                reached[q[kth]] = np.maximum(reached[q[kth]], scores[kth])
            if len(best[0]):
                yield pa.RecordBatch.from_arrays([pa.array(names[best[0]]), pa.array(best[1]), pa.array(best[2])], ["query_id", "doc_id", "score"])

        found = written_by_files(some.mapInArrow(search, "query_id long, doc_id long, score double"))
        floor.destroy()
        return found

    ahead = searched(shards[0], np.zeros(len(names)))
    kth = _best(ahead, k).filter(F.col("rank") == k).select("query_id", "score").toArrow()
    least = np.zeros(len(names))
    least[np.searchsorted(names, kth.column("query_id").to_numpy())] = kth.column("score").to_numpy()
    found = ahead.unionByName(searched(shards[1], least))
    held.destroy()
    return found


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return top_k(docs, docs.filter("doc_id % 50 = 0"))


QUERIES = {"op10_topk": op10_topk}
#: All scores of all rows.
ORACLES = {
    "op10_topk": r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
tf AS (SELECT doc_id, word, count(*) AS times FROM (SELECT doc_id, unnest(w) AS word FROM t) GROUP BY 1, 2),
size AS (SELECT doc_id, len(w) AS n, avg(len(w)) OVER () AS mean, count(*) OVER () AS docs FROM t),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
impact AS (SELECT doc_id, word, ln(1 + (docs - df + 0.5) / (df + 0.5)) * times * 2.2 / (times + 1.2 * (0.25 + 0.75 * n / mean)) AS v FROM tf JOIN size USING (doc_id) JOIN df USING (word)),
hit AS (SELECT q.doc_id AS query_id, i.doc_id, round(sum(v), 9) AS score FROM tf AS q JOIN impact AS i USING (word) WHERE q.doc_id % 50 = 0 GROUP BY 1, 2),
place AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hit)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM place WHERE rank <= 10
""",
}
