"""Line dedup over range-partitioned line hashes (operator 7).

Every line gets the hash of its key (the line without ASCII white space at
both ends, A-Z lower-cased).  The hashes are range-partitioned with document
and position as further sort keys, so a hot line is spread over partitions, and
each partition is read once as a stream of runs of equal hashes.  Lines whose
key stands in at least ``min_docs`` documents are dropped, all of them or, with
``keep_first``, all but the first occurrence.  A run that touches a partition's
edge and is not decided there is settled from the runs' counts, of which there
are two a partition at most.

The result is a bitmap of kept lines for each document, packed and compressed,
instead of texts; ``apply`` joins it back to texts.

Defined results: a null or empty text is one empty line; keys shorter than
``min_chars`` code points are never dropped; rows with the same id and text are
one document and get the same bitmap; null ids count as ids equal to each
other; 64-bit hashes stand for keys.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.base import SLICE, byte_slices, read
from tidemark.llm.base import written_by_bytes as written
from tidemark.llm.wordhash import Spans, flat

_KEYS = ("doc_id", "text_hash")


def line_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, code points, row, position) of each line's key, and each text's number of lines."""
    data, offsets = flat(texts)
    breaks = np.flatnonzero(data == 10)
    row_of_break = np.searchsorted(offsets, breaks, side="right") - 1
    starts = np.sort(np.r_[offsets[:-1], breaks + 1], kind="stable")
    ends = np.sort(np.r_[offsets[1:], breaks], kind="stable")
    lines = np.bincount(row_of_break, minlength=len(texts)) + 1
    rows = np.repeat(np.arange(len(texts)), lines)
    position = np.arange(len(rows)) - np.repeat(np.cumsum(lines) - lines, lines)
    solid = np.flatnonzero(~np.isin(data, (9, 10, 11, 12, 13, 32)))
    if not len(solid):
        return np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.int64), rows, position, lines
    first = np.searchsorted(solid, starts)
    last = np.searchsorted(solid, ends) - 1
    filled = last >= first
    begin = np.where(filled, solid[np.minimum(first, len(solid) - 1)], starts)
    end = np.where(filled, solid[np.maximum(last, 0)] + 1, begin)
    points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    return Spans(data).hashes(begin, end), points[end] - points[begin], rows, position, lines


def _lines(min_chars: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b in byte_slices(texts, SLICE):
                hashes, points, rows, position, _ = line_spans(texts.slice(a, b - a))
                ok = np.flatnonzero(points >= min_chars)
                at = pa.array(a + rows[ok])
                yield pa.RecordBatch.from_arrays([pa.array(hashes[ok].view(np.int64)), *(batch.column(k).take(at) for k in _KEYS), pa.array(position[ok].astype(np.int32))], ["line", *_KEYS, "position"])

    return emit


#: Rows of a stream: a line to drop, a line whose run may go on in another partition, and such a run's counts.
DROP, OPEN, EDGE = 0, 1, 2
#: Stands for a null id within the stream.
NO_ID = -(1 << 63)
_STREAM = "kind int, line long, doc_id long, text_hash long, position int, part int, docs long, last_id long, last_hash long"


def _stream(min_docs: int, keep_first: bool):
    """Reads one partition's sorted lines; memory holds a batch and one undecided run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        none = [np.zeros(0, np.int64)] * 4
        held = none  # the lines of the last run that are not yet decided, its first one in front
        state = None  # of that run: line, documents so far, first and last document, whether they are enough
        opening = True  # the run is the partition's first
        before_all = np.full((4, 1), -1, np.int64)  # the last line seen; equal ones are of repeated rows

        def rows(kind, lines, docs=0, last=(0, 0)):
            n = len(lines[0])
            full = lambda x: pa.array(np.full(n, x, np.int64))
            counts = pa.array((np.arange(n) == 0).astype(np.int64)) if kind == OPEN else full(docs)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *(pa.array(x) for x in lines[:3]), pa.array(lines[3].astype(np.int32)), pa.array(np.full(n, part, np.int32)), counts, full(last[0]), full(last[1])], ["kind", "line", *_KEYS, "position", "part", "docs", "last_id", "last_hash"])

        def settle(held, state, at_edge):
            """What becomes of a finished run's undecided lines."""
            if at_edge:
                yield rows(EDGE, [np.array([x], np.int64) for x in (state["line"], *state["first"], 0)], state["docs"], state["last"])
                if len(held[0]):
                    yield rows(OPEN, held)

        for batch in batches:
            cols = [batch.column(c).cast(pa.int64()).fill_null(NO_ID).to_numpy() for c in ("line", *_KEYS, "position")]
            again = np.logical_and.reduce([np.r_[last, c[:-1]] == c for last, c in zip(before_all, cols, strict=True)]) if len(cols[0]) else np.zeros(0, bool)
            cols = [c[~again] for c in cols]
            line, doc, text, _ = cols
            if not len(line):
                continue
            before_all = np.array([[c[-1]] for c in cols])
            goes_on = state is not None and line[0] == state["line"]
            if state is not None and not goes_on:
                yield from settle(held, state, opening)
                opening, held = False, none
            begins = np.r_[0, np.flatnonzero(line[1:] != line[:-1]) + 1]
            ends = np.r_[begins[1:], len(line)]
            fresh = np.r_[True, (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (line[1:] != line[:-1])]
            if goes_on and (doc[0], text[0]) == state["last"]:
                fresh[0] = False
            docs = np.add.reduceat(fresh.astype(np.int64), begins)
            for k in sorted({0, len(begins) - 1}):  # the runs at the batch's ends, one by one
                a, b = begins[k], ends[k]
                before = state if k == 0 and goes_on else None
                now = {"line": int(line[a]), "docs": int(docs[k]) + (before["docs"] if before else 0), "first": before["first"] if before else (int(doc[a]), int(text[a])), "last": (int(doc[b - 1]), int(text[b - 1]))}
                new = [c[a:b] for c in cols]
                mine = [np.r_[h, c] for h, c in zip(held, new, strict=True)] if before else new
                if now["docs"] >= min_docs and keep_first:
                    yield rows(DROP, [c[1:] for c in mine])
                    mine = [c[:1] for c in mine]
                elif now["docs"] >= min_docs:
                    yield rows(DROP, mine)
                    mine = none
                if k < len(begins) - 1:
                    yield from settle(mine, now, opening)
                    opening = False
                else:
                    held, state = mine, now
            inner = np.zeros(len(line), bool)
            if len(begins) > 2:
                inner[ends[0] : begins[-1]] = np.repeat(docs[1:-1] >= min_docs, (ends - begins)[1:-1])
                inner[begins[1:-1]] &= not keep_first
            if inner.any():
                yield rows(DROP, [c[inner] for c in cols])
        if state is not None:
            yield from settle(held, state, True)

    return run


def dropped_lines(docs: DataFrame, min_docs: int = 1, keep_first: bool = True, min_chars: int = 1) -> DataFrame:
    """(doc_id, text_hash, position) of every line to drop from docs(doc_id, text)."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    lines = written(keyed.mapInArrow(_lines(min_chars), "line long, doc_id long, text_hash long, position int"))
    order = ("line", "doc_id", "text_hash", "position")
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    found = written(ranged.mapInArrow(_stream(min_docs, keep_first), _STREAM))
    by_part = Window.partitionBy("line").orderBy("part")
    same = (F.lag("last_id").over(by_part) == F.col("doc_id")) & (F.lag("last_hash").over(by_part) == F.col("text_hash"))
    edges = found.filter(F.col("kind") == EDGE).withColumn("again", F.coalesce(same, F.lit(False)).cast("int"))
    totals = edges.groupBy("line").agg((F.sum("docs") - F.sum("again")).alias("in_docs"), F.min("part").alias("first_part"))
    opened = found.filter(F.col("kind") == OPEN).join(F.broadcast(totals), "line")  # two edges a partition at most
    stays = F.lit(keep_first) & (F.col("docs") == 1) & (F.col("part") == F.col("first_part"))
    late = opened.filter((F.col("in_docs") >= min_docs) & ~stays)
    gone = found.filter(F.col("kind") == DROP).select(*_KEYS, "position").unionByName(late.select(*_KEYS, "position"))
    return gone.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for n, gone in zip(batch.column("n_lines").to_pylist(), batch.column("gone"), strict=True):
            keep = np.ones(n, bool)
            if gone.is_valid:
                keep[gone.values.to_numpy(zero_copy_only=False)] = False
            out.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*_KEYS, "n_lines", "n_dropped")), pa.array(out, pa.binary())], [*_KEYS, "n_lines", "n_dropped", "keep"])


def _same_document(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])


def line_bitmaps(docs: DataFrame, min_docs: int = 1, keep_first: bool = True, min_chars: int = 1) -> DataFrame:
    """Per distinct (doc_id, text): doc_id, text_hash, n_lines, n_dropped and ``keep``, the compressed bitmap."""
    gone = dropped_lines(docs, min_docs, keep_first, min_chars).groupBy(*_KEYS).agg(F.collect_list("position").alias("gone"))
    text = F.coalesce("text", F.lit(""))
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))
    lines = lines.groupBy(*_KEYS).agg(F.max("n_lines").alias("n_lines"))
    joined = lines.join(gone, _same_document(lines, gone), "left").select(lines["doc_id"], lines["text_hash"], "n_lines", "gone")
    joined = joined.withColumn("n_dropped", F.coalesce(F.size("gone"), F.lit(0)).cast("long")).withColumn("n_dropped", F.greatest("n_dropped", F.lit(0)))
    return joined.mapInArrow(_bitmaps, "doc_id long, text_hash long, n_lines long, n_dropped long, keep binary")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the kept lines of ``text`` again, by the bitmap in ``keep``."""
    for batch in (whole.slice(a, b - a) for whole in batches for a, b in byte_slices(whole.column("text"), SLICE)):
        out = []
        for text, n, less, keep in zip(*(batch.column(c).to_pylist() for c in ("text", "n_lines", "n_dropped", "keep")), strict=True):
            if less:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n)
                text = "\n".join(line for line, bit in zip((text or "").split("\n"), bits.tolist(), strict=True) if bit)
            out.append(text)
        names = [c for c in batch.schema.names if c not in ("text", "keep")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.string())], [*names, "text"])


def apply(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with ``text`` cut down to the kept lines, and with n_lines and n_dropped, which replace columns of that name."""
    mine = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    keyed = docs.select(F.struct(*mine).alias("rest"), "text", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    joined = keyed.join(bitmaps, _same_document(keyed, bitmaps)).select("rest", "text", "n_lines", "n_dropped", "keep")
    cut = joined.mapInArrow(_kept, f"rest {keyed.schema['rest'].dataType.simpleString()}, n_lines long, n_dropped long, text string")
    return cut.select(*(F.col("rest")[c].alias(c) for c in mine), "text", "n_lines", "n_dropped")


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    bitmaps = line_bitmaps(docs, min_docs=10, keep_first=False)
    return apply(docs, bitmaps).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


_STRIP = r"regexp_replace(x.line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
ORACLES = {
    "op7_lines": rf"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), flat AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS position FROM split
), keyed AS (
  SELECT doc_id, position, line,
         translate({_STRIP}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM flat AS x
), often AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT k.*, o.key IS NOT NULL AS gone FROM keyed AS k LEFT JOIN often AS o ON k.key = o.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY position) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
}
QUERIES = {"op7_lines": op7_lines}
