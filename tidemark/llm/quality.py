"""Quality classifier: Naive Bayes support vectors (operator 1).

A text becomes a set of n-gram indicators, hashed into ``BUCKETS``: its words,
its pairs of neighbouring words, and the n-grams of its shape (runs of letters,
digits, spaces and each punctuation mark).  Indicators are scaled by the log
ratio of their class counts, which Spark gathers over every training row, and
brought to length 1.  A linear hinge-loss model is then fitted by dual
coordinate descent on a bounded sample of distinct rows, ``SAMPLE_ROWS`` of at
most ``SAMPLE_INDICATORS`` together, half of both for each class (in the order
of a hash; a row that would not fit is passed over and the next one tried), and
a logistic curve on rows kept apart, up to ``CALIBRATION_ROWS``, again by class
and weighted by what they stand for, turns its margin into a probability.

Defined results: null and empty texts have no indicators, so their margin is
the bias; repeated rows repeat; a null id is not held out and has no label;
without labels of both classes the score is the smoothed share of label 1;
where the rows kept apart lack a class, all training rows fit the curve.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.base import byte_slices, crc_of_id, logistic, read, smallable, written
from tidemark.llm.wordhash import Words, chained, flat, mix

#: Hash buckets of indicators, runs in an n-gram of the shape, and bounds of what is fitted in one place.
BUCKETS, SHAPE_RUNS, SAMPLE_ROWS, SAMPLE_INDICATORS, CALIBRATION_ROWS = 1 << 18, 5, 8_000, 16_000_000, 20_000
#: Added to class counts; cost of a margin error; passes of the descent.
SMOOTHING, COST, PASSES = 1.0, 1.0, 12

_SHAPE = np.arange(256, dtype=np.uint64)
_SHAPE[[9, 11, 12, 13]] = 32
_SHAPE[48:58] = 48
_SHAPE[65:91] = 65
_SHAPE[97:123] = 97
_SHAPE[128:] = 97


def indicators(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct indicators of each text, in order of row."""
    words = Words(texts, "alnum")
    keys, rows = [words.hashes], [words.rows]
    if len(words.rows) > 1:
        same = words.rows[1:] == words.rows[:-1]
        keys.append(chained(words.hashes, 2)[same] + np.uint64(1))
        rows.append(words.rows[1:][same])
    data, offsets = flat(texts)
    if len(data):
        shape = _SHAPE[data]
        begins = np.r_[True, shape[1:] != shape[:-1]]
        edges = offsets[:-1]
        begins[edges[edges < len(data)]] = True
        at = np.flatnonzero(begins)
        row = np.searchsorted(offsets, at, side="right") - 1
        runs = mix(shape[at] + np.uint64(77))
        n = min(SHAPE_RUNS, len(runs))
        grams = chained(runs, n)
        same = row[n - 1 :] == row[: len(row) - n + 1]
        keys.append(grams[same] + np.uint64(2))
        rows.append(row[n - 1 :][same])
    found = np.unique((np.concatenate(rows).astype(np.uint64) << np.uint64(18)) | (mix(np.concatenate(keys)) & np.uint64(BUCKETS - 1)))
    return (found >> np.uint64(18)).astype(np.int64), (found & np.uint64(BUCKETS - 1)).astype(np.int64)


@dataclass
class Model:
    """Log-count ratios, weights of the scaled indicators, bias, and the curve from margin to probability."""

    ratios: np.ndarray
    weights: np.ndarray
    bias: float = 0.0
    curve: tuple[float, float] = (1.0, 0.0)

    def margins(self, texts: pa.Array) -> np.ndarray:
        out, scaled, squares = np.full(len(texts), self.bias), self.weights * self.ratios, self.ratios**2
        for a, b in byte_slices(texts):
            rows, buckets = indicators(texts.slice(a, b - a))
            norm = np.sqrt(np.bincount(rows, squares[buckets], b - a))
            out[a:b] += np.bincount(rows, scaled[buckets], b - a) / np.maximum(norm, 1e-9)
        return out


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, good) to (bucket, bad, good): in how many texts of each class the indicator occurs."""
    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        texts, good = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(int)
        for a, b in byte_slices(texts):
            rows, buckets = indicators(texts.slice(a, b - a))
            for c in range(2):
                counts[c] += np.bincount(buckets[good[a:b][rows] == c], minlength=BUCKETS)
    seen = np.flatnonzero(counts.sum(0))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (seen, counts[0, seen], counts[1, seen])], ["bucket", "bad", "good"])


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0)
        for a, b in byte_slices(texts):
            rows, buckets = indicators(texts.slice(a, b - a))
            ends = np.searchsorted(rows, np.arange(b - a + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(buckets.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([lists, *(batch.column(c).slice(a, b - a) for c in ("good", "turn"))], ["buckets", "good", "turn"])


def _sample(rows: DataFrame) -> pa.Table:
    """buckets and good of the distinct rows(text, good, turn) that the descent sees: of each class up to half of the bounds, so a rare class is not missed."""
    some = written(_some(rows, 0).unionByName(_some(rows, 1)))
    taken = []
    for c in (0, 1):
        left = SAMPLE_INDICATORS // 2
        sizes = some.filter(F.col("good") == c).select("turn", F.size("buckets")).orderBy("turn").toArrow()
        for turn, n in zip(*(x.to_pylist() for x in sizes.columns), strict=True):
            if n <= left:
                left -= n
                taken.append((turn, c))
    chosen = rows.sparkSession.createDataFrame(taken, "turn long, good int")
    return some.join(F.broadcast(chosen), ["turn", "good"], "left_semi").orderBy("turn", "good").select("buckets", "good").toArrow()


def _some(rows: DataFrame, good: int) -> DataFrame:
    """Indicators of the first distinct rows of a class."""
    own = rows.filter(F.col("good") == good)
    turns = own.select("turn").distinct().orderBy("turn").limit(SAMPLE_ROWS // 2).toArrow().column(0)
    last = turns[-1].as_py() if len(turns) else -(1 << 63)
    found = own.filter(F.col("turn") <= last).select("text", "good", "turn").mapInArrow(_rows_of, "buckets array<int>, good int, turn long")
    return found.dropDuplicates(["turn"])


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, width: int, seed: int = 7) -> np.ndarray:
    """Weights of the L1-loss linear model of rows of unit length; the last is the bias, whose input is 1."""
    w, alpha, rng = np.zeros(width + 1), np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(PASSES):
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + w[width]) - 1
            new = min(max(alpha[i] - gradient / (values[i] @ values[i] + 1), 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                w[width] += step
                alpha[i] = new
    return w


def fit(docs: DataFrame, labels: DataFrame, train: Column, calibrate: Column) -> Model:
    """The model from rows of docs(doc_id, text) whose labels.quality is 0 or 1.

    Rows where ``train`` holds are used; of those, rows where ``calibrate``
    holds fit only the curve.  Both are conditions on ``crc``, the id's crc32.
    """
    marks = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("good"))
    marks = marks.withColumn("crc", crc_of_id("doc_id")).filter(train)
    rows = docs.select("doc_id", "text").join(smallable(marks), "doc_id").select("text", "good", "crc", F.xxhash64("doc_id", "text").alias("turn"))
    fitted = rows.filter(~calibrate)
    found = fitted.select("text", "good").mapInArrow(_class_counts, "bucket long, bad long, good long").groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow().to_pandas()
    counts = np.full((2, BUCKETS), SMOOTHING)
    for c, name in enumerate(("bad", "good")):
        counts[c, found["bucket"].to_numpy(int)] += found[name].to_numpy(float)
    ratios = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    model = Model(ratios, np.zeros(BUCKETS))
    sample = _sample(fitted)
    buckets = [np.asarray(x) for chunk in sample.column(0).chunks for x in np.split(chunk.flatten().to_numpy(), np.cumsum(chunk.value_lengths().to_numpy(zero_copy_only=False))[:-1])]
    good = sample.column(1).to_numpy()
    if not len(good) or good.min() == good.max():
        share = marks.agg(F.sum("good"), F.count("*")).first()
        p = ((share[0] or 0) + 0.5) / (share[1] + 1)
        model.curve = (0.0, float(np.log(p / (1 - p))))
        return model
    values = [ratios[b] / max(np.linalg.norm(ratios[b]), 1e-9) for b in buckets]
    balance = np.where(good == 1, len(good) / (2 * good.sum()), len(good) / (2 * (len(good) - good.sum())))
    w = dual_descent(buckets, values, np.where(good == 1, 1.0, -1.0), COST * balance, BUCKETS)
    model.weights, model.bias = w[:-1], float(w[-1])
    judged = rows.filter(calibrate)
    if judged.select("good").distinct().count() < 2:
        judged = rows
    curve = written(margins(judged.select(F.col("good").cast("long").alias("doc_id"), "text", "turn"), model, "turn"))
    sizes = {r["doc_id"]: r["n"] for r in curve.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    parts = [curve.filter(F.col("doc_id") == c).orderBy("turn").limit(CALIBRATION_ROWS // 2).toArrow().to_pandas() for c in (0, 1)]
    x, y = (np.concatenate([p[c].to_numpy(float) for p in parts]) for c in ("margin", "doc_id"))
    weight = np.concatenate([np.full(len(p), sizes[c] / len(p)) for c, p in enumerate(parts)])  # the rows taken of a class stand for all of it
    model.curve = tuple(float(k) for k in logistic(x[:, None], y, weight=weight / weight.mean()))
    return model


def margins(docs: DataFrame, model: Model, *carried: str) -> DataFrame:
    """docs(doc_id, text, ...) to doc_id, carried columns of type long, and the margin."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("doc_id", *carried)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(held.value.margins(batch.column("text")))], ["doc_id", *carried, "margin"])

    return docs.select("doc_id", "text", *carried).mapInArrow(score, ", ".join(f"{c} long" for c in ("doc_id", *carried)) + ", margin double")


def quality(docs: DataFrame, labels: DataFrame, of: int = 4, held_out: int = 2, least: float = 0.7) -> DataFrame:
    """Score docs(doc_id, text): doc_id, held_out, score, predicted and the margin."""
    crc = F.col("crc")
    model = fit(docs, labels, crc % of != held_out, crc % (4 * of) == (held_out + 1) % of)
    z = F.col("margin") * model.curve[0] + model.curve[1]
    return (
        margins(docs.withColumn("doc_id", F.col("doc_id").cast("long")), model)
        .withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(35.0)), F.lit(-35.0)))))
        .select("doc_id", (F.coalesce(crc_of_id("doc_id"), F.lit(held_out + 1)) % of == held_out).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"), "margin")
    )


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {"op1_quality": op1_quality}
ORACLES: dict[str, str] = {}
