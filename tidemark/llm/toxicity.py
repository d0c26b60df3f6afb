"""Toxicity by class-conditional Kneser-Ney models (operator 9).

Two models, one of toxic and one of ordinary labelled texts, spell each word
symbol by symbol to its end: ``^``, its characters (A-Z as a-z), ``$``.  The
context of a symbol is the ``ORDER`` symbols before it, or all of them nearer
the word's beginning.  There the classes have their own counts ``C_c`` and
discounts (one each for counts of 1, 2 and 3 or more, from the class's counts
of counts).  What is discounted goes to lower orders of at most ``LOWER``
symbols, which both classes share.  Their counts are Kneser-Ney's: the number
of distinct contexts in which a continuation stands, that is of distinct
highest-order rows for the longest and of distinct symbols before it for the
others::

    P_c(s | context) = (C_c - D_c) / C_c(context) + left_c(context) * P(s | last symbols)
    P(s | h) = (N(hs) - D) / N(h) + D * types(h) / N(h) * P(s | h without its first symbol)

So an expression that is rare or has never been seen is judged where its
contexts are known, and elsewhere by counts that favour no class.  A word's
value is its toxic less its ordinary log-likelihood, that of a word of more than
``ORDER`` symbols normalised to so many: without that a long word that was seen
once outweighs any insult.  A text's features are the mean over its words, the highest value of a word, as one insult makes a long
text toxic, and the log of its length.  A logistic curve of these, fitted on labelled rows that gave no
counts, up to ``CALIBRATION_ROWS`` of each class, and weighted so that classes
count more evenly, gives the score.  Words are judged without their neighbours:
expressions of several words that are harmless one by one are not found.

All counts over all training rows are kept, those of once-seen rows too, as a
table.  Each distinct word of the corpus is valued once: a symbol's part is
``left`` of its context, if that was seen, plus ``gain`` of context and symbol,
if both were seen together, so the table is sent out over the words in parts of
``PART`` rows, one after another, and the parts add up.  Scoring reads the texts
once: the values of the most frequent words, at most ``WORDS`` of them, are
broadcast, and what else stands in a text meets its values by a join.

Defined results: null or empty texts score as a text without words; rows are
scored one by one, so repeated rows repeat; a null id belongs to training, as
its crc32 is not 0 mod 5, but has no label; without labels of both classes the
score is the smoothed share of toxic labels (0.5 without any); where the rows
that fit the curve lack a class, all training rows fit it; words and contexts
are looked up by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.base import SLICE, byte_slices, crc_of_id, logistic, read, smallable
from tidemark.llm.base import written_and_tidied as written
from tidemark.llm.runs import Runs
from tidemark.llm.wordhash import Spans, Words, flat, folded, spelled

#: Symbols of a context and of the longest shared order.
ORDER, LOWER = 10, 5
#: Rows of the model and words that are broadcast at once (16 and 12 bytes each), and most rows of a class that fit the curve.
PART, WORDS, CALIBRATION_ROWS = 3_000_000, 4_000_000, 10_000
#: Most grams of the shared orders that are broadcast.
TAILS = 500_000
#: Rows at which a task merges its counts, and that a merge may leave.
MERGE, SEND = 400_000, 250_000
#: One of so many training rows fits the curve; how far the classes are weighted to count evenly (1: fully).
FOLDS, EVEN = 10, 0.5

_GRAMS = "gram string, ordinary long, toxic long"


class Spelt:
    """Some words as ``^word$``, symbol by symbol, and hashes of their contexts; ``first`` and ``symbols``: the place of a word's ``^`` and how many symbols follow it."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        size = ends - starts
        begin = np.cumsum(size + 2) - size - 2
        self.data = np.full(int(size.sum()) + 2 * len(starts), ord("$"), np.uint8)
        self.data[begin] = ord("^")
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        self.data[np.repeat(begin + 1, size) + inside] = folded(data[np.repeat(starts, size) + inside])
        self.ends = np.flatnonzero(np.r_[(self.data[1:] & 0xC0) != 0x80, True][: len(self.data)]) + 1
        self.first = np.searchsorted(self.ends, begin, side="right")
        self.symbols = np.diff(np.r_[self.first, len(self.ends)]) - 1
        self._hash = Spans(self.data, fold=False).hashes
        # every symbol after a ^: its word, its number there, and the bytes of its context and of both
        self.word = np.repeat(np.arange(len(self.first)), self.symbols)
        self.number = np.arange(len(self.word)) - np.repeat(np.cumsum(self.symbols) - self.symbols, self.symbols) + 1
        at = self.first[self.word] + self.number
        self.starts = np.r_[0, self.ends][at - np.minimum(self.number, ORDER)]
        self.contexts, self.stops = self.ends[at - 1], self.ends[at]

    def grams(self) -> np.ndarray:
        """Hashes of each symbol with its context."""
        return self._hash(self.starts, self.stops).view(np.int64)

    def before(self, symbols: np.ndarray) -> np.ndarray:
        """Hashes of some symbols' contexts."""
        return self._hash(self.starts[symbols], self.contexts[symbols]).view(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to how often each symbol was seen in its context, added up by the task."""
    runs = Runs(1, MERGE, SEND)

    def rows(merged):
        (_, *seen), grams = merged
        return pa.RecordBatch.from_arrays([grams, *map(pa.array, seen)], ["gram", "ordinary", "toxic"])

    for batch in batches:
        texts, toxic = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for a, b in byte_slices(texts, SLICE):
            words = Words(texts.slice(a, b - a), "alnum")
            if not len(words.hashes):
                continue
            _, at, back = np.unique(words.hashes, return_index=True, return_inverse=True)
            spelt, bad = Spelt(words.data, words.starts[at], words.ends[at]), toxic[a + words.rows]
            grams, one, at = np.unique(spelt.grams(), return_index=True, return_inverse=True)
            seen = [np.bincount(at, np.bincount(back[m], minlength=len(spelt.first))[spelt.word], len(grams)).astype(np.int64) for m in (~bad, bad)]
            for merged in runs.add([grams, *seen], spelled(spelt.data, spelt.starts[one], spelt.stops[one])):
                yield rows(merged)
    for merged in runs.rest():
        yield rows(merged)


def count(rows: DataFrame) -> DataFrame:
    """rows(text, toxic) to the table of grams (a symbol behind its context): gram, ordinary, toxic."""
    found = rows.select("text", "toxic").mapInArrow(_counts, _GRAMS)
    return written(found.groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")))


def _discount(once: int, twice: int) -> float:
    return once / (once + 2 * twice) if once else 0.5


def _tail() -> Column:
    """The last LOWER symbols of a gram, without ``^``: its gram of the shared orders."""
    return F.expr(f"right(gram, least(length(gram) - 1, {LOWER}))")  # a gram of ORDER symbols or fewer begins with ^


def _shared(counts: DataFrame) -> DataFrame:
    """(gram, likely): the shared lower orders' probability of a gram's last symbol given those before it."""
    levels, grams = [], None
    tails = counts.select(_tail().alias("gram"))
    for n in range(LOWER, 0, -1):
        own = tails.filter(F.length("gram") == n)
        shorter = own if grams is None else own.unionByName(grams.select(F.expr("substring(gram, 2)").alias("gram")))
        grams = written(shorter.groupBy("gram").agg(F.count("*").alias("contexts")))
        levels.append(grams)
    below = None
    for n, grams in enumerate(reversed(levels), 1):
        rows, once, twice = grams.agg(F.count("*"), F.count_if(F.col("contexts") == 1), F.count_if(F.col("contexts") == 2)).first()
        cut = F.lit(_discount(once, twice))
        before = F.expr("substring(gram, 1, length(gram) - 1)")
        every = grams.withColumn("before", before)
        totals = every.groupBy("before").agg(F.sum("contexts").alias("total"), F.count("*").alias("types"))
        placed = every.join(totals, "before")
        if below is None:
            placed = placed.withColumn("lower", F.lit(1.0 / (rows + 1)))
        else:
            placed = placed.withColumn("rest", F.expr("substring(gram, 2)")).join(below.select(F.col("gram").alias("rest"), F.col("likely").alias("lower")), "rest")
        level = placed.select("gram", ((F.col("contexts") - cut) / F.col("total") + cut * F.col("types") / F.col("total") * F.col("lower")).alias("likely"))
        below = level if below is None else written(level)
        levels[LOWER - n] = below
    found = levels[0]
    for other in levels[1:]:
        found = found.unionByName(other)
    return found


def steps(counts: DataFrame) -> DataFrame:
    """(gram, gain, left) of count(): what a symbol behind its context has more than one not seen there, and the log-likelihood difference of one not seen behind ``gram``; a gram that is a context too has a row for each, which add up."""
    classes = ("ordinary", "toxic")
    times = counts.agg(*(F.count_if(F.col(c) == k) for c in classes for k in (1, 2, 3, 4))).first()
    cuts = {}
    for i, c in enumerate(classes):
        n = [max(x, 1) for x in times[4 * i : 4 * i + 4]]
        y = _discount(n[0], n[1])
        cuts[c] = [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1 * k), 0.9 * k) for k in (1, 2, 3)]
    cut = {c: F.when(F.col(c) == 0, 0.0).when(F.col(c) == 1, cuts[c][0]).when(F.col(c) == 2, cuts[c][1]).otherwise(cuts[c][2]) for c in classes}
    context = Window.partitionBy("parent")
    placed = counts.withColumn("parent", F.expr("left(gram, length(gram) - 1)"))
    placed = placed.withColumns({**{f"all_{c}": F.sum(c).over(context) for c in classes}, **{f"cut_{c}": F.sum(cut[c]).over(context) for c in classes}, "lead": F.min("gram").over(context) == F.col("gram")})
    placed = placed.withColumns({f"free_{c}": F.when(F.col(f"all_{c}") > 0, F.col(f"cut_{c}") / F.col(f"all_{c}")).otherwise(1.0) for c in classes})

    def likely(c: str) -> Column:
        return F.log((F.col(c) - cut[c]) / F.greatest(F.col(f"all_{c}"), F.lit(1)) + F.col(f"free_{c}") * F.col("likely"))

    shared = _shared(counts).select(F.col("gram").alias("tail"), "likely")
    unseen = F.log(F.col("free_toxic") / F.col("free_ordinary"))
    each = placed.withColumn("tail", _tail()).join(smallable(shared, TAILS), "tail").select("gram", "parent", "lead", (likely("toxic") - likely("ordinary") - unseen).alias("gain"), unseen.alias("left"))
    of_gram, of_context = F.struct("gram", "gain", F.lit(0.0).alias("left")), F.struct(F.col("parent").alias("gram"), F.lit(0.0).alias("gain"), "left")
    return each.select(F.inline(F.when(F.col("lead"), F.array(of_gram, of_context)).otherwise(F.array(of_gram))))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams by their hash instead of their symbols."""
    for batch in batches:
        data, offsets = flat(batch.column("gram"))
        node = Spans(data, fold=False).hashes(offsets[:-1], offsets[1:]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(node), *(batch.column(c) for c in ("gain", "left"))], ["node", "gain", "left"])


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of a task's texts and how often they occur."""
    runs = Runs(1, MERGE, SEND)

    def rows(merged):
        (_, times), names = merged
        return pa.RecordBatch.from_arrays([names, pa.array(times)], ["spelling", "times"])

    for batch in batches:
        texts = batch.column(0)
        for a, b in byte_slices(texts, SLICE):
            words = Words(texts.slice(a, b - a), "alnum")
            if not len(words.hashes):
                continue
            key, at, times = np.unique(words.hashes.view(np.int64), return_index=True, return_counts=True)
            for merged in runs.add([key, times], spelled(folded(words.data), words.starts[at], words.ends[at])):
                yield rows(merged)
    for merged in runs.rest():
        yield rows(merged)


class Part:
    """Some rows of the model in order of their hash, those of one hash added up, and what they add to words."""

    def __init__(self, rows: pa.Table):
        node = rows.column("node").to_numpy()
        order = np.argsort(node)
        first = np.flatnonzero(np.r_[True, node[order][1:] != node[order][:-1]]) if len(node) else np.zeros(0, np.int64)
        self.nodes = node[order][first]
        self.gain, self.left = (np.add.reduceat(rows.column(c).to_numpy()[order], first) if len(node) else np.zeros(0, np.float32) for c in ("gain", "left"))

    def _at(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.nodes):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.nodes, keys), len(self.nodes) - 1)
        return at, self.nodes[at] == keys

    def values(self, spelt: Spelt) -> np.ndarray:
        """What each word's symbols have here: gains of grams and what is left of contexts."""
        grams = spelt.grams()
        at, known = self._at(grams)
        own = np.where(known, self.gain[at], 0.0) if len(self.nodes) else np.zeros(len(grams))
        behind = np.flatnonzero(spelt.number[1:] > 1)  # the gram before is the context, unless that is longer
        behind = behind[spelt.number[behind + 1] <= ORDER]
        own[behind + 1] += np.where(known[behind], self.left[at[behind]], 0.0) if len(self.nodes) else 0.0
        others = np.flatnonzero((spelt.number == 1) | (spelt.number > ORDER))
        place, found = self._at(spelt.before(others))
        own[others] += np.where(found, self.left[place], 0.0) if len(self.nodes) else 0.0
        return np.bincount(spelt.word, own, len(spelt.first))


def word_values(docs: DataFrame, table: DataFrame) -> DataFrame:
    """(word, times, value) of every distinct word of docs(text) by steps(): the table goes out in parts over the words, not over the texts."""
    spark = docs.sparkSession
    keyed = written(table.select("gram", *(F.col(c).cast("float") for c in ("gain", "left"))).mapInArrow(_keyed, "node long, gain float, left float"))
    words = docs.select("text").mapInArrow(_distinct, "spelling string, times long")
    words = written(words.groupBy("spelling").agg(F.sum("times").alias("times")))
    parts = max(1, -(-keyed.count() // PART))
    found = None
    for part in range(parts):
        held = spark.sparkContext.broadcast(Part(keyed.filter(F.pmod("node", F.lit(parts)) == part).toArrow()))

        def value(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = flat(batch.column("spelling"))
                if len(offsets) > 1:
                    word = Spans(data).hashes(offsets[:-1], offsets[1:]).view(np.int64)
                    spelt = Spelt(data, offsets[:-1], offsets[1:])
                    yield pa.RecordBatch.from_arrays([pa.array(word), batch.column("times"), pa.array(spelt.symbols.astype(np.int64)), pa.array(held.value.values(spelt))], ["word", "times", "symbols", "value"])

        one = written(words.mapInArrow(value, "word long, times long, symbols long, value double"))
        held.destroy()
        found = one if found is None else found.unionByName(one)
    found = found if parts == 1 else written(found.groupBy("word", "times", "symbols").agg(F.sum("value").alias("value")))
    return found.select("word", "times", (F.col("value") * F.least(F.lit(1.0), ORDER / F.col("symbols"))).alias("value"))


class Frequent:
    """Words in order of their hash and their values; what a text has of them, and the words that are not among them."""

    def __init__(self, rows: pa.Table):
        word = rows.column("word").to_numpy()
        order = np.argsort(word)
        self.words, self.value = word[order], rows.column("value").to_numpy().astype(np.float32)[order]

    def features(self, texts: pa.Array) -> list[pa.Array]:
        """Each text's sum and maximum over the words here (-inf without any), its number of words in all, and the others with their times."""
        n = len(texts)
        total, peak, count = np.zeros(n), np.full(n, -np.inf), np.zeros(n, np.int64)
        rare, times, many = [], [], np.zeros(n + 1, np.int64)
        for a, b in byte_slices(texts, SLICE):
            words = Words(texts.slice(a, b - a), "alnum")
            if not len(words.hashes):
                continue
            each, back = np.unique(words.hashes.view(np.int64), return_inverse=True)
            at = np.minimum(np.searchsorted(self.words, each), max(len(self.words) - 1, 0))
            known = self.words[at] == each if len(self.words) else np.zeros(len(each), bool)
            value = np.where(known, self.value[at], 0.0) if len(self.words) else np.zeros(len(each))
            total[a:b] = np.bincount(words.rows, value[back], b - a)
            count[a:b] = np.bincount(words.rows, minlength=b - a)
            first = np.flatnonzero(np.r_[True, words.rows[1:] != words.rows[:-1]])
            peak[a + words.rows[first]] = np.maximum.reduceat(np.where(known, value, -np.inf)[back], first)
            other = np.flatnonzero(~known[back])
            if len(other):
                key, often = np.unique(words.rows[other].astype(np.int64) * len(each) + back[other], return_counts=True)
                rare.append(each[key % len(each)])
                times.append(often)
                many[1 + a + np.arange(b - a)] = np.bincount(key // len(each), minlength=b - a)
        lists = [pa.ListArray.from_arrays(pa.array(np.cumsum(many).astype(np.int32)), pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))) for x in (rare, times)]
        return [pa.array(total), pa.array(peak), pa.array(count), *lists]


def frequent(values: DataFrame) -> tuple[Broadcast, int, bool]:
    """The most frequent words of word_values() as a broadcast Frequent, the power of two of times from which on they are there, and whether there are others."""
    often = F.floor(F.log2("times")).cast("int")
    sizes = sorted(((r["often"], r["n"]) for r in values.groupBy(often.alias("often")).agg(F.count("*").alias("n")).collect()), reverse=True)  # a row for each power of two
    held, least = 0, sizes[0][0] + 1 if sizes else 0
    for power, n in sizes:
        if held + n > WORDS:
            break
        held, least = held + n, power
    known = Frequent(values.filter(F.col("times") >= float(2**least)).select("word", F.col("value").cast("float")).toArrow())
    return values.sparkSession.sparkContext.broadcast(known), least, held < sum(n for _, n in sizes)


def features(docs: DataFrame, values: DataFrame, carried: str | None = None, words: tuple[Broadcast, int, bool] | None = None) -> DataFrame:
    """docs(doc_id, text, ...) to doc_id, the carried column of type long, peak, mean and length, by word_values() and their frequent()."""
    rows = docs.select("doc_id", (F.col(carried) if carried else F.lit(None)).cast("long").alias("carried"), "text")
    known, least, rest = words or frequent(values)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("carried"), *known.value.features(batch.column("text"))], ["doc_id", "carried", "total", "peak", "count", "rare", "often"])

    found = rows.mapInArrow(score, "doc_id long, carried long, total double, peak double, count long, rare array<long>, often array<long>")
    if rest:
        found = written(found.withColumn("row", F.monotonically_increasing_id()))
        others = found.select("row", F.explode(F.arrays_zip(F.col("rare").alias("word"), F.col("often").alias("often"))).alias("x")).select("row", "x.word", "x.often")
        valued = others.join(values.filter(F.col("times") < float(2**least)).select("word", "value").dropDuplicates(["word"]), "word")
        more = valued.groupBy("row").agg(F.sum(F.col("value") * F.col("often")).alias("more"), F.max("value").alias("most"))
        found = found.join(more, "row", "left").withColumn("total", F.col("total") + F.coalesce("more", F.lit(0.0))).withColumn("peak", F.greatest("peak", "most"))
    has = F.col("count") > 0
    mean, peak, length = F.when(has, F.col("total") / F.col("count")).otherwise(0.0), F.when(has, F.col("peak")).otherwise(0.0), F.log1p(F.col("count").cast("double"))
    found = found.select("doc_id", "carried", peak.alias("peak"), mean.alias("mean"), length.alias("length"))
    return found.withColumnRenamed("carried", carried) if carried else found.drop("carried")


def _curve(judged: DataFrame, values: DataFrame, sizes: dict[int, int]) -> np.ndarray:
    """The curve's weights from judged(text, toxic), of which at most CALIBRATION_ROWS of a class are taken and stand for all of it."""
    taken = [judged.filter(F.col("toxic") == c).withColumn("turn", F.xxhash64("crc", "text")).orderBy("turn").limit(CALIBRATION_ROWS) for c in (False, True)]
    both = written(taken[0].unionByName(taken[1]).select(F.col("toxic").cast("long").alias("doc_id"), "text"))
    words = frequent(values)
    curve = features(both, values, words=words).toArrow().to_pandas()
    words[0].destroy()
    y = curve["doc_id"].to_numpy(float)
    n = np.array([(y == c).sum() for c in (0, 1)])
    own = np.array([sizes[c] / n[c] for c in (0, 1)]) * np.array([1.0, (sizes[0] / sizes[1]) ** EVEN])
    weight = own[y.astype(int)]
    return logistic(curve[["peak", "mean", "length"]].to_numpy(float), y, weight=weight / weight.mean())


def fit(docs: DataFrame, labels: DataFrame, train: Column, calibrate: Column) -> tuple[DataFrame | None, np.ndarray]:
    """The values of the words of docs (none without both classes) and the curve's weights, from rows of docs(doc_id, text) whose labels.toxic is 0 or 1.

    Rows where ``train`` holds give counts, but those where ``calibrate`` also
    holds fit the curve.  Both are conditions on ``crc``, the crc32 of the id.
    Where either lacks a class, all rows where ``train`` holds do both.
    """
    marks = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.withColumn("crc", crc_of_id("doc_id")).filter(train)
    rows = docs.select("doc_id", "text").join(smallable(marks), "doc_id").select("text", (F.col("toxic") == 1).alias("toxic"), "crc", calibrate.alias("judged"))
    sizes = {(r["toxic"], r["judged"]): r["n"] for r in rows.groupBy("toxic", "judged").agg(F.count("*").alias("n")).collect()}
    all_of = {c: sum(sizes.get((bool(c), j), 0) for j in (False, True)) for c in (0, 1)}
    plain = np.array([0.0, 0.0, 0.0, np.log((all_of[1] + 0.5) / (all_of[0] + 0.5))])
    if not all_of[0] or not all_of[1]:
        return None, plain
    apart = len(sizes) == 4
    counts = count(rows.filter("not judged") if apart else rows)
    seen = counts.agg(F.sum("ordinary"), F.sum("toxic")).first()
    if not seen[0] or not seen[1]:
        return None, plain
    values = word_values(docs, steps(counts))
    return values, _curve(rows.filter("judged") if apart else rows, values, {c: sizes[bool(c), True] for c in (0, 1)} if apart else all_of)


def toxicity(docs: DataFrame, labels: DataFrame, of: int = 5, held_out: int = 0) -> DataFrame:
    """Score docs(doc_id, text): doc_id, held_out, score, predicted, and the highest and mean difference of its words."""
    crc = F.col("crc")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    values, weights = fit(docs, labels, crc % of != held_out, F.floor(crc / of) % FOLDS == 0)
    found = features(docs, values) if values is not None else docs.select("doc_id", *(F.lit(0.0).alias(c) for c in ("peak", "mean", "length")))
    z = sum((F.col(c) * float(k) for c, k in zip(("peak", "mean", "length"), weights, strict=False)), F.lit(float(weights[3])))
    return (
        found
        .withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(35.0)), F.lit(-35.0)))))
        .select("doc_id", (F.coalesce(crc_of_id("doc_id"), F.lit(1)) % of == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "peak", "mean")
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLES: dict[str, str] = {}
