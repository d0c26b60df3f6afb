"""Quality rules with robust multivariate outliers, in DataFrame operations only (operator 13).

Base rules count over the whole text: words (runs without ASCII white space),
their code points, symbols of ``[#*$%&|<>]``, lines with a word that equal an
earlier line, and words in windows of ``WINDOW`` words found twice or more in
the text.  A text with fewer than ``LEAST_WORDS`` words, or with more than
``MOST_REPEATED`` percent of repeated words, fails.

Every other text has a vector of transformed statistics: the log of its mean
word length, the arc sine roots of its shares of symbols, of A-Z and of sentence
marks, and the log of its distinct words over the log of its words.  For each
lang and source the minimum covariance determinant gives centre and scatter:
from two deterministic starts (medians with median deviations, and the same
centre with the covariance of spatial signs), concentration steps take the
``INNER`` share of the rows that lie nearest, by bins of distance of a
sixteenth of a power of two, until no determinant falls; the start with the
smaller determinant counts.  Scatter is widened to a normal law's and by a
least deviation of each statistic (``FLOOR``), so that a statistic most texts
share rejects none by itself.  As a share over n words scatters more the fewer
words there are, the scatter of a text counts ``1 + SHORT / n`` times.  A text
whose squared distance is above ``CUT`` is rejected.

A step reads the vectors once: rows are summed by group and bin before they are
shuffled, so a hot group is a bounded number of rows, and no group is gathered.
Estimates stay a table of a row for each group and are broadcast only if that
is small.

Defined results: a null text is empty, with no words, and fails; null lang and
source count as ''; groups below ``LEAST_ROWS`` are estimated together by lang,
and what is left below it then by all; fewer than ``FEWEST`` rows give no
estimate and are kept; repeated rows repeat; a null id is kept.  Windows are
compared by 64 bits of their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.base import read, smallable, written

#: Base rules.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Share of rows that a concentration step keeps, most such steps, and least fall of a log determinant that asks for another.
INNER, STEPS, FALL = 0.75, 10, 1e-6
#: For five statistics and that share: how much larger a normal law's variances are than those of its inner part (INNER over the chance that a chi-square of seven degrees is below the quantile of one of five).
NORMAL = 1.411
#: Least standard deviation of each statistic, words at which scatter counts twice, and the squared distance (a normal text is beyond it once in 70,000).
FLOOR, SHORT, CUT = (0.02, 0.02, 0.02, 0.02, 0.01), 100, 30.0
#: Rows that a group needs for its own estimate, and fewest rows of any.
LEAST_ROWS, FEWEST = 100, 20
#: Width of a bin for the medians.
BIN = 0.005

_SPACE = r"[\x20\x09-\x0D]+"
STATISTICS = ("word_length", "symbols", "capitals", "marks", "distinct")
_DIM = range(len(STATISTICS))
_PAIRS = [(i, j) for i in _DIM for j in _DIM if i <= j]
_MEANS = [f"m_{i}" for i in _DIM]
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _how_many(text: str, kind: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, kind, ""))


def _covered(places: Column) -> Column:
    """Words under windows of WINDOW words that begin at ascending places."""
    own = F.transform(places, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - x, F.lit(WINDOW))))
    return F.aggregate(own, F.lit(0), lambda a, x: a + x)


def counts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, lang, source, text) with the base counts, capitals, marks and distinct words instead of the text."""
    split = docs.select("doc_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    split = split.withColumn("words", F.array_remove(F.split("text", _SPACE), ""))
    windows = F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW))))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    told = split.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _how_many("text", r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
        _how_many("text", "[A-Z]+").alias("capitals"),
        _how_many("text", "[.,;:!?]+").alias("marks"),
        F.size(F.array_distinct("words")).alias("distinct_words"),
        lines.alias("lines"),
        windows.alias("windows"),
    )
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    told = told.select(*(c for c in told.columns if c not in ("lines", "windows")), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.when(repeated, F.sort_array(F.transform("windows", lambda x, k: F.struct(x.alias("x"), k.alias("k"))))).alias("sorted"))
    again = lambda e, k: (e["x"] == F.get(F.col("sorted"), k - 1)["x"]) | (e["x"] == F.get(F.col("sorted"), k + 1)["x"])
    twice = F.filter(F.transform("sorted", lambda e, k: F.when(F.coalesce(again(e, k), F.get(F.col("sorted"), k - 1)["x"] == e["x"], F.get(F.col("sorted"), k + 1)["x"] == e["x"], F.lit(False)), e["k"])), lambda x: x.isNotNull())
    told = told.withColumn("places", F.sort_array(twice)).drop("sorted")
    return told.withColumn("n_repeat_words", F.coalesce(_covered(F.col("places")), F.lit(0)).cast("long")).drop("places")


def vectors(docs: DataFrame) -> DataFrame:
    """A table of the base counts, base_failed and the vector of statistics of every document (null where the base rules fail)."""
    told = counts(docs)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    root = lambda c: F.asin(F.sqrt(F.col(c) / F.greatest("word_chars", F.lit(1))))
    log = lambda c: F.log(F.greatest(F.col(c), F.lit(1)).cast("double"))
    values = (log("word_chars") - log("n_words"), root("n_symbols"), root("capitals"), root("marks"), log("distinct_words") / F.greatest(log("n_words"), F.lit(1e-9)))
    return written(told.select("doc_id", "lang", "source", *_BASE, failed.alias("base_failed"), *(F.when(~failed, v).alias(name) for name, v in zip(STATISTICS, values, strict=True))))


def keys(rows: DataFrame, least: int = LEAST_ROWS, fewest: int = FEWEST) -> DataFrame:
    """(lang, source, key): which rows are estimated together; none where they are too few."""
    sizes = rows.filter("not base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = F.col("n") < least
    langs = sizes.filter(small).groupBy("lang").agg(F.sum("n").alias("lang_n"))
    langs = langs.withColumn("all_n", F.sum(F.when(F.col("lang_n") < least, F.col("lang_n"))).over(Window.partitionBy(F.lit(0))))  # a row for each lang
    own = F.when(~small, F.to_json(F.array("lang", "source"))).when(F.col("lang_n") >= least, F.to_json(F.array("lang"))).when(F.col("all_n") >= fewest, F.lit("[]"))
    return written(sizes.join(langs, "lang", "left").select("lang", "source", own.alias("key")).filter("key is not null"))


def _inverted(scatter: DataFrame) -> DataFrame:
    """Columns c_ij of a positive matrix (i <= j) to p_ij of its inverse and log_det, by sweeps of one row after another."""
    at = lambda i, j: f"c_{min(i, j)}{max(i, j)}"
    carried = ["key", "start", *_MEANS]
    out = scatter.selectExpr("*", "0.0D AS log_det")
    for k in _DIM:
        pivot = at(k, k)
        swept = [f"-1 / {pivot} AS c_{i}{j}" if i == j == k else f"{at(i, j)} / {pivot} AS c_{i}{j}" if k in (i, j) else f"{at(i, j)} - {at(i, k)} * {at(k, j)} / {pivot} AS c_{i}{j}" for i, j in _PAIRS]
        out = out.selectExpr(*carried, *swept, f"log_det + ln({pivot}) AS log_det")
    return out.selectExpr(*carried, "log_det", *(f"-c_{i}{j} AS p_{i}{j}" for i, j in _PAIRS))


def _off(i: int) -> str:
    return f"({STATISTICS[i]} - m_{i})"


#: The squared distance of a row of statistics from the centre beside it.
_DISTANCE = " + ".join(f"{1 if i == j else 2} * p_{i}{j} * {_off(i)} * {_off(j)}" for i, j in _PAIRS)


def _medians(rows: DataFrame) -> DataFrame:
    """key, m_i and d_i: medians and median deviations of the statistics by bins of width BIN."""
    each = rows.select("key", F.posexplode(F.array(*(F.floor(F.col(c) / BIN).cast("int") for c in STATISTICS))).alias("i", "bin"))
    histogram = written(each.groupBy("key", "i", "bin").agg(F.count("*").alias("n")))

    def middle(counted: DataFrame, value: str) -> DataFrame:
        """The first value at which half of the rows are reached."""
        group = Window.partitionBy("key", "i")  # a row for each bin
        reached = F.sum("n").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
        return counted.withColumn("reached", reached).withColumn("all", F.sum("n").over(group)).filter(2 * F.col("reached") >= F.col("all")).groupBy("key", "i").agg(F.min(value).alias(value))

    centre = middle(histogram, "bin").withColumnRenamed("bin", "centre")
    off = histogram.join(centre, ["key", "i"]).groupBy("key", "i", "centre", F.abs(F.col("bin") - F.col("centre")).alias("off")).agg(F.sum("n").alias("n"))
    both = centre.join(middle(off.drop("centre"), "off"), ["key", "i"])
    pick = lambda v, i: F.max(F.when(F.col("i") == i, v))
    return both.groupBy("key").agg(*(pick((F.col("centre") + 0.5) * BIN, i).alias(f"m_{i}") for i in _DIM), *(pick(1.4826 * F.col("off") * BIN, i).alias(f"d_{i}") for i in _DIM))


def _starts(rows: DataFrame) -> DataFrame:
    """key, start, centre and inverse scatter: medians with median deviations, and with the covariance of spatial signs."""
    middle = written(_medians(rows))
    wide = [f"greatest(d_{i}, {FLOOR[i]}D)" for i in _DIM]
    plain = middle.selectExpr("key", "0 AS start", *_MEANS, *(f"{f'{wide[i]} * {wide[i]}' if i == j else '0.0D'} AS c_{i}{j}" for i, j in _PAIRS))
    beside = rows.join(smallable(middle), "key").selectExpr("key", *(f"{_off(i)} / {wide[i]} AS z_{i}" for i in _DIM))
    length = " + ".join(f"z_{i} * z_{i}" for i in _DIM)
    signs = beside.selectExpr("*", f"greatest({length}, 1e-12D) AS length").groupBy("key").agg(*(F.expr(f"avg({len(STATISTICS)} * z_{i} * z_{j} / length) AS z_{i}{j}") for i, j in _PAIRS))
    signed = signs.join(middle, "key").selectExpr("key", "1 AS start", *_MEANS, *(f"z_{i}{j} * {wide[i]} * {wide[j]} + {FLOOR[i] ** 2 if i == j else 0.0!r}D AS c_{i}{j}" for i, j in _PAIRS))
    return written(_inverted(plain.unionByName(signed)))


def _concentrated(rows: DataFrame, found: DataFrame) -> DataFrame:
    """One step: centre and inverse scatter of the INNER share of rows nearest by found."""
    beside = rows.join(smallable(found.drop("log_det")), "key").selectExpr("key", "start", f"CAST(floor(16 * log2(greatest({_DISTANCE}, 1e-6D))) AS int) AS bin", *(f"{_off(i)} AS o_{i}" for i in _DIM))
    sums = [f"sum(o_{i}) AS s_{i}" for i in _DIM] + [f"sum(o_{i} * o_{j}) AS s_{i}{j}" for i, j in _PAIRS]
    binned = beside.groupBy("key", "start", "bin").agg(F.count("*").alias("n"), *map(F.expr, sums))
    before = "coalesce(sum(n) OVER (PARTITION BY key, start ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before"  # a row for each bin
    inner = binned.selectExpr("*", before, "sum(n) OVER (PARTITION BY key, start) AS all").filter(f"before < {INNER} * all")
    added = inner.groupBy("key", "start").agg(*(F.expr(f"sum({c}) AS {c}") for c in ("n", *(f"s_{i}" for i in _DIM), *(f"s_{i}{j}" for i, j in _PAIRS))))
    moved = added.join(found.select("key", "start", *_MEANS), ["key", "start"])
    scatter = [f"{NORMAL} * (s_{i}{j} / n - s_{i} / n * s_{j} / n) + {FLOOR[i] ** 2 if i == j else 0.0!r}D AS c_{i}{j}" for i, j in _PAIRS]
    return written(_inverted(moved.selectExpr("key", "start", *(f"m_{i} + s_{i} / n AS m_{i}" for i in _DIM), *scatter)))


def estimates(rows: DataFrame) -> DataFrame:
    """(key, m_i, p_ij) of rows(key, statistics): the minimum covariance determinant of each key."""
    found = _concentrated(rows, _starts(rows))
    for _ in range(STEPS - 1):
        after = _concentrated(rows, found)
        falls = found.select("key", "start", F.col("log_det").alias("was")).join(after, ["key", "start"]).agg(F.max(F.col("was") - F.col("log_det")).alias("fall")).first()["fall"]
        found = after
        if falls is None or falls < FALL:
            break
    best = found.groupBy("key").agg(F.min_by(F.struct(*_MEANS, *(f"p_{i}{j}" for i, j in _PAIRS)), F.struct("log_det", "start")).alias("x"))
    return written(best.select("key", "x.*"))


def judge(docs: DataFrame) -> DataFrame:
    """docs(doc_id, lang, source, text) to doc_id, base counts, base_failed, kept and distance (null without an estimate)."""
    rows = vectors(docs.select("doc_id", "lang", "source", "text"))
    groups = smallable(keys(rows))
    known = written(rows.filter("not base_failed").join(groups, ["lang", "source"]).select("key", *STATISTICS))
    beside = rows.join(groups, ["lang", "source"], "left").join(smallable(estimates(known)), "key", "left")
    distance = F.expr(f"({_DISTANCE}) * n_words / (n_words + {SHORT})")
    return beside.withColumn("distance", distance).select("doc_id", *_BASE, "base_failed", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUT)).alias("kept"), "distance")


def op13_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"))


QUERIES = {"op13_rules": op13_rules}
ORACLES: dict[str, str] = {}
