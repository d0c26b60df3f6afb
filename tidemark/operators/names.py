"""Resolution of a table of names against a table of known names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import trigrams


def plain(name: Column) -> Column:
    """A name as it is compared: trimmed, lower-cased, runs of blanks, hyphens and underscores as one blank."""
    return F.regexp_replace(F.lower(F.trim(name)), r"[\s\-_]+", " ")


def similar(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """a, b, similarity of all of left(a) and right(b), distinct names, whose trigram sets share at least ``least`` (above 0) of their union.

    A set-similarity join: trigrams are ordered from the rarest; two sets that
    similar share one of their first trigrams (prefix filter), are of near size
    (length filter), and have enough trigrams left behind the first shared one
    (positional filter).  What passes is counted in full.  Frequent trigrams are
    in no prefix, so they bring no pairs together.
    """
    both = left.select(F.lit(0).alias("side"), F.col("a").alias("name")).unionByName(right.select(F.lit(1).alias("side"), F.col("b").alias("name")))
    each = both.select("side", "name", F.explode(trigrams(F.col("name"))).alias("gram"))
    frequency = each.groupBy("gram").agg(F.count("*").alias("n"))
    ranked = each.join(frequency, "gram").groupBy("side", "name").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("grams"))
    sets = ranked.select("side", "name", F.col("grams.gram").alias("grams"), F.size("grams").alias("size"))
    heads = sets.select("side", "name", "size", F.posexplode(F.slice("grams", F.lit(1), F.col("size") - F.ceil(least * F.col("size") - 1e-9).cast("int") + 1)).alias("at", "gram"))
    one = heads.filter("side = 0").select("gram", F.col("name").alias("a"), F.col("size").alias("size_a"), F.col("at").alias("at_a"))
    two = heads.filter("side = 1").select("gram", F.col("name").alias("b"), F.col("size").alias("size_b"), F.col("at").alias("at_b"))
    near = (F.col("size_b") >= least * F.col("size_a") - 1e-9) & (F.col("size_a") >= least * F.col("size_b") - 1e-9)
    left_over = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))
    first = one.join(two, "gram").filter(near).groupBy("a", "b", "size_a", "size_b").agg(F.min_by(left_over, F.col("at_a") + F.col("at_b")).alias("left_over"))
    passing = first.filter(F.col("left_over") >= least / (1 + least) * (F.col("size_a") + F.col("size_b")) - 1e-9).select("a", "b")
    grams = lambda side, name: sets.filter(f"side = {side}").select(F.col("name").alias(name), F.col("grams").alias(f"grams_{name}"))
    counted = passing.join(grams(0, "a"), "a").join(grams(1, "b"), "b").withColumn("shared", F.size(F.array_intersect("grams_a", "grams_b")))
    share = F.col("shared") / (F.size("grams_a") + F.size("grams_b") - F.col("shared"))
    return counted.select("a", "b", share.alias("similarity")).filter(F.col("similarity") >= least - 1e-9)


def resolve(asked: DataFrame, known: DataFrame, least: float = 0.3, words: int = 4) -> DataFrame:
    """name, code, found, step of every distinct name of asked(name), by known(code, name).

    What is similar enough counts as found, the most similar and then shortest
    name first.  The first of it whose plain name is equal wins (step 1), else
    the first of which one plain name holds the other (2), else the first of all
    if the asked name has at least ``words`` words of two letters or more (3).
    Names that nothing resolves have no code.  Known names that are equal count
    with their least code; names without trigrams find nothing.
    """
    names = asked.select("name").filter("name is not null").distinct()
    codes = known.filter("name is not null").groupBy("name").agg(F.min("code").alias("code"))
    found = similar(names.select(F.col("name").alias("a")), codes.select(F.col("name").alias("b")), least)
    a, b = plain(F.col("a")), plain(F.col("b"))
    long_words = F.size(F.filter(F.split("a", r"\s+"), lambda w: F.length(w) > 1))
    step = F.when(a == b, 1).when(F.contains(a, b) | F.contains(b, a), 2).when(long_words >= words, 3)
    ladder = found.withColumn("step", step).filter("step is not null").join(codes.withColumnRenamed("name", "b"), "b")
    best = ladder.groupBy("a").agg(F.min(F.struct("step", (-F.round("similarity", 12)).alias("_far"), F.length("b").alias("_length"), "code", F.col("b").alias("found"))).alias("x"))
    return names.join(best.select(F.col("a").alias("name"), "x.code", "x.found", "x.step"), "name", "left").select("name", "code", "found", "step")
