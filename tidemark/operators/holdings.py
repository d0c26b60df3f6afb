"""Operators on portfolio holdings: (k, month, instrument, asset_class, bucket, rating, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str = "k", day: str = "month") -> DataFrame:
    """The rows of each key's last day; a missing day is the last, as missing days sort first when descending."""
    last = rows.groupBy(key).agg(F.when(F.count_if(F.col(day).isNull()) == 0, F.max(day)).alias("_last"))
    both = rows.join(last.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")) & F.col(day).eqNullSafe(F.col("_last")))
    return both.drop("_key", "_last")


#: Holders of an instrument that are paired in one task.
PIECE = 512


def overlap(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """a, b, overlap of every two keys: the sum of the smaller weights of common instruments, at most 100, and min(own sum, 100) for a key itself.

    The holders of an instrument are dealt to pieces of about ``piece``, and
    every two pieces meet under a key of their own, each two once, so an
    instrument that all keys hold is spread over tasks.
    """
    own = rows.groupBy("k", "instrument").agg(F.sum("weight").alias("weight"))
    pieces = own.groupBy("instrument").agg(F.ceil(F.count("*") / piece).cast("int").alias("pieces"))
    dealt = own.join(pieces, "instrument").withColumn("piece", F.pmod(F.xxhash64("k"), F.col("pieces")).cast("int"))
    low = dealt.select("instrument", F.col("piece").alias("low"), F.explode(F.sequence("piece", F.col("pieces") - 1)).alias("high"), F.col("k").alias("a"), F.col("weight").alias("x"))
    high = dealt.select("instrument", F.explode(F.sequence(F.lit(0), "piece")).alias("low"), F.col("piece").alias("high"), F.col("k").alias("b"), F.col("weight").alias("y"))
    met = low.join(high, ["instrument", "low", "high"]).filter("low < high or a <= b")
    pairs = met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum(F.least("x", "y")).alias("s"))
    return pairs.select("a", "b", F.round(F.least("s", F.lit(100.0)), 2).alias("overlap"))


def shares(rows: DataFrame, by: Column, name: str) -> DataFrame:
    """k, the class and its share of the key's weight, in percent."""
    sums = rows.groupBy("k", by.alias(name)).agg(F.sum("weight").alias("w"))
    return sums.select("k", name, F.try_divide(100 * F.col("w"), F.sum("w").over(Window.partitionBy("k"))).alias("share"))


def concentration(rows: DataFrame, tops: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """k and the share of the key's weight in its n largest positions; NULL if it holds nothing."""
    place = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("weight"), "instrument", "bucket", "rating"))
    ranked = rows.withColumn("place", place)
    total = F.sum("weight")
    return ranked.groupBy("k").agg(*(F.when(total > 0, 100 * F.sum(F.when(F.col("place") <= n, F.col("weight"))) / total).alias(f"top_{n}") for n in tops))


def top_and_others(rows: DataFrame, n: int = 10) -> DataFrame:
    """k, instrument, weight of the n largest instruments, and the rest as 'Others'."""
    sums = rows.groupBy("k", "instrument").agg(F.sum("weight").alias("weight"))
    place = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("weight"), "instrument"))
    named = sums.withColumn("instrument", F.when(place <= n, F.col("instrument")).otherwise("Others"))
    return named.groupBy("k", "instrument").agg(F.sum("weight").alias("weight")).filter("weight > 0")


def missing_classes(rows: DataFrame, key: str) -> DataFrame:
    """Classes that others hold and the key does not, with their mean share over the others, largest first."""
    others = rows.filter(F.col("k") != key)
    n = rows.select("k").distinct().agg(F.count("*").alias("n"))
    mean = others.groupBy("instrument").agg(F.sum("weight").alias("s"), F.count_distinct("k").alias("funds")).crossJoin(F.broadcast(n))  # one row
    gone = mean.join(rows.filter(F.col("k") == key).select("instrument").distinct(), "instrument", "left_anti")
    return gone.select("instrument", (F.col("s") / F.col("n")).alias("mean_weight"), "funds")
