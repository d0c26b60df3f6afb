"""Table changes as functions from old and new rows to the table's next state.

Plain Parquet tables have no row-level updates, so each change is a plan whose
result is written as a new version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows whose key is not there yet, one a key (the first by the other columns)."""
    rest = [c for c in new.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else new.distinct()
    return first.join(old.select(*keys), keys, "left_anti").select(*new.columns)


def partial_upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Like upsert, but where a new value is NULL the old one stays."""
    joined = old.alias("o").join(new.alias("n"), keys, "full")
    return joined.select(*(F.col(c) if c in keys else F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}") for c in old.columns))


def replace_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All old rows of a key that came anew go, and the new rows take their place; other keys stay."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


#: Pairs that a task makes.
PAIRS = 4_000_000


def joined_by_pieces(left: DataFrame, right: DataFrame, key: str, pairs: int = PAIRS) -> DataFrame:
    """left and right joined on ``key``, whose groups may be large on both sides.

    The right rows of a key are dealt to pieces of about ``pairs`` pairs, each of
    which meets the key's left rows under a key of its own, and there is a task
    for so many pairs.  The driver sees one number, of all pairs.
    """
    both = left.groupBy(key).agg(F.count("*").alias("_left")).join(right.groupBy(key).agg(F.count("*").alias("_right")), key)
    pieces = both.select(key, F.least(F.ceil(F.col("_left") / pairs * F.col("_right")), F.col("_right")).cast("int").alias("_pieces"))
    made = both.agg(F.sum(F.col("_left").cast("double") * F.col("_right")).alias("n")).first()["n"] or 0.0
    tasks = max(left.sparkSession.sparkContext.defaultParallelism, min(20_000, int(made // pairs) + 1))
    dealt = right.join(pieces, key).withColumn("_piece", F.pmod(F.xxhash64(*right.columns), F.col("_pieces")).cast("int")).drop("_pieces")
    copied = left.join(pieces, key).withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1))).drop("_pieces")
    return copied.repartition(tasks, key, "_piece").join(dealt.repartition(tasks, key, "_piece"), [key, "_piece"]).drop("_piece")


#: Ranges in which rows are numbered, and rows from which their bounds are taken.
RANGES, BOUNDS = 200, 4000


def numbered(rows: DataFrame, by: str, name: str = "n", ranges: int = RANGES) -> DataFrame:
    """rows, whose values of ``by`` are distinct, with their place from 1 in its order.

    Two passes: values fall into ranges, whose bounds come from the ``BOUNDS``
    values of least hash, the ranges are counted, and each range is numbered from
    what lies before it.  The driver sees the bounds and a count for each range.
    """
    some = sorted(r[0] for r in rows.select(by).orderBy(F.xxhash64(by), by).limit(BOUNDS).collect())
    bounds = [some[k * len(some) // ranges] for k in range(1, ranges)] if len(some) >= ranges else []
    kind = rows.schema[by].dataType
    cuts = F.array(*(F.lit(b) for b in dict.fromkeys(bounds))).cast(f"array<{kind.simpleString()}>")
    ranged = rows.withColumn("_range", F.size(F.filter(cuts, lambda b: b <= F.col(by))))
    counts = dict(sorted((r["_range"], r["n"]) for r in ranged.groupBy("_range").agg(F.count("*").alias("n")).collect()))
    before, starts = 0, {}
    for k, n in counts.items():
        starts[k], before = before, before + n
    offset = F.element_at(F.create_map(*(F.lit(x) for pair in starts.items() for x in pair)), F.col("_range")) if starts else F.lit(0)
    return ranged.withColumn(name, offset + F.row_number().over(Window.partitionBy("_range").orderBy(by))).drop("_range")


def with_ids(known: DataFrame, names: DataFrame) -> DataFrame:
    """known(id, name) and, with the next ids in order of name, the names that are not known."""
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = names.select("name").filter("name is not null").distinct().join(known, "name", "left_anti")
    return known.select("id", "name").unionByName(numbered(fresh, "name").crossJoin(F.broadcast(top)).select((F.col("top") + F.col("n")).cast(known.schema["id"].dataType).alias("id"), "name"))


def synthetic_codes(known: DataFrame, names: DataFrame) -> DataFrame:
    """code, name of names(place, name): known codes, and for others negative ones that go down from the least so far."""
    low = known.agg(F.least(F.coalesce(F.min("code"), F.lit(0)), F.lit(0)).alias("low"))
    missing = names.join(known, "name", "left_anti").groupBy("name").agg(F.min("place").alias("place"))
    minted = numbered(missing, "place").crossJoin(F.broadcast(low))  # one row
    return names.join(known, "name").select("code", "name").distinct().unionByName(minted.select((F.col("low") - F.col("n")).cast("long").alias("code"), "name"))


def rekeyed(rows: DataFrame, mapping: DataFrame, key: str, within: list[str]) -> DataFrame:
    """rows with keys moved by mapping(old, new); of rows that then share a key, those that were there stay."""
    moved = rows.join(mapping, rows[key] == mapping["old"], "left").withColumn("_moved", F.col("old").isNotNull()).withColumn(key, F.coalesce("new", key))
    place = F.row_number().over(Window.partitionBy(key, *within).orderBy("_moved", "old"))
    return moved.withColumn("_place", place).filter("_place = 1").select(*rows.columns)


def prioritised(parts: list[tuple[int, DataFrame]], keys: list[str]) -> DataFrame:
    """One row a key, from the part of lowest priority number that has it."""
    rows = None
    for priority, part in parts:
        tagged = part.withColumn("_p", F.lit(priority))
        rows = tagged if rows is None else rows.unionByName(tagged)
    rest = [c for c in rows.columns if c not in (*keys, "_p")]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("_p", *rest)).alias("_r")).select(*keys, "_r.*")


def unique_matches(left: DataFrame, right: DataFrame, keys: list[str], take: str) -> DataFrame:
    """left with ``take`` of right where exactly one row of right has its keys."""
    single = right.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(take).alias(take)).filter("_n = 1").drop("_n")
    return left.join(single, keys)


def status_of(present: Column) -> Column:
    return F.when(present, "available").otherwise("pending")


def filled(rows: DataFrame, dimension: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows whose NULL or empty columns are taken from dimension, which has one row a key."""
    named = dimension.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    joined = rows.join(named, key, "left").withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), f"_{c}") for c in columns})
    return joined.select(*rows.columns)


def refreshed(cached: DataFrame, fresh: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """cached with the rows of the asked keys replaced by their fresh ones, if they have any."""
    kept = cached.join(asked.select(*keys), keys, "left_anti")
    return kept.unionByName(fresh.join(asked.select(*keys).distinct(), keys, "left_semi").select(*cached.columns))


def tracked(registry: DataFrame, names: DataFrame) -> DataFrame:
    """Registry rows with their names, by name; codes without a name do not show."""
    return registry.join(names, "code").orderBy("name", "code")


def any_status(wanted: str, *columns: str) -> Column:
    return F.array_contains(F.array(*(F.coalesce(F.col(c), F.lit("")) for c in columns)), wanted)


def with_statuses(registry: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """registry with the statuses that changes, one row a key, gives (NULL: as before), and whether the key was ``attempted``."""
    given = [c for c in changes.columns if c != key]
    marked = changes.select(key, F.lit(True).alias("_hit"), *(F.col(c).alias(f"_{c}") for c in given))
    joined = registry.join(marked, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in given})
    return joined.withColumn("attempted", F.coalesce("_hit", F.lit(False))).select(*registry.columns, "attempted")


def freshness(funds: DataFrame, rows: DataFrame, key: str, day: str, today: str, most: int) -> DataFrame:
    """Per fund the number of rows, first and last day, age in days and status: Stale beyond ``most`` days, Missing without rows."""
    spans = rows.groupBy(key).agg(F.count("*").alias("records"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    joined = funds.join(spans, key, "left").withColumn("records", F.coalesce("records", F.lit(0).cast("long"))).withColumn("days_old", F.datediff(F.lit(today).cast("date"), "last_day").cast("long"))
    return joined.withColumn("status", F.when(F.col("days_old").isNull(), "Missing").when(F.col("days_old") > most, "Stale").otherwise("Fresh"))


def resolved(rows: DataFrame, codes: DataFrame, slug: str) -> DataFrame:
    """rows with the code of their slug, codes having one row a slug; rows whose slug is unknown are skipped."""
    return rows.join(codes, slug).drop(slug)
