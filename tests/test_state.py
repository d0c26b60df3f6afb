"""Streams with state, tables changed in place, numbering, name resolution and blocked pairs, against plain versions."""

import datetime as dt
import itertools
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import holdings, names, pages, portfolio, recurrence, series, tables
from tidemark.sources import catalog, sink
from tidemark.sources.sink import Table
from tidemark.streaming import stops, streams

START = dt.datetime(2024, 3, 1)


def walk(rows, stop, trailing):
    """Trades of (k, ts, id, price, entry, leave), which are taken in order of time."""
    out, held = [], {}
    for k, _, id, price, entry, leave in sorted(rows, key=lambda r: (r[1], r[2])):
        if k not in held:
            if entry:
                held[k] = [id, price, price]
            continue
        opened, paid, high = held[k]
        high = held[k][2] = max(high, price) if trailing else high
        if leave or price <= high * (1 - stop):
            out.append((k, opened, id, paid, price, high, "signal" if leave else "stop"))
            del held[k]
    return sorted(out)


@pytest.fixture(scope="module")
def ticks():
    rng = random.Random(8)
    rows = [(f"k{rng.randrange(6)}", START + dt.timedelta(minutes=7 * i + rng.randrange(7)), i, 50 + 20 * rng.random(), rng.random() < 0.25, rng.random() < 0.1) for i in range(400)]
    return [*rows, ("alone", START + dt.timedelta(days=1), 900, 5.0, True, False), ("k1", START, 901, None, True, False), ("k1", START, 902, 60.0, None, None)]


_TICKS = "k string, ts timestamp, id long, price double, entry boolean, leave boolean"


def put(spark, folder, part, rows):
    spark.createDataFrame(rows, _TICKS).coalesce(1).write.parquet(f"{folder}/{part}")


def ticking(spark, folder):
    return spark.readStream.schema(_TICKS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


@pytest.mark.parametrize(("cuts", "trailing"), [((400,), True), ((130, 270), True), ((90, 91, 300), False)])
def test_stops_do_not_depend_on_batches_or_restarts(spark, ticks, tmp_path, cuts, trailing):
    """One run, or runs of their own for each part of the rows, which come out of order within the delay."""
    rng = random.Random(1)
    late = sorted(ticks, key=lambda r: r[1] + dt.timedelta(minutes=rng.randrange(50)))
    last = ("clock", max(r[1] for r in ticks) + dt.timedelta(hours=9), 1000, 1.0, False, False)
    parts = np.split(np.arange(len(late)), cuts)
    for n, part in enumerate(parts):
        put(spark, f"{tmp_path}/in", n, [late[i] for i in part] + ([last] if n == len(parts) - 1 else []))
        streams.appended(stops.stop_trades(ticking(spark, f"{tmp_path}/in"), "1 hour", 0.1, trailing), str(tmp_path), stops.STORE)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = walk([(k, ts, id, p, bool(e), bool(x)) for k, ts, id, p, e, x in ticks if p is not None], 0.1, trailing)
    assert got == want
    assert {r[-1] for r in want} == {"signal", "stop"}


class Held:
    """State of one key in memory."""

    def __init__(self):
        self.rows, self.timers = [], []
        self.getListState = lambda name, schema: self
        self.getValueState = lambda name, schema: Held()
        self.registerTimer = self.timers.append
        self.appendValue, self.appendList = self.rows.append, self.rows.extend
        self.clear, self.exists = self.rows.clear, lambda: bool(self.rows)

    def get(self):
        return self.rows[0] if not self.timers and self.rows else iter(list(self.rows))

    def put(self, rows):
        self.rows = list(rows)

    def update(self, row):
        self.rows = [row]


def test_stops_of_many_keys_share_a_state():
    """A call and a stored value serve all rows of a bucket, whatever the number of its keys."""
    step = stops.StopWalk(0.1, True)
    held = Held()
    step.init(held)
    rows = [(f"k{k}", 1_000_000 * n, 500 * n + k, price, n == 0, False) for n, price in enumerate((10.0, 12.0, 9.0)) for k in range(500)]
    list(step.handleInputRows((3,), iter([pd.DataFrame(rows, columns=["k", "at", "id", "price", "entry", "leave"])]), None))
    assert len(held.rows) == 1 and held.timers == [0]

    class Now:
        getCurrentWatermarkInMs = staticmethod(lambda: 5_000)

    got = pd.concat(step.handleExpiredTimer((3,), Now, None))
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted((f"k{k}", k, 1_000 + k, 10.0, 9.0, 12.0, "stop") for k in range(500))
    assert not held.rows


def test_state_of_the_duplicates_is_bounded(spark, tmp_path):
    """Keys older than the delay leave the state, and the table still takes no key twice."""
    rows = [(START + dt.timedelta(hours=i), i % 300, "t") for i in range(600)]
    for n in range(6):
        spark.createDataFrame(rows[100 * n : 100 * n + 100], "ts timestamp, user_id long, event_type string").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema("ts timestamp, user_id long, event_type string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    out = Table(spark, f"{tmp_path}/table", "user_id long, event_type string", ["user_id", "event_type"], buckets=4)
    query = streams.inserted(streams.first_of_each(stream, ["user_id", "event_type"], "5 hours"), out)
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(states) < 250 and states[-1] < 50
    assert sorted(r["user_id"] for r in out.read().collect()) == list(range(300))


def test_repeated_batches_change_nothing(spark, tmp_path):
    out = Table(spark, f"{tmp_path}/table", "user_id long, v double", ["user_id"], buckets=4)
    out.change("first", spark.createDataFrame([(i, 0.0) for i in range(8)], "user_id long, v double"))
    rows = [(1, 1.0, True), (1, 2.0, True), (2, 9.0, False), (20, 3.0, True), (None, 4.0, True)]
    spark.createDataFrame(rows, "user_id long, v double, ok boolean").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("user_id long, v double, ok boolean").parquet(f"{tmp_path}/in")
    want = sorted([(0, 0.0), (1, 1.0), (1, 2.0), (20, 3.0), (None, 4.0), *((i, 0.0) for i in range(2, 8))], key=repr)
    for _ in range(2):  # the second run has lost its checkpoint and repeats the batch
        streams.replaced(stream, out, "ok")
        assert sorted((tuple(r) for r in out.read().collect()), key=repr) == want
        os.rename(f"{tmp_path}/table/state", f"{tmp_path}/lost-{random.random()}")


_ROWS = "code long, v double"


def frame(spark, rows):
    return spark.createDataFrame(rows, _ROWS)


def content(table):
    return sorted((tuple(r) for r in table.read().collect()), key=repr)


def test_change_goes_on_after_a_kill(spark, tmp_path, monkeypatch):
    """Killed between staging and overwriting, and between the tables of one change."""
    a, b, c = (Table(spark, f"{tmp_path}/{n}", _ROWS, ["code"], buckets=8) for n in "abc")
    old = [(i, float(i)) for i in range(40)]
    sink.change_all("first", [(t, frame(spark, old)) for t in (a, b, c)])
    new = [(3, -1.0), (3, -2.0), (77, -3.0)]
    after = sorted([x for x in old if x[0] != 3] + new, key=repr)
    changes = [(t, frame(spark, new)) for t in (a, b, c)]
    with monkeypatch.context() as m:
        m.setattr(Table, "publish", lambda self, name: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            sink.change_all("second", changes)
    assert content(a) == content(b) == content(c) == sorted(old, key=repr)
    publish = Table.publish
    with monkeypatch.context() as m:
        m.setattr(Table, "publish", lambda self, name: publish(self, name) if self is a else (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            sink.change_all("second", changes)
    assert content(a) == after and content(b) == sorted(old, key=repr)
    for _ in range(2):
        sink.change_all("second", changes)
        assert content(a) == content(b) == content(c) == after
    a.change("third", frame(spark, []))
    assert content(a) == after


def test_overwrite_that_breaks_off_is_done_again(spark, tmp_path, monkeypatch):
    """Partitions were overwritten, but the change was not marked as done."""
    t = Table(spark, f"{tmp_path}/t", _ROWS, ["code"], buckets=4)
    t.change("first", frame(spark, [(i, 0.0) for i in range(10)]))
    t.stage("second", frame(spark, [(4, 1.0)]))
    spark.read.schema(t._partitions().schema).parquet(f"{t.path}/stage/second").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{t.path}/data")
    t.change("second", frame(spark, [(4, 1.0)]))
    assert content(t) == sorted([(i, float(i == 4)) for i in range(10)], key=repr)
    assert t.done("second") and not t._staged("second")


@pytest.mark.parametrize("n", [0, 3, 5000])
def test_numbers_follow_the_order(spark, n):
    rng = random.Random(n)
    words = sorted({"".join(rng.choice("aäbcz ") for _ in range(8)) for _ in range(n)}, key=str.encode)
    shuffled = rng.sample(words, len(words))
    rows = tables.numbered(spark.createDataFrame([(w,) for w in shuffled], "name string").repartition(4), "name", ranges=50)
    assert [(r["name"], r["n"]) for r in rows.orderBy("n").collect()] == [(w, i) for i, w in enumerate(words, 1)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    numbers = tables.numbered(spark.createDataFrame([(7 * k % 1009,) for k in range(1009)], "place int"), "place", ranges=20)
    assert all(r["n"] == r["place"] + 1 for r in numbers.collect())


def test_joins_of_large_groups_are_spread(spark):
    """Two keys of many pairs and one of a single pair: no task makes more than a few pieces."""
    left = spark.createDataFrame([("x", k) for k in range(300)] + [("y", k) for k in range(40)] + [("z", 0), ("alone", 1), (None, 2)], "n string, a int")
    right = spark.createDataFrame([("x", k) for k in range(400)] + [("y", k) for k in range(100)] + [("z", 0), ("other", 1), (None, 2)], "n string, b int")
    joined = tables.joined_by_pieces(left, right, "n", pairs=2_000)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, left.join(right, "n").collect()))
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 124_001 and max(sizes) < 20_000


def grams(name):
    return {("  " + w + " ")[i : i + 3] for w in "".join(c if c.isascii() and c.isalnum() else " " for c in name.lower()).split() for i in range(len(w) + 1)}


def test_similar_names_are_all_found(spark):
    rng = random.Random(5)
    parts = ["fund", "growth", "blue", "chip", "india", "direct", "plan", "tax", "saver", "x", "12", "é"]
    make = lambda: " ".join(rng.choice(parts) for _ in range(rng.randint(1, 6)))
    left, right = sorted({make() for _ in range(120)} | {"", "--"}), sorted({make() for _ in range(150)} | {"", "!"})
    for least in (0.3, 0.5, 0.8, 1.0):
        got = {(r["a"], r["b"]): r["similarity"] for r in names.similar(spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string"), least).collect()}
        want = {}
        for a, b in itertools.product(left, right):
            x, y = grams(a), grams(b)
            if x | y and len(x & y) / len(x | y) >= least - 1e-9 and x & y:
                want[a, b] = len(x & y) / len(x | y)
        assert got == pytest.approx(want)


def test_names_resolve_by_steps(spark):
    known = [(5, "Blue Chip Fund"), (4, "Blue Chip Fund"), (6, "Blue Chip Fund - Growth"), (7, "Tax Saver Plan"), (8, None)]
    asked = ["blue-chip  FUND", "Blue Chip Fund Direct", "Saver Plan Tax of India", "Plan Saver Tax", "nothing like it", "", None, "blue-chip  FUND"]
    found = names.resolve(spark.createDataFrame([(a,) for a in asked], "name string"), spark.createDataFrame(known, "code int, name string")).collect()
    assert {r["name"]: (r["code"], r["step"]) for r in found} == {"blue-chip  FUND": (4, 1), "Blue Chip Fund Direct": (4, 2), "Saver Plan Tax of India": (7, 3), "Plan Saver Tax": (None, None), "nothing like it": (None, None), "": (None, None)}
    assert len(found) == 6


@pytest.mark.parametrize("block", [2, 512])
def test_correlations_by_blocks(spark, block):
    rng = np.random.default_rng(4)
    days = pd.date_range("2022-11-01", periods=90)
    panel = pd.DataFrame(rng.normal(size=(90, 7)), days, [f"k{i}" for i in range(7)])
    panel["k1"] += panel["k0"]
    panel = panel.mask(rng.random(panel.shape) < 0.3)
    panel["k6"] = 0.25
    panel.loc[days[20]:, "k5"] = np.nan
    rows = [(k, d.date(), None if pd.isna(v) else float(v)) for k in panel for d, v in panel[k].items()]
    got = {(r["a"], r["b"]): r["corr"] for r in series.correlation_pairs(spark.createDataFrame(rows, "k string, d date, r double"), "r", 15, block=block).collect()}
    want = panel.corr(min_periods=15).fillna(0.0)
    common = panel.notna().astype(int).T @ panel.notna().astype(int)
    assert got == pytest.approx({(a, b): want.loc[a, b] for a in panel for b in panel if common.loc[a, b]}, abs=1e-9)


def test_correlations_have_no_row_for_a_pair_and_day(spark):
    """2,000 keys of 5 days: pairs come from products of blocks, and the join of days is gone from the plan."""
    rows = spark.range(10_000).select(F.concat(F.lit("k"), (F.col("id") % 2000).cast("string")).alias("k"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 2000).cast("int")).alias("d"), F.rand(3).alias("r"))
    pairs = series.correlation_pairs(rows, "r", 3)
    assert "Join" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.count() == 2000 * 2000


@pytest.mark.parametrize("piece", [3, 512])
def test_overlap_of_an_instrument_that_all_hold(spark, piece):
    rng = random.Random(9)
    rows = [(f"k{i}", "all", 10 * rng.random()) for i in range(25)] + [(f"k{rng.randrange(25)}", f"i{rng.randrange(9)}", 20 * rng.random()) for _ in range(90)]
    own = {}
    for k, i, w in rows:
        own[k, i] = own.get((k, i), 0.0) + w
    want = {}
    for (k, i), w in own.items():
        for (m, j), v in own.items():
            if i == j and k <= m:
                want[k, m] = want.get((k, m), 0.0) + min(w, v)
    got = {(r["a"], r["b"]): r["overlap"] for r in holdings.overlap(spark.createDataFrame(rows, "k string, instrument string, weight double"), piece).collect()}
    assert got == pytest.approx({p: round(min(s, 100.0), 2) for p, s in want.items()}, abs=0.0101)


def test_hot_instrument_is_spread_over_tasks(spark):
    """20,000 holders of one instrument meet in pieces: no key of the join has more rows than two pieces."""
    rows = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"), F.lit("all").alias("instrument"), F.lit(1.0).alias("weight"))
    pairs = holdings.overlap(rows, 256)
    assert pairs.count() == 3000 * 3001 // 2
    assert pairs.filter("overlap <> 1").isEmpty()


def dense(trades, nav):
    """Value and returns of a portfolio over every day and fund."""
    t, n = pd.DataFrame(trades, columns=["id", "k", "d", "side", "qty", "price"]), pd.DataFrame(nav, columns=["k", "d", "nav"])
    t["q"] = np.where(t["side"].str.lower() == "buy", t["qty"], -t["qty"])
    n = n[n["k"].isin(t["k"])]
    days = sorted(n["d"].unique())
    v = n.pivot(index="d", columns="k", values="nav").reindex(days).ffill()
    units = t.groupby(["d", "k"])["q"].sum().unstack().cumsum(skipna=True)
    at_days = units.reindex(days).ffill().reindex(columns=v.columns).fillna(0.0)
    return days, v, at_days, t


def test_portfolio_sweep_equals_the_dense_panel(spark):
    rng = random.Random(6)
    day = lambda i: dt.date(2023, 12, 1) + dt.timedelta(days=i)
    nav = [(k, day(i), 50 + 30 * rng.random()) for k in "abcde" for i in range(0 if k != "c" else 40, 120) if rng.random() < 0.6 and i % 7 < 5]
    trades = [(i, rng.choice("abcd"), day(rng.randrange(125)), rng.choice(["BUY", "buy", "sell"]), 1 + rng.random(), 10.0) for i in range(60)]
    t, n = spark.createDataFrame(trades, "trade_id int, k string, d date, side string, qty double, price double"), spark.createDataFrame(nav, "k string, d date, nav double")
    days, v, units, frame = dense(trades, nav)
    value = (v * units).sum(axis=1)
    got = {r["d"]: r["value"] for r in portfolio.value_series(t, n).collect()}
    assert got == pytest.approx({d: value[d] for d in days if value[d] > 0})
    rolled = {}
    for k, d, q in zip(frame["k"], frame["d"], frame["q"], strict=True):
        later = [x for key, x, _ in nav if key == k and x >= d]
        if later:
            rolled[k, min(later)] = rolled.get((k, min(later)), 0.0) + q
    held = pd.DataFrame(0.0, days, v.columns)
    flow = pd.Series(0.0, days)
    for (k, d), q in rolled.items():
        held.loc[d, k] += q
        flow[d] += q * v.loc[d, k]
    total = (held.cumsum() * v).sum(axis=1)
    for r in portfolio.time_weighted_returns(t, n).collect():
        i = days.index(r["d"])
        assert (r["value"], r["flow"]) == pytest.approx((total.iloc[i], flow.iloc[i]), abs=1e-7)
        sound = i > 0 and total.iloc[i] > 0 and total.iloc[i - 1] > 0
        assert (r["r"] is not None) == sound
        if sound:
            assert r["r"] == pytest.approx((total.iloc[i] - flow.iloc[i]) / total.iloc[i - 1] - 1, abs=1e-7)


def test_sweep_reads_each_table_once(spark):
    nav = spark.createDataFrame([("a", dt.date(2024, 1, 1), 1.0)], "k string, d date, nav double")
    plan = portfolio.time_weighted_returns(spark.createDataFrame([(1, "a", dt.date(2024, 1, 1), "buy", 1.0, 1.0)], "trade_id int, k string, d date, side string, qty double, price double"), nav)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan


def test_running_totals_carry_over_spans(spark):
    rng = random.Random(2)
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), rng.random(), i) for i in range(0, 900, 3)]
    got = series.running_total(spark.createDataFrame(rows, "d date, v double, i int").repartition(5), "v").orderBy("d").collect()
    assert [r["v"] for r in got] == pytest.approx(list(itertools.accumulate(v for _, v, _ in rows)))
    assert [r["i"] for r in got] == [i for _, _, i in rows]


def test_catalog_sizes_are_the_files_sizes(spark, tmp_path):
    spark.range(100).repartition(3).write.parquet(f"{tmp_path}/a")
    spark.range(0).write.parquet(f"{tmp_path}/none")
    got = {r["name"]: r for r in catalog.sizes(spark, {"a": f"{tmp_path}/a", "none": f"{tmp_path}/none"}).collect()}
    files = [f for f in os.listdir(tmp_path / "a") if f.endswith(".parquet")]
    assert (got["a"]["rows"], got["a"]["files"], got["a"]["bytes"]) == (100, len(files), sum(os.path.getsize(tmp_path / "a" / f) for f in files))
    assert got["none"]["rows"] == 0


def test_exponential_means_over_blocks(spark):
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for k, n in (("long", 2_600), ("short", 9), ("one", 1)):
        days = pd.date_range("2015-01-05", periods=n, freq="B")
        x = pd.Series(100 + rng.normal(size=n).cumsum(), days)
        for name, share in (("slow", 0.05), ("fast", 0.5)):
            want.update({(k, d.date(), name): v for d, v in x.ewm(alpha=share, adjust=False).mean().items()})
        rows += [(k, d.date(), float(v)) for d, v in x.items()]
    out = recurrence.exponential_means(spark.createDataFrame(rows, "k string, d date, x double").repartition(6), "x", {"slow": 0.05, "fast": 0.5})
    got = {(r["k"], r["d"], name): r[name] for r in out.collect() for name in ("slow", "fast")}
    assert got == pytest.approx(want, rel=1e-12)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Arrow" not in plan


def test_linear_recurrence_with_factors_of_its_own(spark):
    rng = random.Random(3)
    rows = [("k", dt.date(2020, 1, 1) + dt.timedelta(days=i), 0.2 + rng.random(), rng.uniform(-1, 1)) for i in range(700)]
    y, want = 0.0, []
    for _, _, a, b in rows:
        y = a * y + b
        want.append(y)
    out = recurrence.linear(spark.createDataFrame(rows, "k string, d date, a double, b double"), {"y": (F.col("a"), F.col("b"))}).orderBy("d").collect()
    assert [r["y"] for r in out] == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_composition_of_percent_and_share_weights(spark):
    rows = [("a", "Equity Shares", 60.0), ("a", "Debt / Bond", 25.0), ("a", "Cash", 10.0), ("a", None, 5.0), ("a", "Equity", None), ("b", "bond", 0.4), ("b", "Money Market", 0.5), ("b", "gold", 0.1)]
    got = {r["k"]: r for r in pages.composition(spark.createDataFrame(rows, "k string, asset_class string, weight double")).collect()}
    assert [got["a"][c] for c in ("pct_equity", "pct_debt", "pct_cash", "pct_top3", "pct_top5", "pct_top10")] == pytest.approx([0.6, 0.25, 0.1, 0.95, 1.0, 1.0])
    assert [got["b"][c] for c in ("pct_equity", "pct_debt", "pct_cash", "pct_top3")] == pytest.approx([0.0, 0.4, 0.5, 1.0])


def test_windows_need_thirty_rows_more(spark):
    start = dt.date(2020, 1, 1)
    rows = [("short", start + dt.timedelta(days=i), 100.0 + i) for i in range(92)] + [("long", start + dt.timedelta(days=i), 100.0 + i) for i in range(93)]
    got = pages.rolling_pages(spark.createDataFrame(rows, "k string, d date, nav double")).collect()
    assert [(r["k"], r["label"], r["chosen"]) for r in got] == [("long", "3 Months", True)]
    assert got[0]["latest"] == pytest.approx(100 * (192 / 129 - 1))


def test_benchmarks_of_choice(spark):
    start = dt.date(2020, 1, 1)
    prices = [("A", start + dt.timedelta(days=i), 100.0 * 1.001**i * (1 + 0.01 * (i % 3))) for i in range(300)]
    frame = spark.createDataFrame(prices, "b string, d date, close double")
    market = pages.index_returns(frame, "A")
    none = pages.index_returns(frame, "Z")
    assert none.count() == 0 and none.schema == market.schema
    funds = market.select(F.lit("f").alias("k"), "d", (2 * F.col("br")).alias("r")).unionByName(market.limit(20).select(F.lit("young").alias("k"), "d", F.col("br").alias("r")))
    got = {r["k"]: r for r in pages.last_year_capm(funds, market).collect()}
    assert got["f"]["beta"] == pytest.approx(2.0) and got["young"]["beta"] is None
    assert all(r["beta"] is None for r in pages.last_year_capm(funds, none).collect())
