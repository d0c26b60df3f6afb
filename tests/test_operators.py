"""Operators on small literal frames, with the edge cases that the SQL twins do not reach."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import plain_indicators as plain
from tidemark import indicators, strategies
from tidemark.functions import dates, text
from tidemark.indicators import recursive, scanned
from tidemark.operators import cluster, holdings, metrics, portfolio, quality, series, tables
from tidemark.operators.screener import Filters, screen

D = lambda n: dt.date(2024, 1, n)
TRADE = "k string, d date, side string, qty double, price double"
NAV = "k string, d date, nav double"


def test_trades_get_signs_in_any_case(spark):
    rows = spark.createDataFrame([("A", D(1), "BUY", 10.0, 5.0), ("A", D(2), "sell", 4.0, 6.0)], TRADE)
    got = portfolio.signed(rows).orderBy("d").collect()
    assert [r["signed_qty"] for r in got] == [10, -4] and [r["trade_value"] for r in got] == [50, -24]


def test_units_add_up_by_fund_and_day(spark):
    trades = [("A", D(1), "buy", 10.0, 1.0), ("A", D(1), "buy", 4.0, 1.0), ("A", D(2), "sell", 2.0, 1.0), ("B", D(1), "buy", 100.0, 1.0), ("B", D(3), "buy", 50.0, 1.0)]
    got = portfolio.cumulative_units(spark.createDataFrame(trades, TRADE)).orderBy("k", "d").collect()
    assert [(r["k"], r["d"], r["units"]) for r in got] == [("A", D(1), 14), ("A", D(2), 12), ("B", D(1), 100), ("B", D(3), 150)]


@pytest.mark.parametrize(
    ("trades", "nav", "values"),
    [
        ([("A", D(1), "buy", 10.0, 1.0)], [("A", D(1), 10.0), ("A", D(2), 11.0), ("A", D(3), 12.0)], [100, 110, 120]),
        ([("A", D(1), "buy", 10.0, 1.0), ("B", D(2), "buy", 5.0, 1.0)], [("A", D(1), 10.0), ("A", D(3), 12.0), ("B", D(2), 20.0)], [100, 200, 220]),
        ([], [("A", D(1), 10.0)], []),
        ([("A", D(1), "buy", 10.0, 1.0), ("A", D(1), "sell", 10.0, 1.0)], [("A", D(1), 10.0)], []),
    ],
)
def test_portfolio_values(spark, trades, nav, values):
    out = portfolio.value_series(spark.createDataFrame(trades, TRADE), spark.createDataFrame(nav, NAV))
    assert [r["value"] for r in out.orderBy("d").collect()] == values


def test_time_weighted_return_leaves_flows_out(spark):
    nav = [("A", D(1), 10.0), ("A", D(3), 11.0), ("A", D(5), 11.0)]
    trades = [("A", D(1), "buy", 10.0, 10.0), ("A", D(4), "buy", 10.0, 11.0), ("A", D(9), "buy", 1.0, 1.0)]
    got = portfolio.time_weighted_returns(spark.createDataFrame(trades, TRADE), spark.createDataFrame(nav, NAV)).orderBy("d").collect()
    assert [r["r"] for r in got] == [None, pytest.approx(0.1), pytest.approx(0.0)]


def test_asof_takes_ties_from_the_earlier_row(spark):
    left = spark.createDataFrame([("A", D(2), 1.0), ("A", D(9), 1.0), ("Z", D(2), 1.0)], "k string, d date, x double")
    right = spark.createDataFrame([("A", D(1), 5.0), ("A", D(3), 6.0)], NAV)
    near = {(r["k"], r["d"]): r["matched"] for r in series.asof(left, right, "nav", "nearest").collect()}
    assert near == {("A", D(2)): D(1), ("A", D(9)): D(3), ("Z", D(2)): None}
    ahead = {(r["k"], r["d"]): r["nav"] for r in series.asof(left, right, "nav", "forward").collect()}
    assert ahead == {("A", D(2)): 6.0, ("A", D(9)): None, ("Z", D(2)): None}


TRADES = [(0.10, 100.0, D(1), D(3)), (-0.05, -50.0, D(1), D(3)), (0.20, 200.0, D(1), D(3)), (-0.10, -80.0, D(1), D(3))]


def _stats(spark, rows):
    frame = spark.createDataFrame([("A", *r) for r in rows], "k string, ret double, pnl double, entry_day date, exit_day date")
    return strategies.trade_stats(frame).first()


def test_trade_statistics(spark):
    got = _stats(spark, TRADES)
    want = {"win_rate": 50, "avg_win": 15, "avg_loss": -7.5, "best": 20, "worst": -10, "payoff": 2, "profit_factor": 300 / 130, "expectancy": 42.5, "sqn": 0.6437, "mean_days": 2}
    for name, value in want.items():
        if name != "sqn":
            assert got[name] == pytest.approx(value), name
    pnl = np.array([100, -50, 200, -80.0])
    assert got["sqn"] == pytest.approx(2 * pnl.mean() / pnl.std(ddof=1))


def test_trade_statistics_without_losers_or_variance(spark):
    winners = _stats(spark, [r for r in TRADES if r[1] > 0])
    assert winners["avg_loss"] == 0 and winners["payoff"] == 0 and math.isinf(winners["profit_factor"])
    assert _stats(spark, TRADES[:1])["sqn"] == 0
    assert _stats(spark, [(0.1, 3.0, D(1), D(2))] * 3)["sqn"] == 0
    assert _stats(spark, [(0.1, 3.0, None, None)])["mean_days"] is None


def test_name_filter_is_literal(spark):
    rows = spark.createDataFrame([("Alpha (Growth) Fund",), ("Beta Growth Fund",)], "name string")
    assert [r["name"] for r in screen(rows, Filters(name="("), "2024-01-01").collect()] == ["Alpha (Growth) Fund"]


def test_unknown_values_in_a_screen(spark):
    rows = spark.createDataFrame([("a", None, None, None), ("b", 5.0, 9.0, None), ("c", 5.0, None, 0.1)], "name string, aum double, ter double, cagr_1y double").withColumn("status", F.lit(None).cast("string"))
    names = lambda w: sorted(r["name"] for r in screen(rows, w, "2024-01-01").collect())
    assert names(Filters(aum_min=1)) == ["b", "c"]
    assert names(Filters(ter_max=1)) == ["a", "c"]
    assert names(Filters(has_nav=True)) == ["c"]
    assert names(Filters(only_tracked=True)) == [] and names(Filters(only_untracked=True)) == ["a", "b", "c"]


@pytest.mark.parametrize(("known", "names", "want"), [([], ["x", "y"], {"x": -1, "y": -2}), ([("q", -5)], ["x"], {"x": -6}), ([("Known", 7)], ["Known", "Missing"], {"Known": 7, "Missing": -1}), ([("q", 3)], [], {})])
def test_synthetic_codes(spark, known, names, want):
    out = tables.synthetic_codes(spark.createDataFrame(known, "name string, code long"), spark.createDataFrame(list(enumerate(names)), "place int, name string"))
    assert {r["name"]: r["code"] for r in out.collect()} == want


def test_replace_touches_only_keys_that_came(spark):
    old = spark.createDataFrame([("good", 1), ("good", 2), ("failed", 3)], "k string, v int")
    out = tables.replace_keys(old, spark.createDataFrame([("good", 9)], "k string, v int"), ["k"])
    assert sorted((r["k"], r["v"]) for r in out.collect()) == [("failed", 3), ("good", 9)]
    assert tables.replace_keys(old, old.filter("false"), ["k"]).count() == 3


def test_upserts_are_idempotent_and_keep_old_values(spark):
    old = spark.createDataFrame([(1, "a", "2020"), (2, "b", "2021")], "code int, name string, added string")
    new = spark.createDataFrame([(2, "B", None), (3, "c", "2024")], "code int, name string, added string")
    once = tables.upsert(old, new, ["code"])
    assert sorted(map(tuple, tables.upsert(once, new, ["code"]).collect())) == sorted(map(tuple, once.collect()))
    part = {r["code"]: tuple(r) for r in tables.partial_upsert(old, new, ["code"]).collect()}
    assert part[2] == (2, "B", "2021") and part[3] == (3, "c", "2024") and len(part) == 3


def test_registry_statuses(spark):
    registry = spark.createDataFrame([(1, "pending", None), (2, "available", "pending")], "code long, nav_status string, metadata_status string")
    changes = spark.createDataFrame([(1, "unavailable"), (2, None), (9, "pending")], "code long, nav_status string")
    got = tables.with_statuses(registry, changes, "code")
    assert sorted(map(tuple, got.collect())) == [(1, "unavailable", None, True), (2, "available", "pending", True)]
    assert [r["code"] for r in got.filter(tables.any_status("unavailable", "nav_status", "metadata_status")).collect()] == [1]
    funds = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    rows = spark.sql("SELECT * FROM VALUES ('a', DATE '2024-01-01'), ('a', DATE '2024-01-09'), ('b', DATE '2023-01-01') AS t(k, d)")
    ages = {r["k"]: (r["records"], r["days_old"], r["status"]) for r in tables.freshness(funds, rows, "k", "d", "2024-01-10", 1).collect()}
    assert ages == {"a": (2, 1, "Fresh"), "b": (1, 374, "Stale"), "c": (0, None, "Missing")}


def test_unique_matches_leave_ambiguous_ones_out(spark):
    left = spark.createDataFrame([("a",), ("b",)], "s string")
    right = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "s string, code int")
    assert [(r["s"], r["code"]) for r in tables.unique_matches(left, right, ["s"], "code").collect()] == [("a", 1)]


def test_overlap_is_capped(spark):
    rows = spark.createDataFrame([("A", D(1), "x", 70.0), ("A", D(1), "y", 60.0), ("B", D(1), "x", 30.0), ("B", D(1), "z", 10.0)], "k string, month date, instrument string, weight double")
    assert {(r["a"], r["b"]): r["overlap"] for r in holdings.overlap(rows).collect()} == {("A", "A"): 100.0, ("A", "B"): 30.0, ("B", "B"): 40.0}


def test_latest_takes_a_missing_day_as_last(spark):
    rows = spark.createDataFrame([("A", D(1), 1), ("A", None, 2), ("B", D(1), 3), ("B", D(2), 4)], "k string, month date, v int")
    assert sorted(r["v"] for r in holdings.latest(rows).collect()) == [2, 4]


def test_glitches_and_scale_breaks(spark):
    steady = [10.0 + i / 100 for i in range(400)]
    values = steady[:100] + [31.0] + steady[101:200] + [10 * v for v in steady[200:]]
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=i)
    nav = spark.createDataFrame([("A", day(i), v) for i, v in enumerate(values)], NAV)
    assert [r["d"] for r in quality.glitches(nav).collect()] == [day(100)]
    fixed = quality.rescaled(quality.without_glitches(nav)).orderBy("d").collect()
    assert [r["nav"] for r in fixed] == pytest.approx([10 * v for i, v in enumerate(steady) if i != 100])
    splits = {"down": [10 * v for v in steady[:200]] + steady[200:], "short": [1.0] * 10 + [10.0] * 10, "A Segregated Fund": values, "wild": [v * 10 ** (i // 200) * (1 + i / 100) for i, v in enumerate(steady)]}
    rows = spark.createDataFrame([(k, day(i), v) for k, vs in splits.items() for i, v in enumerate(vs)], NAV)
    assert {r["k"] for r in quality.scale_breaks(rows).collect()} == {"wild"}
    assert {(r["k"], r["d"], r["nav"]) for r in quality.rescaled(rows).collect()} == {(r["k"], r["d"], r["nav"]) for r in rows.collect()}


def test_metrics_need_a_year_and_share_one_exchange(spark):
    rng = np.random.default_rng(0)
    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(253)]
    walk = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 253)))
    rows = [("long", d, float(v)) for d, v in zip(days, walk, strict=True)] + [("short", d, 1.0) for d in days[:251]] + [("year", d, float(v)) for d, v in zip(days[:252], walk, strict=False)]
    out = metrics.scheme_metrics(spark.createDataFrame(rows, NAV).repartition(3))
    got = {r["k"]: r for r in out.collect()}
    assert set(got) == {"long", "year"}
    assert got["year"]["cagr_1y"] is None and got["long"]["cagr_1y"] == pytest.approx(walk[-1] / walk[0] - 1)
    r = walk[1:] / walk[:-1] - 1
    assert got["long"]["vol_1y"] == pytest.approx(r.std(ddof=1) * 252**0.5)
    path = np.r_[1.0, np.cumprod(1 + r)]
    assert got["long"]["max_dd_1y"] == pytest.approx((path / np.maximum.accumulate(path) - 1).min())
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1


def test_business_days(spark):
    pairs = [("2024-01-05", "2024-01-08"), ("2024-01-06", "2024-01-08"), ("2024-01-08", "2024-01-05"), ("2024-01-05", "2024-01-05"), ("2023-12-31", "2024-03-01")]
    rows = spark.createDataFrame([(dt.date.fromisoformat(a), dt.date.fromisoformat(b)) for a, b in pairs], "a date, b date")
    got = [r["n"] for r in rows.select(dates.business_days("a", "b").alias("n")).collect()]
    assert got == [int(np.busday_count(a, b)) for a, b in pairs]


def test_dates_and_numbers_that_do_not_fit_are_null(spark):
    rows = spark.createDataFrame([("31-12-2024",), ("01-Jan-2024",), ("05/02/2024",), ("07 Mar 2024",), ("soon",), (None,)], "x string")
    got = [r["d"] for r in rows.select(dates.parsed_date("x").alias("d")).collect()]
    assert got == [dt.date(2024, 12, 31), dt.date(2024, 1, 1), dt.date(2024, 2, 5), dt.date(2024, 3, 7), None, None]
    numbers = spark.createDataFrame([("₹ 1,777 Cr.",), ("15%",), ("-",), (None,)], "x string")
    assert [r["n"] for r in numbers.select(text.parsed_number("x").alias("n")).collect()] == [1777.0, 15.0, None, None]


def test_names(spark):
    names = ["Alpha Fund - Direct Plan - Growth", "Direct", "Beta (G) Fund", "Gamma Fund Regular IDCW Payout", "Kappa Growth Opportunities Fund", "Delta Fund (Regular Plan)Growth Option", "Eta Fund - Income Distribution cum Capital Withdrawal"]
    rows = spark.createDataFrame([(n,) for n in names], "name string").select(text.short_name("name").alias("s"), text.plan_of("name").alias("p"), text.option_of("name").alias("o"), text.slug("name").alias("g")).collect()
    assert [r["s"] for r in rows] == ["Alpha Fund", "Direct", "Beta (G) Fund", "Gamma Fund", "Kappa Growth Opportunities Fund", "Delta Fund", "Eta Fund - Income Distribution cum Capital Withdrawal"]
    assert [r["p"] for r in rows] == ["Direct", "Direct", None, "Regular", None, "Regular", None]
    assert [r["o"] for r in rows] == ["Growth", "Other", "Other", "IDCW", "Other", "Growth", "IDCW"]
    assert rows[0]["g"] == "alpha-fund-direct-plan-growth" and rows[2]["g"] == "beta-g-fund"


def test_options_of_names_that_end_in_brackets_or_dots(spark):
    want = {"X Fund - Growth.": "Growth", "X Fund (Regular - Growth)": "Growth", "X Growth Fund": "Other", "X-growth - Direct": "Growth", "X Fund Growth  Plan B": "Growth", "X IDCWOption": "IDCW", "X Income  Distribution": "IDCW", "X Growthy": "Other", "Cumulative X": "Growth", "X ETF Bonus": "Bonus", "My ETF": "ETF", "dividends": "Other", "": "Other"}
    rows = spark.createDataFrame([(n,) for n in want], "name string").select("name", text.option_of("name").alias("o"))
    assert {r["name"]: r["o"] for r in rows.collect()} == want


def test_slugs_of_dashes(spark):
    want = {"A -- B": "a--b", "A - B": "a-b", "-A- (B)": "a-b", " x  Y ": "x-y", "-": ""}
    rows = spark.createDataFrame([(n,) for n in want], "name string").select("name", text.slug("name").alias("g"))
    assert {r["name"]: r["g"] for r in rows.collect()} == want


def test_symbols_of_benchmarks(spark):
    want = {"NIFTY 500 TRI": "^CRSLDX", "Nifty 50 - Total Return Index": "^NSEI", "NIFTY Midcap 150 Index (PRI)": "NIFTY_MIDCAP_150.NS", "S&P BSE Sensex": "^BSESN", "Price Return NIFTY IT": "^CNXIT", "Nifty indexes": None, "": None, None: None}
    rows = spark.createDataFrame([(n,) for n in want], "name string").select("name", text.benchmark_symbol("name").alias("s"))
    assert {r["name"]: r["s"] for r in rows.collect()} == want


def test_stems_of_one_scheme_are_equal(spark):
    same = ["Zeta Arbitrage Fund - Regular Plan - Growth Option", "Zeta Arbitrage Fund - Regular - Growth", "Zeta Arbitrage Fund - Direct Growth", "Zeta Arbitrage Fund(Regular Plan)Growth Option", "Zeta Arbitrage Fund Half Yearly Payout", "Zeta Arbitrage Fund (Institutional II) - HALFYEARLY Dividend Option", "zeta arbitrage_fund Annual"]
    got = {r["s"] for r in spark.createDataFrame([(n,) for n in same], "name string").select(text.stem("name").alias("s")).collect()}
    assert got == {"zetaarbitragefund"}


def test_alpha_class_of_missing_and_nan(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 0.5), (-1.0, 2.0), (-1.0, 0.5), (None, 1.0), (float("nan"), 1.0)], "a double, b double")
    got = [r["c"] for r in rows.select(text.alpha_class("a", "b").alias("c")).collect()]
    assert got[-2:] == ["unknown", "unknown"] and len(set(got)) == 5


@pytest.fixture(scope="module")
def bars():
    rng = np.random.default_rng(4)
    close = 50 + np.cumsum(rng.normal(0, 1, 160))
    return {"open": close, "high": close + rng.random(160), "low": close - rng.random(160), "close": close, "volume": rng.integers(1, 9, 160).astype(float)}


def test_plain_indicators_by_hand(bars):
    x = bars["close"]
    want = x[:12].mean()
    for v in x[12:]:
        want += 2 / 13 * (v - want)
    assert plain.ema(x, 12)[-1] == pytest.approx(want) and np.isnan(plain.ema(x, 12)[10])
    gain, loss = np.maximum(np.diff(x), 0), np.maximum(-np.diff(x), 0)
    g, lo = gain[:14].mean(), loss[:14].mean()
    for a, b in zip(gain[14:], loss[14:], strict=True):
        g, lo = (g * 13 + a) / 14, (lo * 13 + b) / 14
    assert plain.rsi(x)[-1] == pytest.approx(100 * g / (g + lo))
    assert np.flatnonzero(~np.isnan(plain.rsi(x)))[0] == 14
    assert np.flatnonzero(~np.isnan(plain.macd(x)["macd"]))[0] == 33


def test_scanned_indicators_equal_the_plain_ones(spark, bars):
    """Two series of other lengths, and one without any range, by scans over blocks of a quarter."""
    flat = {c: np.full(60, 5.0) for c in bars}
    short = {c: v[:50] for c, v in bars.items()}
    data = [(k, dt.date(2023, 1, 2) + dt.timedelta(days=2 * i), *(float(b[c][i]) for c in bars)) for k, b in (("a", bars), ("b", short), ("c", flat)) for i in range(len(b["close"]))]
    rows = spark.createDataFrame(data, "k string, d date, " + ", ".join(f"{c} double" for c in bars)).repartition(5)
    out = indicators.compute(rows, list(scanned.SCANNED)).orderBy("k", "d").toPandas()
    for k, b in (("a", bars), ("b", short), ("c", flat)):
        mine = out[out["k"] == k]
        for name, f in plain.PLAIN.items():
            for column, want in f(b).items():
                assert column in scanned.SCANNED[name][0]
                if k != "c" or name not in ("adx",):
                    np.testing.assert_allclose(mine[column].to_numpy(float), want, rtol=1e-8, atol=1e-9, err_msg=f"{k} {column}")


def test_recursive_indicators(bars):
    for name, (columns, f) in recursive.RECURSIVE.items():
        out = f(bars)
        assert set(out) == set(columns), name
        assert all(len(v) == 160 for v in out.values())
        short = f({k: v[:3] for k, v in bars.items()})
        assert all(len(v) == 3 for v in short.values())


def test_indicators_skip_unknown_names_and_stay_native(spark, bars):
    rows = spark.createDataFrame([("A", D(1) + dt.timedelta(i), *(float(bars[c][i]) for c in bars)) for i in range(160)], "k string, d date, open double, high double, low double, close double, volume double")
    out = indicators.compute(rows, ["sma_20", "no such", "cci", "aroon"])
    assert {"sma_20", "cci", "aroon_up"} <= set(out.columns)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    both = indicators.compute(rows, ["obv", "rsi", *recursive.RECURSIVE]).orderBy("d").collect()
    assert both[-1]["sar"] == pytest.approx(recursive.parabolic(bars)[-1])
    assert both[0]["obv"] == bars["volume"][0] and both[0]["rsi"] is None


def test_backtest_by_hand(spark):
    closes, entry, leave = [10.0, 11.0, 9.0, 12.0, 8.0], [True, True, False, True, False], [False, False, True, False, False]
    rows = spark.createDataFrame([("A", D(i + 1), c, e, x) for i, (c, e, x) in enumerate(zip(closes, entry, leave, strict=True))], "k string, d date, close double, entry boolean, exit boolean")
    got = strategies.backtest(rows).orderBy("entry_day").collect()
    size = 100_000 / (10.01 * 1.001)
    cash = size * 9 * 0.999 * 0.999
    assert got[0]["size"] == pytest.approx(size) and got[0]["pnl"] == pytest.approx(cash - 100_000)
    assert [r["status"] for r in got] == ["Closed", "Open"] and got[1]["exit_day"] == D(5)
    stopped = strategies.backtest(rows, stop=0.1, trailing=True).orderBy("entry_day").collect()
    assert [r["exit_day"] for r in stopped] == [D(3), D(5)] and stopped[1]["status"] == "Closed"
    curve = strategies.equity_curve(rows).orderBy("d").collect()
    assert curve[0]["hold"] == 100_000 and curve[2]["equity"] == pytest.approx(cash)


def test_cluster_order_puts_like_with_like():
    distance = np.array([[0, 9, 1, 9], [9, 0, 9, 2], [1, 9, 0, 9], [9, 2, 9, 0.0]])
    assert cluster.leaf_order(distance) == [0, 2, 1, 3]
