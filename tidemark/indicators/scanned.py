"""Indicators by exponential smoothing, as scans of linear recurrences.

A smoothing over n values starts with the mean of the first n and then takes a
share of each new value; missing values are passed over.  Smoothings that build on one another are scanned level by level; those of
a level share one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidemark.operators.recurrence import linear
from tidemark.operators.series import last_rows, ordered

#: Smoothings by level: name to (smoothed column, values of the start, share of a new value).
LEVELS: tuple[dict[str, tuple[str, int, float]], ...] = (
    {
        "ema_12": ("close", 12, 2 / 13), "ema_26": ("close", 26, 2 / 27), "_e20": ("close", 20, 2 / 21), "_e15": ("close", 15, 2 / 16), "_quick": ("_late", 12, 2 / 13),
        "_tr14": ("_tr", 14, 1 / 14), "_tr20": ("_tr", 20, 1 / 20), "_gain": ("_up", 14, 1 / 14), "_loss": ("_down", 14, 1 / 14), "_plus": ("_plus_dm", 14, 1 / 14), "_minus": ("_minus_dm", 14, 1 / 14),
    },
    {"_e20b": ("_e20", 20, 2 / 21), "_e15b": ("_e15", 15, 2 / 16), "_signal": ("_line", 9, 2 / 10), "_adx": ("_dx", 14, 1 / 14)},
    {"_e20c": ("_e20b", 20, 2 / 21), "_e15c": ("_e15b", 15, 2 / 16)},
)

#: Indicator to its columns and the smoothings that it needs; "_kama" and "_fast", "_slow" are scans of their own.
SCANNED: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "ema_12": (("ema_12",), ("ema_12",)),
    "ema_26": (("ema_26",), ("ema_26",)),
    "dema": (("dema",), ("_e20", "_e20b")),
    "tema": (("tema",), ("_e20", "_e20b", "_e20c")),
    "kama": (("kama",), ("_kama",)),
    "keltner": (("kc_upper", "kc_middle", "kc_lower"), ("_e20", "_tr20")),
    "rsi": (("rsi",), ("_gain", "_loss")),
    "macd": (("macd", "macd_signal", "macd_hist"), ("_quick", "ema_26", "_signal")),
    "atr": (("atr",), ("_tr14",)),
    "natr": (("natr",), ("_tr14",)),
    "stochrsi": (("stochrsi_k", "stochrsi_d"), ("_gain", "_loss")),
    "adx": (("adx", "plus_di", "minus_di"), ("_plus", "_minus", "_tr14", "_adx")),
    "chaikin_osc": (("adosc",), ("_fast", "_slow")),
    "trix": (("trix",), ("_e15", "_e15b", "_e15c")),
}


def _sofar() -> WindowSpec:
    return ordered().rowsBetween(Window.unboundedPreceding, 0)


def smoothing(value: str, n: int, share: float) -> tuple[Column, Column]:
    """(a, b) of a smoothing: nothing before the n-th value, their mean there, and a share of each value from then on."""
    seen, has = F.count(value).over(_sofar()), F.col(value).isNotNull()
    mean = F.avg(value).over(_sofar())
    return F.when(has & (seen > n), 1 - share).otherwise(1.0), F.when(has & (seen > n), share * F.col(value)).when(has & (seen == n), mean).otherwise(0.0)


def _based(bars: DataFrame) -> DataFrame:
    """bars with the columns that the first level smooths."""
    before = lambda c: F.lag(c).over(ordered())
    rows = bars.withColumn("_n", F.row_number().over(ordered())).withColumn("_c0", before("close")).withColumn("_h0", before("high")).withColumn("_l0", before("low"))
    known = F.col("_c0").isNotNull()
    change, up, down = F.col("close") - F.col("_c0"), F.col("high") - F.col("_h0"), F.col("_l0") - F.col("low")
    width = F.col("high") - F.col("low")
    flow = F.when(width > 0, (2 * F.col("close") - F.col("low") - F.col("high")) / width).otherwise(0.0) * F.col("volume")
    return rows.withColumns({
        "_late": F.when(F.col("_n") > 14, F.col("close")),
        "_tr": F.when(known, F.greatest(width, F.abs(F.col("high") - F.col("_c0")), F.abs(F.col("low") - F.col("_c0")))),
        "_up": F.when(known, F.greatest(change, F.lit(0.0))), "_down": F.when(known, F.greatest(-change, F.lit(0.0))),
        "_plus_dm": F.when(known, F.when((up > down) & (up > 0), up).otherwise(0.0)), "_minus_dm": F.when(known, F.when((down > up) & (down > 0), down).otherwise(0.0)),
        "_flow": F.sum(flow).over(_sofar()),
    })


def _own_maps(rows: DataFrame, needs: set[str]) -> tuple[DataFrame, dict[str, tuple[Column, Column]]]:
    """The scans that are no plain smoothing: the adaptive mean, whose share follows the path, and means that begin with the first value."""
    maps = {}
    if "_kama" in needs:
        rows = rows.withColumn("_path", F.sum(F.abs(F.col("close") - F.col("_c0"))).over(last_rows(30)))
        ratio = F.coalesce(F.try_divide(F.abs(F.col("close") - F.lag("close", 30).over(ordered())), F.col("_path")), F.lit(1.0))
        rows = rows.withColumn("_share", F.pow(ratio * (2 / 3 - 2 / 31) + 2 / 31, 2))
        moving = F.col("_n") > 30
        maps["_kama"] = (F.when(moving, 1 - F.col("_share")).otherwise(1.0), F.when(moving, F.col("_share") * F.col("close")).when(F.col("_n") == 30, F.col("close")).otherwise(0.0))
    for name, n in (("_fast", 3), ("_slow", 10)):
        if name in needs:
            maps[name] = (F.lit(1 - 2 / (n + 1)), F.when(F.col("_n") == 1, F.col("_flow")).otherwise(2 / (n + 1) * F.col("_flow")))
    return rows, maps


def _scan(rows: DataFrame, level: dict[str, tuple[str, int, float]], needs: set[str], own: dict | None = None) -> DataFrame:
    wanted = {name: spec for name, spec in level.items() if name in needs}
    maps = {**{name: smoothing(*spec) for name, spec in wanted.items()}, **(own or {})}
    if not maps:
        return rows
    ready = {name: F.count(value).over(_sofar()) >= n for name, (value, n, _) in wanted.items()}
    return linear(rows, maps).withColumns({name: F.when(ready[name], F.col(name)) for name in wanted})


def _share_of(part: Column, whole: Column) -> Column:
    """part as a percentage of whole, 0 where the whole is."""
    return F.when(whole.isNotNull(), F.when(whole > 0, 100 * part / whole).otherwise(0.0))


def add_scanned(bars: DataFrame, wanted: list[str]) -> DataFrame:
    """bars with the columns of the wanted indicators."""
    if not wanted:
        return bars
    needs = {s for name in wanted for s in SCANNED[name][1]}
    rows, own = _own_maps(_based(bars), needs)
    rows = _scan(rows, LEVELS[0], needs, own)
    c = F.col
    if "_signal" in needs:
        rows = rows.withColumn("_line", c("_quick") - c("ema_26"))
    if "_adx" in needs:
        rows = rows.withColumn("plus_di", F.try_divide(100 * c("_plus"), c("_tr14"))).withColumn("minus_di", F.try_divide(100 * c("_minus"), c("_tr14")))
        rows = rows.withColumn("_dx", _share_of(F.abs(c("plus_di") - c("minus_di")), c("plus_di") + c("minus_di")))
    rows = _scan(rows, LEVELS[1], needs)
    rows = _scan(rows, LEVELS[2], needs)
    width = lambda: 1.5 * c("_tr20")
    made = {
        "dema": lambda: {"dema": 2 * c("_e20") - c("_e20b")},
        "tema": lambda: {"tema": 3 * c("_e20") - 3 * c("_e20b") + c("_e20c")},
        "kama": lambda: {"kama": F.when(c("_n") > 30, c("_kama"))},
        "keltner": lambda: {"kc_upper": c("_e20") + width(), "kc_middle": c("_e20"), "kc_lower": c("_e20") - width()},
        "rsi": lambda: {"rsi": _share_of(c("_gain"), c("_gain") + c("_loss"))},
        "macd": lambda: {"macd": F.when(c("_signal").isNotNull(), c("_line")), "macd_signal": c("_signal"), "macd_hist": c("_line") - c("_signal")},
        "atr": lambda: {"atr": c("_tr14")},
        "natr": lambda: {"natr": 100 * c("_tr14") / c("close")},
        "adx": lambda: {"adx": c("_adx")},
        "chaikin_osc": lambda: {"adosc": F.when(c("_n") >= 10, c("_fast") - c("_slow"))},
        "trix": lambda: {"trix": 100 * (F.try_divide(c("_e15c"), F.lag("_e15c").over(ordered())) - 1)},
    }
    rows = rows.withColumns({column: value for name in wanted if name in made for column, value in made[name]().items()})
    if "stochrsi" in wanted:
        rows = rows.withColumn("_rsi", _share_of(c("_gain"), c("_gain") + c("_loss")))
        full = F.count("_rsi").over(last_rows(5)) == 5
        low, high = F.min("_rsi").over(last_rows(5)), F.max("_rsi").over(last_rows(5))
        rows = rows.withColumn("stochrsi_k", F.when(full, F.coalesce(F.try_divide(100 * (c("_rsi") - low), high - low), F.lit(0.0))))
        rows = rows.withColumn("stochrsi_d", F.when(F.count("stochrsi_k").over(last_rows(3)) == 3, F.avg("stochrsi_k").over(last_rows(3))))
    return rows.select(*bars.columns, *dict.fromkeys(x for name in wanted for x in SCANNED[name][0]))
