"""Indicators whose state no scan expresses: the parabolic stop, which turns on its own values, and the homodyne cycle.

Arrow grouped maps, one series a group.  Each function takes a series' columns as
float arrays in order of day and gives {column: values}, NaN before its warm-up;
NaN leaves as NULL.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Bars = dict[str, np.ndarray]


def parabolic(b: Bars, step: float = 0.02, most: float = 0.2) -> np.ndarray:
    high, low = b["high"], b["low"]
    out = np.full(len(high), np.nan)
    if len(high) < 2:
        return out
    up = not (low[0] - low[1] > max(high[1] - high[0], 0))
    stop, extreme, speed = (low[0], high[1], step) if up else (high[0], low[1], step)
    for i in range(1, len(high)):
        turned = low[i] <= stop if up else high[i] >= stop
        if turned:
            up = not up
            stop = max(extreme, high[i], high[i - 1]) if not up else min(extreme, low[i], low[i - 1])
            out[i], extreme, speed = stop, (low[i] if not up else high[i]), step
        else:
            out[i] = stop
            if (high[i] > extreme) if up else (low[i] < extreme):
                extreme, speed = (high[i] if up else low[i]), min(most, speed + step)
        stop += speed * (extreme - stop)
        stop = min(stop, low[i], low[i - 1]) if up else max(stop, high[i], high[i - 1])
    return out


def hilbert(x: np.ndarray) -> dict[str, np.ndarray]:
    """Dominant cycle by the homodyne discriminator: period, phase, sine and lead sine, trend line and trend mode."""
    n = len(x)
    names = ("ht_trendline", "ht_dcphase", "ht_dcperiod", "ht_sine", "ht_leadsine", "ht_trendmode")
    out = {name: np.full(n, np.nan) for name in names}
    smooth, detrend, q1, i1 = (np.zeros(n) for _ in range(4))
    i2 = q2 = re = im = 0.0
    period = shown = 0.0
    days, line = 0, np.zeros(n)

    def taps(v: np.ndarray, i: int) -> float:
        return (0.0962 * v[i] + 0.5769 * v[i - 2] - 0.5769 * v[i - 4] - 0.0962 * v[i - 6]) * (0.075 * period + 0.54)

    before = (0.0, 0.0)
    for i in range(6, n):
        smooth[i] = (4 * x[i] + 3 * x[i - 1] + 2 * x[i - 2] + x[i - 3]) / 10
        detrend[i] = taps(smooth, i)
        q1[i], i1[i] = taps(detrend, i), detrend[i - 3]
        ni, nq = i1[i] - taps(q1, i), q1[i] + taps(i1, i)
        oi, oq = i2, q2
        i2, q2 = 0.2 * ni + 0.8 * i2, 0.2 * nq + 0.8 * q2
        re, im = 0.2 * (i2 * oi + q2 * oq) + 0.8 * re, 0.2 * (i2 * oq - q2 * oi) + 0.8 * im
        last = period
        if re and im:
            period = 2 * np.pi / np.arctan(im / re)
        period = min(max(period, 0.67 * last, 6.0), max(1.5 * last, 6.0), 50.0)
        period = 0.2 * period + 0.8 * last
        shown = 0.33 * period + 0.67 * shown
        if i >= 32:
            out["ht_dcperiod"][i] = shown
        span = max(1, int(shown + 0.5))
        line[i] = x[max(0, i - span + 1) : i + 1].mean()
        if i < 63:
            continue
        angle = 2 * np.pi * np.arange(span) / span
        part = smooth[i - np.arange(span)]
        real, imaginary = (part * np.sin(angle)).sum(), (part * np.cos(angle)).sum()
        phase = np.degrees(np.arctan2(real, imaginary)) + 90 + 360 / max(shown, 1e-9)
        phase = phase - 360 if phase > 315 else phase
        sine, lead = np.sin(np.radians(phase)), np.sin(np.radians(phase + 45))
        out["ht_dcphase"][i], out["ht_sine"][i], out["ht_leadsine"][i] = phase, sine, lead
        trend = (4 * line[i] + 3 * line[i - 1] + 2 * line[i - 2] + line[i - 3]) / 10
        out["ht_trendline"][i] = trend
        crossed = (sine > lead) != (before[0] > before[1])
        days = 0 if crossed else days + 1
        mode = days >= 0.5 * shown or (trend and abs((smooth[i] - trend) / trend) >= 0.015)
        out["ht_trendmode"][i] = float(mode)
        before = (sine, lead)
    return out


RECURSIVE: dict[str, tuple[tuple[str, ...], Callable[[Bars], dict[str, np.ndarray]]]] = {
    "parabolic_sar": (("sar",), lambda b: {"sar": parabolic(b)}),
    "hilbert": (("ht_trendline", "ht_dcphase", "ht_dcperiod", "ht_sine", "ht_leadsine", "ht_trendmode"), lambda b: hilbert(b["close"])),
}


def add_recursive(bars: DataFrame, wanted: list[str]) -> DataFrame:
    """One grouped map a call, whatever the number of indicators; a group is one key's days."""
    if not wanted:
        return bars
    columns = [c for name in wanted for c in RECURSIVE[name][0]]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d").reset_index(drop=True)
        series = {c: pdf[c].to_numpy(float) for c in ("open", "high", "low", "close", "volume")}
        for name in wanted:
            pdf = pdf.assign(**RECURSIVE[name][1](series))
        return pdf

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema.fields] + [f"{c} double" for c in columns]
    return bars.groupBy("k").applyInPandas(run, ", ".join(fields))
