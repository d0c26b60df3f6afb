"""Plain versions of the smoothed indicators, one series at a time, for the tests."""

import numpy as np
import pandas as pd

Bars = dict[str, np.ndarray]


def smoothed(x: np.ndarray, n: int, alpha: float) -> np.ndarray:
    """Exponential smoothing that starts with the mean of the first n values; leading NaN are passed over."""
    out = np.full(len(x), np.nan)
    start = int(np.argmax(~np.isnan(x))) if (~np.isnan(x)).any() else len(x)
    if len(x) - start < n:
        return out
    out[start + n - 1] = value = x[start : start + n].mean()
    for i in range(start + n, len(x)):
        out[i] = value = value + alpha * (x[i] - value)
    return out


def ema(x: np.ndarray, n: int) -> np.ndarray:
    return smoothed(x, n, 2 / (n + 1))


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    return smoothed(x, n, 1 / n)


def _change(x: np.ndarray) -> np.ndarray:
    return np.r_[np.nan, np.diff(x)]


def true_range(b: Bars) -> np.ndarray:
    before = np.r_[np.nan, b["close"][:-1]]
    return np.maximum(b["high"] - b["low"], np.maximum(abs(b["high"] - before), abs(b["low"] - before)))


def kama(x: np.ndarray, n: int = 30) -> np.ndarray:
    out = np.full(len(x), np.nan)
    if len(x) <= n:
        return out
    steps, value = np.abs(np.diff(x)), x[n - 1]
    for i in range(n, len(x)):
        path = steps[i - n : i].sum()
        ratio = abs(x[i] - x[i - n]) / path if path else 1.0
        out[i] = value = value + (ratio * (2 / 3 - 2 / 31) + 2 / 31) ** 2 * (x[i] - value)
    return out


def directional(b: Bars, n: int = 14) -> dict[str, np.ndarray]:
    up, down = _change(b["high"]), -_change(b["low"])
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    plus[0] = minus[0] = np.nan
    sums = [wilder(x, n) for x in (plus, minus, true_range(b))]
    p, m = (100 * np.divide(x, sums[2], out=np.full(len(x), np.nan), where=sums[2] != 0) for x in sums[:2])
    total = p + m
    dx = 100 * np.divide(abs(p - m), total, out=np.where(np.isnan(total), np.nan, 0.0), where=total > 0)
    return {"adx": wilder(dx, n), "plus_di": p, "minus_di": m}


def rsi(x: np.ndarray, n: int = 14) -> np.ndarray:
    change = _change(x)
    gain, loss = wilder(np.where(np.isnan(change), np.nan, np.maximum(change, 0)), n), wilder(np.where(np.isnan(change), np.nan, np.maximum(-change, 0)), n)
    total = gain + loss
    return np.where(np.isnan(total), np.nan, 100 * np.divide(gain, total, out=np.zeros(len(x)), where=total > 0))


def macd(x: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> dict[str, np.ndarray]:
    quick = np.full(len(x), np.nan)
    quick[slow - fast :] = ema(x[slow - fast :], fast)  # both averages begin at the slow one's first row
    line = quick - ema(x, slow)
    mean = ema(line, signal)
    line = np.where(np.isnan(mean), np.nan, line)
    return {"macd": line, "macd_signal": mean, "macd_hist": line - mean}


def stochastic_rsi(x: np.ndarray, n: int = 14, rows: int = 5) -> dict[str, np.ndarray]:
    r = pd.Series(rsi(x, n))
    low, high = r.rolling(rows).min(), r.rolling(rows).max()
    fast = (100 * (r - low) / (high - low).replace(0, np.nan)).where((high > low) | high.isna(), 0.0)
    return {"stochrsi_k": fast.to_numpy(), "stochrsi_d": fast.rolling(3).mean().to_numpy()}


def chaikin_oscillator(b: Bars) -> np.ndarray:
    width = b["high"] - b["low"]
    place = np.divide((b["close"] - b["low"]) - (b["high"] - b["close"]), width, out=np.zeros(len(width)), where=width > 0)
    total = np.cumsum(place * b["volume"])
    out = [pd.Series(total).ewm(span=n, adjust=False).mean().to_numpy() for n in (3, 10)]
    return np.where(np.arange(len(total)) >= 9, out[0] - out[1], np.nan)


def _keltner(b: Bars) -> dict[str, np.ndarray]:
    middle, width = ema(b["close"], 20), 1.5 * wilder(true_range(b), 20)
    return {"kc_upper": middle + width, "kc_middle": middle, "kc_lower": middle - width}


def _chain(x: np.ndarray, n: int, times: int) -> list[np.ndarray]:
    out = []
    for _ in range(times):
        x = ema(x, n)
        out.append(x)
    return out


def _dema(x: np.ndarray) -> np.ndarray:
    e = _chain(x, 20, 2)
    return 2 * e[0] - e[1]


def _tema(x: np.ndarray) -> np.ndarray:
    e = _chain(x, 20, 3)
    return 3 * e[0] - 3 * e[1] + e[2]


def _trix(x: np.ndarray) -> np.ndarray:
    e = _chain(x, 15, 3)[2]
    return np.r_[np.nan, 100 * (e[1:] / e[:-1] - 1)]


PLAIN = {
    "ema_12": lambda b: {"ema_12": ema(b["close"], 12)},
    "ema_26": lambda b: {"ema_26": ema(b["close"], 26)},
    "dema": lambda b: {"dema": _dema(b["close"])},
    "tema": lambda b: {"tema": _tema(b["close"])},
    "kama": lambda b: {"kama": kama(b["close"])},
    "keltner": _keltner,
    "rsi": lambda b: {"rsi": rsi(b["close"])},
    "macd": lambda b: macd(b["close"]),
    "atr": lambda b: {"atr": wilder(true_range(b), 14)},
    "natr": lambda b: {"natr": 100 * wilder(true_range(b), 14) / b["close"]},
    "stochrsi": lambda b: stochastic_rsi(b["close"]),
    "adx": directional,
    "chaikin_osc": lambda b: {"adosc": chaikin_oscillator(b)},
    "trix": lambda b: {"trix": _trix(b["close"])},
}
