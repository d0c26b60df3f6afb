"""Technical indicators on bars (k, d, open, high, low, close, volume).

``WINDOWED`` holds those that are window expressions, ``SCANNED`` those that are
scans of linear recurrences, ``RECURSIVE`` those whose rows depend on earlier
results in other ways; ``compute`` adds the wanted ones of all three.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.indicators.recursive import RECURSIVE, add_recursive
from tidemark.indicators.scanned import SCANNED, add_scanned
from tidemark.indicators.windowed import WINDOWED, add_windowed

__all__ = ["RECURSIVE", "SCANNED", "WINDOWED", "compute"]


def compute(bars: DataFrame, wanted: list[str]) -> DataFrame:
    """bars with the columns of the wanted indicators; unknown names are skipped."""
    rows = add_windowed(bars, [n for n in wanted if n in WINDOWED])
    rows = add_scanned(rows, [n for n in wanted if n in SCANNED])
    return add_recursive(rows, [n for n in wanted if n in RECURSIVE])
