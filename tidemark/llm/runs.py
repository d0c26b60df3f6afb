"""Counts of one task, kept as sorted runs and merged as they grow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows that a task holds before it merges its runs, and rows after a merge above which it sends them on.
MERGE, SEND = 2_000_000, 1_500_000


class Runs:
    """Rows of integer keys, summed integer values and strings that follow from the keys; memory holds MERGE rows and a slice's."""

    def __init__(self, keys: int, merge: int = MERGE, send: int = SEND):
        self._keys, self._merge, self._send = keys, merge, send
        self._held: list[tuple[list[np.ndarray], pa.Array | None]] = []
        self._rows = 0

    def add(self, columns: list[np.ndarray], names: pa.Array | None = None) -> Iterator[tuple[list[np.ndarray], pa.Array | None]]:
        """Takes a run (keys, then values); gives merged rows when there are too many."""
        self._held.append((columns, names))
        self._rows += len(columns[0])
        if self._rows >= self._merge:
            merged = self._merged()
            if len(merged[0][0]) >= self._send:
                yield merged
                self._held, self._rows = [], 0
            else:
                self._held, self._rows = [merged], len(merged[0][0])

    def rest(self) -> Iterator[tuple[list[np.ndarray], pa.Array | None]]:
        if self._rows:
            yield self._merged()

    def _merged(self) -> tuple[list[np.ndarray], pa.Array | None]:
        if len(self._held) == 1:
            return self._held[0]
        columns = [np.concatenate(c) for c in zip(*(x[0] for x in self._held), strict=True)]
        keys = columns[: self._keys]
        order = np.lexsort(keys[::-1])
        keys = [k[order] for k in keys]
        first = np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
        sums = [np.add.reduceat(v[order], first) for v in columns[self._keys :]]
        names = None if self._held[0][1] is None else pa.concat_arrays([x[1] for x in self._held]).take(pa.array(order[first]))
        return [k[first] for k in keys] + sums, names
