"""Order of a correlation matrix's rows by hierarchical clustering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Most names in a matrix; it is clustered in one task, so its size is bounded.
MOST = 2_000


def leaf_order(distance: np.ndarray) -> list[int]:
    """Leaves in the order of a tree of average linkage; the child with the smaller cluster number comes first."""
    members = {i: [i] for i in range(len(distance))}
    d = {(i, j): distance[i, j] for i in members for j in members if i < j}
    new = len(distance)
    while len(members) > 1:
        a, b = min(d, key=lambda p: (d[p], p))
        na, nb = len(members[a]), len(members[b])
        for c in members:
            if c not in (a, b):
                d[c, new] = (na * d[min(a, c), max(a, c)] + nb * d[min(b, c), max(b, c)]) / (na + nb)
        members[new] = members.pop(a) + members.pop(b)
        d = {p: v for p, v in d.items() if a not in p and b not in p}
        new += 1
    return next(iter(members.values()), [])


def cluster_order(pairs: DataFrame) -> DataFrame:
    """place, name of pairs(a, b, corr), with the distance sqrt(2 (1 - |corr|))."""
    if pairs.select("a").distinct().count() > MOST:
        raise ValueError(f"more than {MOST} names")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        matrix = pdf.pivot(index="a", columns="b", values="corr").sort_index().sort_index(axis=1).fillna(0)
        distance = np.sqrt(2 * np.clip(1 - np.abs(matrix.to_numpy()), 0, None))
        return pd.DataFrame([(p, matrix.index[i]) for p, i in enumerate(leaf_order(distance))], columns=["place", "name"])

    return pairs.groupBy().applyInPandas(run, "place long, name string")
