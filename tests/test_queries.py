"""Every registered market query against its SQL twin on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from tidemark import queries

FOLDER = os.environ.get("TIDEMARK_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def rows(frame: pd.DataFrame) -> list[list]:
    """Plain values of the rows, sorted by columns of names in order; numbers sort by their first four decimals, then in full."""
    plain = lambda x: None if pd.isna(x) else float(x) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    out = [[plain(x) for x in row] for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None)]
    short = lambda row: repr([round(x, 4) + 0.0 if isinstance(x, float) else x for x in row])
    return sorted(out, key=lambda row: (short(row), repr(row)))


def alike(a, b) -> bool:
    """Equal, or numbers within a millionth or the last of six decimals, to which many columns are rounded."""
    return math.isclose(a, b, rel_tol=1e-6, abs_tol=1.01e-6) if isinstance(a, float) and isinstance(b, float) else a == b


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_matches_its_sql(spark, sql, name):
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    if name in queries.ORACLES:
        want = sql.execute(queries.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        got, want = rows(got), rows(want)
        assert len(got) == len(want)
        assert [pair for pair in zip(got, want, strict=True) if not all(map(alike, *pair))] == []


def test_entry_module_lists_every_query(spark):
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[0] == "k"
