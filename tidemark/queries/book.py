"""A page of registered queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stem_sql(name: str) -> str:
    """The stem of a name by its words, as SURVEY has the rule; braces are doubled, as the text is formatted once more."""
    gone = "direct regular retail institutional wholesale growth idcw dividend bonus reinvestment payout option plan daily fortnightly monthly quarterly halfyearly annual"
    bare = f"regexp_replace(regexp_replace(lower({name}), '[(]\\s*(direct|regular|retail|institutional|wholesale)[^)]*[)]', ' ', 'g'), '\\bhalf\\s+yearly\\b', 'halfyearly', 'g')"
    return f"regexp_replace(array_to_string(list_filter(string_split_regex({bare}, '[^a-z0-9_]+'), lambda w: NOT list_contains(string_split('{gone}', ' '), w)), ''), '[^a-z0-9]+', '', 'g')"


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, dates: str = ""):
        """Registers the decorated function of (spark, sf_dir).

        Columns named in ``dates`` are given as ISO text by both sides, as
        clients read dates as different types.
        """

        def register(query):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return query(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in dates.split()})

            self.queries[name] = run
            if sql is not None:
                shown = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates.split())
                self.oracles[name] = f"SELECT * REPLACE ({shown}) FROM ({sql})" if shown else sql
            return query

        return register
