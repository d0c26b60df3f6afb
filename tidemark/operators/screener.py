"""The screener view and its filters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import matches_tokens, option_of, plan_of


def star(scheme: DataFrame, dims: list[tuple[DataFrame, str]]) -> DataFrame:
    """scheme with dimensions joined from the left, each one row a key; Catalyst broadcasts those that are small."""
    for dim, key in dims:
        scheme = scheme.join(dim, key, "left")
    return scheme


@dataclass
class Filters:
    """What a screen asks for; an empty list, text or 0 asks for nothing."""

    name: str = ""
    houses: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    plans: list[str] = field(default_factory=list)
    options: list[str] = field(default_factory=list)
    aum_min: float = 0
    ter_max: float = 5.0
    only_tracked: bool = False
    only_untracked: bool = False
    has_nav: bool = False
    cagr_min: float = 0
    sharpe_min: float = 0
    dd_min: float = 0
    years: float = 0


def screen(rows: DataFrame, wanted: Filters, today: str) -> DataFrame:
    """Rows that meet all filters: unknown assets count as 0, unknown expenses as 0, unknown inception as too young."""
    out = rows.withColumn("plan", plan_of("name")).withColumn("option", option_of("name"))
    if wanted.name:
        out = out.filter(matches_tokens(F.col("name"), wanted.name))
    for column, values in (("house", wanted.houses), ("category", wanted.categories), ("plan", wanted.plans), ("option", wanted.options)):
        if values:
            out = out.filter(F.col(column).isin(values))
    if wanted.aum_min > 0:
        out = out.filter(F.coalesce("aum", F.lit(0.0)) >= wanted.aum_min)
    if wanted.ter_max < 5.0:
        out = out.filter(F.coalesce("ter", F.lit(0.0)) <= wanted.ter_max)
    if wanted.only_tracked != wanted.only_untracked:
        out = out.filter(F.col("status").isNotNull() if wanted.only_tracked else F.col("status").isNull())
    if wanted.has_nav:
        out = out.filter("cagr_1y is not null")
        for column, least, scale in (("cagr_1y", wanted.cagr_min, 100), ("sharpe_1y", wanted.sharpe_min, 1), ("max_dd_1y", wanted.dd_min, 100)):
            if least:
                out = out.filter(F.col(column) * scale >= least)
    if wanted.years > 0:
        out = out.filter(F.col("inception_date") <= F.date_sub(F.lit(today).cast("date"), round(wanted.years * 365.25)))
    return out
