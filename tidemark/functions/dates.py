"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The date forms that feeds use, tried in order.
FORMS = ("dd-MM-yyyy", "dd-MMM-yyyy", "dd/MM/yyyy", "dd MMM yyyy")


def week_end(day: str) -> Column:
    """The Sunday that ends the day's week."""
    return F.next_day(F.date_sub(F.col(day), 1), "SU")


def month_start(day: str) -> Column:
    return F.trunc(F.col(day), "MM")


def parsed_date(text: str) -> Column:
    """The first of FORMS that fits, else NULL."""
    return F.coalesce(*(F.try_to_timestamp(F.trim(F.col(text)), F.lit(f)).cast("date") for f in FORMS))


def quarter_end(label: str) -> Column:
    """'Mar 2026' to the month's last day."""
    return F.last_day(F.try_to_timestamp(F.trim(F.col(label)), F.lit("MMM yyyy")).cast("date"))


def business_days(begin: str, end: str) -> Column:
    """Mondays to Fridays in [begin, end): by whole weeks and the rest, negative when reversed."""

    def until(day: Column) -> Column:  # weekdays from Monday 1970-01-05 to a day, exclusive
        n = F.datediff(day, F.lit("1970-01-05").cast("date"))
        return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))

    return until(F.col(end)) - until(F.col(begin))


def epoch_millis_date(millis: str) -> Column:
    return F.timestamp_millis(F.col(millis)).cast("date")
