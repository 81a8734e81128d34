"""Calendar expressions. Weekdays count from Monday = 1; weeks are ISO weeks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T


def parse_yyyymmdd(column: Column, data_type: T.DataType) -> Column:
    """Strict date parse: any value that is not a ``yyyyMMdd`` date fails the job.

    Integer input is split with arithmetic, which avoids building and parsing a string per row.
    """
    if isinstance(data_type, T.DateType):
        return column
    if isinstance(data_type, T.IntegralType):
        year = (column / 10000).cast("int")
        date = F.make_date(year, (column / 100).cast("int") % 100, (column % 100).cast("int"))
        bad = F.raise_error(F.concat(F.lit("not a yyyyMMdd date: "), column.cast("string")))
        # Without ANSI mode make_date gives NULL for a day that does not exist.
        return F.when(column.isNull() | (column.between(10000101, 99991231) & date.isNotNull()), date).otherwise(
            bad.cast("date"))
    return F.to_date(column.cast("string"), "yyyyMMdd")


def day_of_week(date: Column) -> Column:
    return F.weekday(date) + 1


def is_weekend(date: Column) -> Column:
    return F.weekday(date) >= 5


def cycle(value: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a position in a repeating cycle."""
    angle = F.lit(2.0) * F.pi() * value / F.lit(period)
    return F.sin(angle), F.cos(angle)


def period_index(date: Column, grain: str) -> Column:
    """A whole number that grows by one per day, ISO week or month."""
    if grain == "day":
        return F.unix_date(date)
    if grain == "week":
        # 1970-01-05 was a Monday, day 4 of the epoch.
        return F.floor((F.unix_date(date) - 4) / F.lit(7)).cast("int")
    if grain == "month":
        return F.year(date) * 12 + F.month(date)
    raise ValueError(f"grain must be day, week or month, not {grain!r}")
