"""Ratios, scores and ages as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """100 part / whole; null where the whole is 0 or null."""
    return F.when(whole > 0, 100.0 * part / whole)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def whole_days(since: Column, until: Column) -> Column:
    """Whole days between two times, by seconds and not by calendar."""
    return F.floor((F.unix_timestamp(until) - F.unix_timestamp(since)) / 86400)


def within_days(at: Column, as_of: Column, days: int) -> Column:
    return at >= as_of - F.make_dt_interval(F.lit(days))


def first_integer(x: Column, most: int = 60) -> Column:
    """The first whole number of a text; null if there is none or it is over `most`."""
    n = F.regexp_extract(x, r"(\d{1,9})", 1).try_cast("int")
    return F.when(n <= most, n)
