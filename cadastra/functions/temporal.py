"""Interval algebra on inclusive years, where null is an open end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW, HIGH = -9999, 9999


def is_active(start: Column, end: Column, year) -> Column:
    """Whether the year lies in the period."""
    return (F.coalesce(start, F.lit(LOW)) <= year) & (F.coalesce(end, F.lit(HIGH)) >= year)


def touches(start: Column, end: Column, first: int, last: int) -> Column:
    """Whether the period overlaps first..last."""
    return (F.coalesce(start, F.lit(LOW)) <= last) & (F.coalesce(end, F.lit(HIGH)) >= first)


def years_of(start: Column, end: Column, first: int, last: int) -> Column:
    """The years of the period within first..last, as an array; empty where there are none."""
    low, high = F.greatest(F.coalesce(start, F.lit(first)), F.lit(first)), F.least(F.coalesce(end, F.lit(last)), F.lit(last))
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def overlap_years(a_start: Column, a_end: Column, b_start: Column, b_end: Column, first: int, last: int) -> Column:
    """How many years two periods share; open ends reach one year beyond first..last."""
    low = F.greatest(F.coalesce(a_start, F.lit(first - 1)), F.coalesce(b_start, F.lit(first - 1)))
    high = F.least(F.coalesce(a_end, F.lit(last + 1)), F.coalesce(b_end, F.lit(last + 1)))
    return F.greatest(F.lit(0), high - low + 1)


def is_handover(a_start: Column, a_end: Column, b_start: Column, b_end: Column, first: int, last: int) -> Column:
    """One shared year, in which one period ends and the other starts."""
    meets = F.coalesce(a_end == b_start, F.lit(False)) | F.coalesce(b_end == a_start, F.lit(False))
    return (overlap_years(a_start, a_end, b_start, b_end, first, last) == 1) & meets


def share_parts(share: Column) -> tuple[Column, Column]:
    """Numerator and denominator of "n/d"; null for "joint" and for none."""
    part = lambda i: F.when(share.rlike(r"^\d+/\d+$"), F.regexp_extract(share, r"^(\d+)/(\d+)$", i).cast("long"))
    return part(1), part(2)


def share_value(share: Column) -> Column:
    """The share as a number, 0 where there is none."""
    n, d = share_parts(share)
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def valid_year(year: Column) -> Column:
    return F.when(year.between(1000, 1800), year)


def valid_share(share: Column) -> Column:
    return F.when(share.rlike(r"^(\d+/\d+|joint)$"), share)


def valid_period(start: Column, end: Column, start_precision: Column, end_precision: Column) -> Column:
    """from <= to, and no precision without a year."""
    order = start.isNull() | end.isNull() | (start <= end)
    return order & (start_precision.isNull() | start.isNotNull()) & (end_precision.isNull() | end.isNotNull())


def ordered(start: Column, end: Column) -> tuple[Column, Column]:
    """Start and end, swapped where they are reversed."""
    both = start.isNotNull() & end.isNotNull()
    return F.when(both, F.least(start, end)).otherwise(start), F.when(both, F.greatest(start, end)).otherwise(end)


def years_text(start: Column, end: Column) -> Column:
    """"1600–1624", with "…" for an open end."""
    return F.concat(F.coalesce(start.cast("string"), F.lit("…")), F.lit("–"), F.coalesce(end.cast("string"), F.lit("…")))


def clamp(year: Column, first: int, last: int) -> Column:
    return F.least(F.greatest(year, F.lit(first)), F.lit(last))
