"""Dates and months as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(text: Column) -> Column:
    """ISO, dd-Mon-yyyy or dd/mm/yyyy; else null, also for days that don't exist."""
    head = F.trim(text)
    return F.coalesce(*(F.try_to_date(head, f) for f in ("yyyy-MM-dd", "dd-MMM-yyyy", "dd/MM/yyyy")))


def month_of(day: Column) -> Column:
    return F.trunc(day, "MM")


def add_months_first(day: Column, k: int | Column) -> Column:
    """The first day of the month k months on."""
    return F.trunc(F.add_months(day, k), "MM")


def month_number(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def months_between(earlier: Column, later: Column) -> Column:
    """Difference of calendar months; days do not count."""
    return month_number(later) - month_number(earlier)


def years_between(earlier: Column, later: Column) -> Column:
    """Completed years, not below 0."""
    before = F.date_format(later, "MMdd") < F.date_format(earlier, "MMdd")
    return F.greatest(F.year(later) - F.year(earlier) - before.cast("int"), F.lit(0))


def iso_week(day: Column) -> Column:
    """YYYY-Www of the ISO week, whose year is not always the calendar's."""
    return F.format_string("%04d-W%02d", F.date_part(F.lit("YEAROFWEEK"), day).cast("int"), F.weekofyear(day))


def latest_published(today: Column, day: int = 20, lag: int = 2) -> Column:
    """The newest published month: lag months back from the given day of the month on, else one more."""
    return F.when(F.dayofmonth(today) >= day, add_months_first(today, -lag)).otherwise(add_months_first(today, -lag - 1))


def knowable_by(onset: Column, lag: int, sustain: int = 3) -> Column:
    """The month in which an onset can be known: it must persist, and be published."""
    return F.add_months(onset, sustain + lag)


def dob_age(year: Column, month: Column, today: Column) -> Column:
    """Lower bound of the age from year and month of birth; null outside 16 to 110."""
    age = F.year(today) - year - (F.month(today) <= F.coalesce(month, F.lit(12))).cast("int")
    return F.when((age >= 16) & (age <= 110), age)


def in_window(text: Column, since: int) -> Column:
    """Whether the latest year from 2000 on that a text names is not before `since`; also if it names none."""
    years = F.transform(F.regexp_extract_all(text, F.lit(r"\b(20\d\d)\b"), F.lit(1)), lambda y: y.cast("int"))
    return F.coalesce(F.array_max(years) >= since, F.lit(True))


def bucket(day: Column, anchor: Column, period: int = 4) -> Column:
    """p3, p2, p1 (the last periods of months), prior12, pre24; null for the future."""
    m = months_between(day, anchor)
    return F.when(day > anchor, F.lit(None)).when(m < period, "p3").when(m < 2 * period, "p2").when(m < 3 * period, "p1").when(m < 24, "prior12").otherwise("pre24")
