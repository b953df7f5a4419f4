"""Calendar helpers. A span counts the boundaries crossed, not elapsed time:
31 January to 1 February is one month."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F


def as_date(value: dt.date | str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("date")


def month_index(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date)


def months_between_boundaries(start: Column, end: Column) -> Column:
    return month_index(end) - month_index(start)


def years_between_boundaries(start: Column, end: Column) -> Column:
    return F.year(end) - F.year(start)


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def month_label(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM")


# Spellings of a full date, a time of day may follow; 2024-01-31, 2024/1/31, 20240131.
FULL_DATE = r"^ *([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})(?:[ T][0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?)? *$"
COMPACT_DATE = r"^ *([0-9]{4})([0-9]{2})([0-9]{2}) *$"


def full_date(text: Column) -> Column:
    """The date that a text spells with year, month and day; null for any other text."""
    parts = F.when(text.rlike(FULL_DATE), F.regexp_replace(text, FULL_DATE, "$1-$2-$3")).when(
        text.rlike(COMPACT_DATE), F.regexp_replace(text, COMPACT_DATE, "$1-$2-$3")
    )
    return parts.try_cast("date")
