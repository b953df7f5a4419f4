"""Tables stored by month: a date predicate reads the folders of its months only."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F


def month_column(column: str) -> str:
    """Name of the partition column that goes with a date column."""
    return f"{column}_month"


def with_month(df: DataFrame, column: str) -> DataFrame:
    """`df` with the first day of the month of `column`; null where there is no date."""
    return df.withColumn(month_column(column), F.trunc(F.col(column), "MM"))


def in_period(df: DataFrame, column: str, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Rows with `start` <= `column` < `end`; rows without a date don't count.

    Where the table is stored by months of the column, the months are asked for
    as well, so the scan lists and reads only the folders that can hold such
    rows. The result is the same for both layouts.
    """
    kind = df.schema[column].dataType
    wanted: Column = F.col(column).isNotNull()
    if start is not None:
        wanted &= F.col(column) >= F.lit(start).cast(kind)
    if end is not None:
        wanted &= F.col(column) < F.lit(end).cast(kind)
    month = month_column(column)
    if month in df.columns:
        wanted &= F.col(month).isNotNull()
        if start is not None:
            wanted &= F.col(month) >= F.lit(start.replace(day=1))
        if end is not None:
            wanted &= F.col(month) <= F.lit(end)
    return df.filter(wanted)
