"""Distinct counts over months that roll up to longer periods without reading the facts again.

The ids of a month are bitmaps: 32,768 ids to a bitmap of 4 KB, one row for each
month and run of ids that occurs. Bitmaps of months are merged by OR, so a
customer who comes in March and in May counts once for the year. Sums are kept
beside them and added up. Ids have to be whole numbers; they may be negative or
far apart, but bitmaps pay where they are dense.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Periods, as `trunc` names them, that a month lies in whole.
PERIODS = ("MONTH", "QUARTER", "YEAR")


def monthly_bitmaps(facts: DataFrame, date: str, ids: str, sums: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """`month`, the columns of `by`, `bucket` (a run of ids), `ids` (its bitmap) and the sums, for facts with a date.

    Facts without an id have the bucket null and no bitmap; their sums count. One
    shuffle of rows that are aggregated before it.
    """
    dated = facts.filter(F.col(date).isNotNull()).withColumns(
        {"month": F.trunc(date, "MONTH"), "bucket": F.bitmap_bucket_number(F.col(ids).cast("long"))}
    )
    bitmap = F.bitmap_construct_agg(F.bitmap_bit_position(F.col(ids).cast("long")))
    return dated.groupBy("month", *by, "bucket").agg(
        F.when(F.col("bucket").isNotNull(), bitmap).alias("ids"), *(F.sum(source).alias(name) for name, source in sums.items())
    )


def roll_up(monthly: DataFrame, period: str, sums: Sequence[str], distinct: str, by: Sequence[str] = ()) -> DataFrame:
    """`period_start`, the columns of `by`, the distinct ids under the name `distinct`, and the sums of a stored monthly table."""
    if period not in PERIODS:
        raise ValueError(f"{period} isn't one of {PERIODS}")
    start: Column = F.trunc("month", period).alias("period_start")
    merged = monthly.groupBy(start, *by, "bucket").agg(F.bitmap_or_agg("ids").alias("ids"), *(F.sum(s).alias(s) for s in sums))
    counted = F.sum(F.when(F.col("bucket").isNotNull(), F.bitmap_count("ids")).otherwise(0))
    return merged.groupBy("period_start", *by).agg(counted.alias(distinct), *(F.sum(s).alias(s) for s in sums))
