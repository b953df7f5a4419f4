"""Small result shapes: one row to many, and shares of a total."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import percent


def metrics_to_rows(
    one_row: DataFrame, metrics: Sequence[tuple[str, Sequence[Column]]], names: Sequence[str]
) -> DataFrame:
    """Turn a one-row table into labelled rows, without reading its input again.

    Each metric is a label and its value columns; `names` are the result columns.
    """
    entries = [
        F.struct(F.lit(label).alias(names[0]), *[v.alias(n) for v, n in zip(values, names[1:])])
        for label, values in metrics
    ]
    return one_row.select(F.inline(F.array(*entries)))


def share_of_total(part: Column, digits: int = 2) -> Column:
    """Percentage of the sum over all rows. Use it on grouped rows only: the
    total meets in one task."""
    return percent(part, F.sum(part).over(Window.partitionBy()), digits)


def as_view(df: DataFrame, view: str | None) -> DataFrame:
    """`df`, registered under a name if one is given."""
    if view:
        df.createOrReplaceTempView(view)
    return df
