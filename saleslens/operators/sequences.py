"""Neighbouring rows and joined texts inside ordered groups.

Groups of ordinary size use a window or an ordered aggregate. Rows of hot groups
are numbered over range partitions and handled in slices of fixed size, so that
no task ever holds such a group; the few slice edges are joined back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .keys import HOT_ROWS, hot_keys, split_hot
from .ranking import number_rows

SLICE_ROWS = 5_000_000
HOT_TEXT_ROWS = 1_000_000
TEXT_SLICE_ROWS = 500_000


def with_neighbours(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    before: Mapping[str, str],
    after: Mapping[str, str],
    hot_rows: int = HOT_ROWS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Add columns of the previous and the next row of the same key.

    `before` and `after` map new column names to source columns.
    """
    hot = hot_keys(df, [key], hot_rows)
    if hot is None:
        return _in_window(df, key, order, before, after)
    hot_part, cold_part = split_hot(df, [key], hot)
    return _in_slices(hot_part, key, order, before, after, slice_rows).unionByName(
        _in_window(cold_part, key, order, before, after)
    )


def _in_window(df, key, order, before, after):
    window = Window.partitionBy(key).orderBy(*order)
    return df.withColumns(
        {name: F.lag(source).over(window) for name, source in before.items()}
        | {name: F.lead(source).over(window) for name, source in after.items()}
    )


def _in_slices(df, key, order, before, after, slice_rows):
    numbered = number_rows(df, [F.col(key), *[F.col(c) for c in order]], "_number").withColumn(
        "_slice", F.floor(F.col("_number") / slice_rows)
    )
    place = F.col("_number") % slice_rows
    window = Window.partitionBy("_slice").orderBy("_number")
    left = F.struct(F.col(key).alias("key"), *[F.col(s).alias(n) for n, s in before.items()])
    right = F.struct(F.col(key).alias("key"), *[F.col(s).alias(n) for n, s in after.items()])
    # Only one edge row per slice: rows / slice_rows of them.
    edge_before = numbered.filter(place == slice_rows - 1).select(
        (F.col("_slice") + 1).alias("_slice"), left.alias("_edge_before")
    )
    edge_after = numbered.filter(place == 0).select(
        (F.col("_slice") - 1).alias("_slice"), right.alias("_edge_after")
    )
    joined = (
        numbered.withColumns({"_before": F.lag(left).over(window), "_after": F.lead(right).over(window)})
        .join(edge_before, "_slice", "left")
        .join(edge_after, "_slice", "left")
        .withColumns(
            {
                "_before": F.coalesce("_before", "_edge_before"),
                "_after": F.coalesce("_after", "_edge_after"),
            }
        )
    )
    added = {n: F.when(F.col("_before.key").eqNullSafe(F.col(key)), F.col(f"_before.{n}")) for n in before}
    added |= {n: F.when(F.col("_after.key").eqNullSafe(F.col(key)), F.col(f"_after.{n}")) for n in after}
    return joined.withColumns(added).select(*df.columns, *added)


def joined_texts(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    text: str,
    separator: str,
    name: str,
    measures: Mapping[str, tuple[Column, Column]],
    hot_rows: int = HOT_TEXT_ROWS,
    slice_rows: int = TEXT_SLICE_ROWS,
) -> DataFrame:
    """One row per key with the texts of its rows joined in order, plus measures.

    A measure is a pair: the aggregate over rows, and the aggregate that merges
    partial values of the same name. Texts are whole, however long.
    """
    per_rows = [partial.alias(n) for n, (partial, _) in measures.items()]
    hot = hot_keys(df, keys, hot_rows)
    if hot is None:
        return df.groupBy(*keys).agg(_listed(text, separator, order).alias(name), *per_rows)
    hot_part, cold_part = split_hot(df, keys, hot)
    cold = cold_part.groupBy(*keys).agg(_listed(text, separator, order).alias(name), *per_rows)
    numbered = number_rows(hot_part, [F.col(c) for c in (*keys, *order)], "_number")
    slices = numbered.groupBy(*keys, F.floor(F.col("_number") / slice_rows).alias("_slice")).agg(
        _listed(text, separator, ["_number"]).alias(name), *per_rows
    )
    whole = slices.groupBy(*keys).agg(
        _listed(name, separator, ["_slice"]).alias(name),
        *[merge.alias(n) for n, (_, merge) in measures.items()],
    )
    return whole.unionByName(cold)


def _listed(text: str, separator: str, order: Sequence[str]) -> Column:
    quoted = separator.replace("'", "\\'")
    return F.expr(f"listagg({text}, '{quoted}') within group (order by {', '.join(order)})")
