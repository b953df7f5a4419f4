"""Operators on groups that share a key, safe when one key holds most rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .staging import stage

HOT_ROWS = 20_000_000
_SAMPLED_HOT_ROWS = 2_000


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys with more than `hot_rows` rows, or None when there are none.

    Large limits are checked on a sample in which such a key has 2,000 rows; half
    of that is enough to be listed, so none is missed, and a listed key holds
    about `hot_rows` / 2 rows or more. Hence there are at most some
    2 * rows / hot_rows keys, read back from their staged table. The sample only decides
    how rows are spread; results do not depend on it.
    """
    fraction = min(1.0, _SAMPLED_HOT_ROWS / hot_rows)
    seen = df.select(*keys)
    limit = hot_rows
    if fraction < 1.0:
        seen, limit = seen.sample(fraction, seed=7), _SAMPLED_HOT_ROWS // 2
    hot = stage(seen.groupBy(*keys).count().filter(F.col("count") > limit).select(*keys), "hot-keys")
    return None if hot.isEmpty() else hot


def matches(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality on all keys."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def split_hot(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of hot keys, all other rows). Adaptive execution sends the few hot keys to the rows."""
    condition = matches(df, hot, keys)
    return df.join(hot, condition, "left_semi"), df.join(hot, condition, "left_anti")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in the given order. Spark keeps one row per key and map
    task before the shuffle, so a hot key costs no more than any other."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(window)).filter("_place = 1").drop("_place")


def drop_repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Remove every row whose key occurs more than once; keys with a null part stay.

    One aggregation instead of a count joined back: a group counts its rows and
    keeps any one of them, which is the row itself where the count is 1.
    """
    null_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    others = [c for c in df.columns if c not in keys]
    single = (
        df.filter(~null_key)
        .groupBy(*keys)
        .agg(F.count("*").alias("_copies"), F.any_value(F.struct(*others)).alias("_row"))
        .filter("_copies = 1")
        .select(*keys, "_row.*")
    )
    return single.unionByName(df.filter(null_key)).select(*df.columns)
