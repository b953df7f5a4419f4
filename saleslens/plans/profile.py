"""Profiles of tables and columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from ..operators.rows import metrics_to_rows

Tables = dict[str, DataFrame]


def profile_tables(tables: Tables) -> DataFrame:
    """Rows and columns of each table."""
    counted = [
        df.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).alias("column_count")
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counted).orderBy("table_name")


#: Types whose values a sketch takes as they are; all others go in as text.
_WHOLE = ("tinyint", "smallint", "int", "bigint")
#: Rows of a sketch's table are 2 to this power; the relative error is about 0.8 / sqrt(rows).
SKETCH_BITS = 14


def sketch_error(bits: int = SKETCH_BITS) -> float:
    """Relative standard error of a distinct count from a sketch."""
    return 1.04 / 2 ** (bits / 2)


def _sketched(name: str, kind: str) -> Column:
    return F.col(f"`{name}`").cast("bigint" if kind in _WHOLE else "string")


def sketch_columns(df: DataFrame, by: Sequence[str] = (), bits: int = SKETCH_BITS) -> DataFrame:
    """A row for each group of `by` with a struct for each other column: what `merge_profiles` needs.

    One scan and one aggregate; besides the groups nothing is shuffled but
    sketches of bounded size. The result can be stored, day by day for instance,
    and merged later without reading the rows again.
    """
    types = dict(df.dtypes)
    sketches = {c: F.hll_sketch_agg(_sketched(c, types[c]), bits).alias("sketch") for c in df.columns if c not in by}
    return df.groupBy(*by).agg(*[F.struct(*_figures(c), sketch).alias(c) for c, sketch in sketches.items()])


def _figures(c: str) -> list[Column]:
    """What one aggregate says about a column, without its distinct values."""
    column = F.col(f"`{c}`")
    return [
        F.count("*").alias("rows"),
        F.count_if(column.isNull()).alias("nulls"),
        F.max(F.length(column.cast("string"))).alias("length"),
        F.min(column).alias("low"),
        F.max(column).alias("high"),
    ]


def merge_profiles(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Coarser groups of `sketch_columns`, in the same form; any number of merges gives what one scan would."""
    return sketches.groupBy(*by).agg(
        *[
            F.struct(
                F.sum(f"`{c}`.rows").alias("rows"),
                F.sum(f"`{c}`.nulls").alias("nulls"),
                F.max(f"`{c}`.length").alias("length"),
                F.min(f"`{c}`.low").alias("low"),
                F.max(f"`{c}`.high").alias("high"),
                F.hll_union_agg(f"`{c}`.sketch").alias("sketch"),
            ).alias(c)
            for c in sketches.columns
            if c not in by and isinstance(sketches.schema[c].dataType, StructType)
        ]
    )


NAMES = ["column_name", "data_type", "null_count", "max_length", "min_value", "max_value", "distinct_count"]


def _as_rows(figures: DataFrame, types: dict[str, str], distinct: bool = True) -> DataFrame:
    """One aggregate row to a row for each column; distinct counts as their sketches say."""

    def cells(c: str) -> list[Column]:
        low, high = (F.col(f"`{c}`.{part}").cast("string") for part in ("low", "high"))
        shown = [F.lit(types[c]), F.coalesce(F.col(f"`{c}`.nulls"), F.lit(0).cast("long")), F.col(f"`{c}`.length"), low, high]
        return shown + ([F.coalesce(F.hll_sketch_estimate(f"`{c}`.sketch"), F.lit(0).cast("long"))] if distinct else [])

    return metrics_to_rows(figures, [(c, cells(c)) for c in types], NAMES if distinct else NAMES[:-1])


def show_profile(sketches: DataFrame, types: dict[str, str]) -> DataFrame:
    """Stored or merged sketches of one group as the rows of `profile_columns`; `types` of the columns as they were."""
    return _as_rows(merge_profiles(sketches), types).orderBy("column_name")


def profile_columns(df: DataFrame, exact: bool = False, bits: int = SKETCH_BITS) -> DataFrame:
    """Type, nulls, distinct values, longest text, smallest and largest value per column.

    All figures come from one scan and one aggregate row. Distinct counts are
    estimates from sketches, see `sketch_error`; `exact` counts each column in
    an aggregate of its own instead, which shuffles its distinct values in their
    own type, once per map task each. All else is exact either way.
    """
    types = dict(df.dtypes)
    if not exact:
        return _as_rows(sketch_columns(df, bits=bits), types).orderBy("column_name")
    rows = _as_rows(df.agg(*[F.struct(*_figures(c)).alias(c) for c in types]), types, distinct=False)
    counts = [
        df.select(F.col(f"`{c}`").alias("value")).distinct().agg(F.count("value").alias("distinct_count")).withColumn("column_name", F.lit(c))
        for c in types
    ]
    return rows.join(reduce(DataFrame.unionByName, counts), "column_name").select(*NAMES).orderBy("column_name")
