"""Sessions: step flags and ordered paths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .sequences import HOT_TEXT_ROWS, TEXT_SLICE_ROWS, joined_texts


def reached_steps(events: DataFrame, keys: Sequence[str], steps: Mapping[str, Column]) -> DataFrame:
    """Per session a 0/1 flag for each step; a step counts without the earlier ones."""
    return events.groupBy(*keys).agg(
        *[F.max(F.when(condition, 1).otherwise(0)).alias(name) for name, condition in steps.items()]
    )


def session_paths(
    events: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    label: str,
    goal: Column,
    separator: str = " → ",
    hot_rows: int = HOT_TEXT_ROWS,
    slice_rows: int = TEXT_SLICE_ROWS,
) -> DataFrame:
    """Per session its labels in order, the number of steps, and whether it met the goal."""
    return joined_texts(
        events.withColumn("_goal", F.when(goal, 1).otherwise(0)),
        keys,
        order,
        label,
        separator,
        "path",
        {
            "steps": (F.count("*"), F.sum("steps")),
            "converted": (F.max("_goal"), F.max("converted")),
        },
        hot_rows,
        slice_rows,
    )
