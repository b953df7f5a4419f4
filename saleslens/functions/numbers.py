"""Division, rounding and averages with one fixed meaning everywhere."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ROUNDING_TYPE = "decimal(30,8)"


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division as double; null when the denominator is zero or null."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def round_to(value: Column, digits: int) -> Column:
    """Round half up on a decimal, so that no binary half case slips through."""
    return F.round(value.cast(ROUNDING_TYPE), digits).cast("double")


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return round_to(ratio(part.cast("double") * 100, whole), digits)


def mean(value: Column) -> Column:
    """Average from an exact sum: the result does not depend on partitioning."""
    return ratio(F.sum(value), F.count(value))


def rounded_mean(value: Column, digits: int = 2) -> Column:
    return round_to(mean(value), digits)


def count_where(condition: Column) -> Column:
    """Rows where the condition holds; null on an empty input, like SUM of a CASE."""
    return F.sum(F.when(condition, 1).otherwise(0))


def whole_mean(column: str) -> Column:
    """Average of an integer column, cut toward zero."""
    return F.expr(f"sum({column}) div nullif(count({column}), 0)")


def whole_ratio(numerator: str, denominator: str) -> Column:
    """Integer quotient, cut toward zero."""
    return F.expr(f"{numerator} div nullif({denominator}, 0)")
