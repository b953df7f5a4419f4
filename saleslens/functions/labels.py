"""Turning values into named bands and segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def first_match(cases: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """Label of the first condition that is true; null conditions never match."""
    chain = F
    for condition, label in cases:
        chain = chain.when(condition, F.lit(label))
    return chain.otherwise(F.lit(otherwise))


def above(value: Column, limits: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Band by `value > limit`, limits given from high to low."""
    return first_match([(value > limit, label) for limit, label in limits], otherwise)


def at_least(value: Column, limits: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Band by `value >= limit`, limits given from high to low."""
    return first_match([(value >= limit, label) for limit, label in limits], otherwise)


def position(label: Column, order: Sequence[str]) -> Column:
    """Sort key for a fixed order of labels; labels not listed come last."""
    chain = F
    for place, name in enumerate(order):
        chain = chain.when(label == name, place)
    return chain.otherwise(len(order))


def tidy_gender(raw: Column) -> Column:
    code = F.upper(raw)
    return first_match([(code.isin("M", "MALE"), "Male"), (code.isin("F", "FEMALE"), "Female")], "Unknown")
