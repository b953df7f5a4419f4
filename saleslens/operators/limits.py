"""Declared limits of columns as reasons for which a row is refused."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructType

REASONS = "_reasons"


@dataclass(frozen=True)
class Limit:
    """What a column may hold besides its type; a null meets all but `required`."""

    longest: int | None = None
    least: int | None = None
    most: int | None = None
    required: bool = False


def column_reasons(name: str, text: Column, value: Column, kind: str, limit: Limit) -> list[Column]:
    """For each limit of one column: the reason where its text or typed value breaks it, else null."""

    def unless(broken: Column, words: str) -> Column:
        return F.when(broken, F.lit(f"{name}: {words}"))

    found = [unless(text.isNotNull() & value.isNull(), f"not {kind}")]
    if limit.required:
        found.append(unless(text.isNull(), "missing"))
    if limit.longest is not None:
        found.append(unless(F.length(text) > limit.longest, f"longer than {limit.longest}"))
    if limit.least is not None:
        found.append(unless(value < limit.least, f"below {limit.least}"))
    if limit.most is not None:
        found.append(unless(value > limit.most, f"above {limit.most}"))
    return found


def with_reasons(df: DataFrame, schema: StructType, limits: Mapping[str, Limit]) -> DataFrame:
    """Rows of texts as typed columns, with the list of reasons against each in `_reasons`.

    `df` has a text for each column of the schema; its other columns stay. A text
    that is not of its column's type is null and a reason, in the order of the
    columns; the limits of a column come after its type. A row without a reason
    fits. One pass without a shuffle; no row is lost.
    """
    reasons, typed = [], []
    for field in schema.fields:
        text = F.col(f"`{field.name}`")
        value = text if isinstance(field.dataType, StringType) else text.try_cast(field.dataType)
        typed.append(value.alias(field.name))
        reasons += column_reasons(field.name, text, value, field.dataType.simpleString(), limits.get(field.name, Limit()))
    others = [f"`{c}`" for c in df.columns if c not in schema.names]
    return df.select(*typed, *others, F.array_compact(F.array(*reasons)).alias(REASONS))
