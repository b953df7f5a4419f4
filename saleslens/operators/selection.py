"""Rows at given places of an order, found by counting instead of sorting.

The value at a place is narrowed down: approximate percentiles give a range of
values around it, and exact counts below and inside tell whether it lies there.
Once a range holds few rows, the count of each of its values and their running
sums give the value at the place. Only among rows that share that value does the
next column of the order matter, so the key that ends an order is looked at for
ties alone. All places that are looked for share each pass over the table.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal, localcontext
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ByteType, DataType, DateType, DecimalType, IntegerType, LongType, ShortType, TimestampType

Order = Sequence[tuple[str, bool]]
Figures = dict["Range", tuple]

#: Rows of a range whose values are counted one by one, and ranges that percentiles divide a larger one into.
FEW_ROWS = 10_000
RANGES = 500
ACCURACY = 10_000

_COUNTED = (ByteType, ShortType, IntegerType, LongType, DecimalType, DateType)


def can_select(kind: DataType) -> bool:
    """Whether values of a type can be narrowed down by percentiles."""
    return isinstance(kind, _COUNTED)


def sql_literal(value: Any, kind: DataType) -> str:
    """A value that was read from a column of this type, as SQL text; long conditions are built much faster as text."""
    if value is None:
        return "null"
    if isinstance(kind, TimestampType):  # read as local time, whatever the session's zone
        return f"timestamp_micros({math.floor(value.timestamp()) * 1_000_000 + value.microsecond})"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"cast('{text}' as {kind.simpleString()})"


@dataclass(frozen=True)
class Range:
    """Rows with these values in the columns before, and `column` from `low` to `high` (None: open); conditions as SQL text."""

    before: tuple[tuple[str, DataType, Any], ...]
    column: str
    kind: DataType
    low: Any = None
    high: Any = None

    @property
    def scope(self) -> str:
        return " and ".join(f"`{name}` <=> {sql_literal(value, kind)}" for name, kind, value in self.before) or "true"

    @property
    def below(self) -> str:
        return "false" if self.low is None else f"`{self.column}` < {sql_literal(self.low, self.kind)}"

    @property
    def inside(self) -> str:
        found = f"`{self.column}` is not null"
        if self.low is not None:
            found += f" and `{self.column}` >= {sql_literal(self.low, self.kind)}"
        if self.high is not None:
            found += f" and `{self.column}` <= {sql_literal(self.high, self.kind)}"
        return found


@dataclass(frozen=True)
class Place:
    """The row at `rank` (from 1) of the rows in its range's scope, in order of the columns that are left.

    `rows` is how many rows the range holds at most, as far as known; `nulls` and
    `filled` are those of the scope without and with a value.
    """

    left: tuple[tuple[str, bool], ...]
    range: Range
    rank: int
    rows: float
    nulls: int | None = None
    filled: int | None = None
    slack: int = 1

    @property
    def ascending_rank(self) -> int | None:
        """The place among the values from the smallest up, or None where a null stands there."""
        if self.left[0][1]:
            return self.rank - self.nulls if self.rank > self.nulls else None
        return self.filled - self.rank + 1 if self.rank <= self.filled else None

    def narrowed(self, nulls: int, filled: int, below: int, inside: int, grid: list | None) -> Place:
        """The same place in the part of the range that the percentiles `grid` say it lies in."""
        known = replace(self, nulls=nulls, filled=filled)
        rank = known.ascending_rank
        if rank is None:
            return replace(known, rows=0)
        if not below < rank <= below + inside:
            return known.reopened()
        step = (rank - below - 1) * RANGES // inside
        low = _widened(grid[max(step - self.slack, 0)], -1)
        high = _widened(grid[min(step + 1 + self.slack, RANGES)], 1)
        smaller = replace(self.range, low=low, high=high)
        # A range of one value, or one that percentiles can't divide further, is counted value by value.
        rows = 0 if low == high or smaller == self.range else inside * ((1 + 2 * self.slack) / RANGES + 2 / ACCURACY)
        return replace(known, range=smaller, rows=rows)

    def reopened(self) -> Place:
        """The whole scope again, to be narrowed down less boldly."""
        return replace(self, range=replace(self.range, low=None, high=None), rows=math.inf, slack=4 * self.slack)


def _widened(value: Any, sign: int) -> Any:
    """Percentiles go through doubles: a bound that moves by their error can't pass the value that is meant."""
    if isinstance(value, Decimal):
        with localcontext(prec=60):
            moved = value + sign * abs(value) * Decimal("1e-15")
            return moved.quantize(value, ROUND_CEILING if sign > 0 else ROUND_FLOOR)
    if isinstance(value, int) and abs(value) > 2**52:
        return min(max(value + sign * (abs(value) >> 49), -(2**63)), 2**63 - 1)
    return value


def figures_of(ranges: Sequence[Range]) -> list[Column]:
    """Aggregates: nulls and values of each range's scope, rows below and inside, and percentiles inside."""
    steps = ", ".join(f"{i / RANGES}D" for i in range(RANGES + 1))
    found = []
    for i, wanted in enumerate(ranges):
        figures = {
            "nulls": f"count_if({wanted.scope} and `{wanted.column}` is null)",
            "filled": f"count_if({wanted.scope} and `{wanted.column}` is not null)",
            "below": f"count_if({wanted.scope} and {wanted.below})",
            "inside": f"count_if({wanted.scope} and {wanted.inside})",
            "grid": f"percentile_approx(case when {wanted.scope} and {wanted.inside} then `{wanted.column}` end, array({steps}), {ACCURACY})",
        }
        found += [F.expr(figure).alias(f"{name}_{i}") for name, figure in figures.items()]
    return found


def read_figures(ranges: Sequence[Range], row: Mapping[str, Any]) -> Figures:
    return {r: tuple(row[f"{name}_{i}"] for name in ("nulls", "filled", "below", "inside", "grid")) for i, r in enumerate(ranges)}


def whole_range(df: DataFrame, order: Order) -> Range:
    """The open range that a search in this order begins with."""
    return Range((), order[0][0], df.schema[order[0][0]].dataType)


def _value_counts(df: DataFrame, ranges: Sequence[Range]) -> dict[Range, tuple[int, int, list[tuple[Any, int]]]]:
    """For each range of few rows: the scope's nulls, the rows below the range, and its values in ascending order with their rows.

    Ranges of one scope and column share an entry per row: its value if it lies
    in one of them, else how many of them lie below it.
    """
    groups: dict[tuple, list[Range]] = {}
    for wanted in ranges:
        groups.setdefault((wanted.before, wanted.column), []).append(wanted)
    kinds = {members[0].column: members[0].kind for members in groups.values()}

    def entry(number: int, members: list[Range]) -> str:
        column = members[0].column
        kept = " or ".join(f"({r.inside})" for r in members)
        above = [f"if(`{column}` > {sql_literal(r.high, r.kind)}, 1, 0)" for r in members if r.high is not None]
        cells = [
            f"if({kept}, `{c}`, null) as `value_{c}`" if c == column else f"cast(null as {kind.simpleString()}) as `value_{c}`"
            for c, kind in kinds.items()
        ]
        passed = f"if(`{column}` is null, -1, {' + '.join(above) or '0'})"
        found = f"struct({number} as group, {passed} as passed, {', '.join(cells)})"
        return f"if({members[0].scope}, {found}, null)"

    entries = f"inline(filter(array({', '.join(entry(i, m) for i, m in enumerate(groups.values()))}), e -> e is not null))"
    counted = df.select(F.expr(entries)).groupBy("group", "passed", *(f"value_{c}" for c in kinds)).count().collect()
    found = {}
    for i, ((_, column), members) in enumerate(groups.items()):
        rows = [(r["passed"], r[f"value_{column}"], r["count"]) for r in counted if r["group"] == i]
        listed = sorted((value, n) for _, value, n in rows if value is not None)
        nulls = sum(n for passed, _, n in rows if passed < 0)
        highs = [r.high for r in members if r.high is not None]
        for wanted in members:
            inside = [v for v in listed if (wanted.low is None or v[0] >= wanted.low) and (wanted.high is None or v[0] <= wanted.high)]
            below = 0
            if wanted.low is not None:
                ends = sum(high < wanted.low for high in highs)  # a row between ranges has passed these at most
                below = sum(n for passed, value, n in rows if value is None and 0 <= passed <= ends)
                below += sum(n for value, n in listed if value < wanted.low)
            found[wanted] = nulls, below, inside
    return found


def select_places(df: DataFrame, places: Sequence[tuple[Order, int]], known: Figures | None = None) -> list[list[Any]]:
    """For each (order, rank from 1) the values of the first columns that tell its row from all that stand before it.

    A row stands before the place if its values do; of rows that share all
    given values, none stands before it. So a place at the first of some ties
    needs no further column. `df` is read once for each pass and should be
    stored; a pass returns one row of figures or a bounded number of values. The
    number of passes doesn't depend on the number of places. `known` may hold the
    figures of each `whole_range`, if they were taken while the table was written.
    """
    known = known or {}
    found: list[list[Any]] = [[] for _ in places]
    waiting = {i: Place(tuple(order), whole_range(df, order), rank, math.inf) for i, (order, rank) in enumerate(places)}
    while waiting:
        large = {i: p for i, p in waiting.items() if p.rows > FEW_ROWS}
        if large:
            ranges = [r for r in dict.fromkeys(p.range for p in large.values()) if r not in known]
            figures = known | (read_figures(ranges, df.agg(*figures_of(ranges)).first().asDict()) if ranges else {})
            waiting |= {i: place.narrowed(*figures[place.range]) for i, place in large.items()}
            continue
        listed = _value_counts(df, list(dict.fromkeys(p.range for p in waiting.values())))
        ready, waiting = waiting, {}
        for i, place in ready.items():
            nulls, below, values = listed[place.range]
            inside = sum(rows for _, rows in values)
            if place.filled is None:  # an open range: all values are listed
                place = replace(place, nulls=nulls, filled=inside)
            rank, ascending = place.ascending_rank, place.left[0][1]
            if rank is None:
                value, rows, among_ties = None, place.nulls, place.rank - (0 if ascending else place.filled)
            elif not below < rank <= below + inside:
                waiting[i] = place.reopened()
                continue
            else:
                value, before, rows = _value_at(values, rank - below)
                before += below
                among_ties = rank - before if ascending else place.rank - (place.filled - before - rows)
            found[i].append(value)
            if among_ties > 1 and len(place.left) > 1:
                scope = (*place.range.before, (place.range.column, place.range.kind, value))
                following = replace(whole_range(df, place.left[1:]), before=scope)
                waiting[i] = Place(place.left[1:], following, among_ties, rows)
    return found


def _value_at(values: list[tuple[Any, int]], rank: int) -> tuple[Any, int, int]:
    """The value at a rank of ascending values, the rows before it, and those that have it."""
    before = 0
    for value, rows in values:
        if before < rank <= before + rows:
            break
        before += rows
    return value, before, rows
