"""Places in an order by counting: against sorted rows, with ranges so small that many passes are needed."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import Window, functions as F

from saleslens.operators import selection
from saleslens.operators.ranking import add_ntiles, sorting

from conftest import values

SCHEMA = "id long, n int, amount decimal(20,2), day date, at timestamp, t string, x double"


def rows(seed, count, spread):
    draw = random.Random(seed)
    found = []
    for i in range(count):
        n = draw.choice([None, 0, 0, 0, draw.randint(-spread, spread)])
        found.append(
            (
                i * 7919 % 100_003,
                n,
                draw.choice([None, Decimal(draw.randint(-spread, spread)) / 100, Decimal("123456789012345678.99")]),
                draw.choice([None, dt.date(2020, 1, 1) + dt.timedelta(draw.randint(0, spread))]),
                draw.choice([None, dt.datetime(2024, 3, 1, 5, 6, 7, draw.randint(0, spread))]),
                draw.choice([None, "it's", 'a "b"', "c\\d", "", str(draw.randint(0, spread))]),
                draw.choice([None, float("nan"), float("inf"), -0.0, 0.0, draw.random()]),
            )
        )
    return found


def sort_key(order, names):
    def key(row):
        parts = []
        for name, ascending in order:
            value = row[names.index(name)]
            if isinstance(value, (dt.date, dt.datetime)):
                value = value.toordinal() if type(value) is dt.date else (value - dt.datetime(2000, 1, 1)).total_seconds()
            parts.append((value is not None, value or 0) if ascending else (value is None, -(value or 0)))
        return parts

    return key


ORDERS = [
    [("n", True), ("id", True)],
    [("n", False), ("id", False)],
    [("amount", True), ("day", False), ("id", True)],
    [("day", False), ("n", True), ("id", True)],
]


@pytest.mark.parametrize("few, ranges", [(1, 4), (20, 10), (10_000, 500)])
@pytest.mark.parametrize("spread", [3, 5000])
def test_places_equal_sorted_rows(frame, monkeypatch, few, ranges, spread):
    monkeypatch.setattr(selection, "FEW_ROWS", few)
    monkeypatch.setattr(selection, "RANGES", ranges)
    data, names = rows(1, 500, spread), [c.split()[0] for c in SCHEMA.split(", ")]
    df = frame(data, SCHEMA).repartition(3).cache()
    ranks = [1, 2, 100, 251, 499, 500]
    found = selection.select_places(df, [(order, rank) for order in ORDERS for rank in ranks])
    for (order, rank), prefix in zip(((o, r) for o in ORDERS for r in ranks), found):
        placed = sorted(data, key=sort_key(order, names))
        columns = [names.index(c) for c, _ in order]
        assert prefix == [placed[rank - 1][c] for c in columns][: len(prefix)]
        # The first row with these values stands at the place.
        first = next(i for i, row in enumerate(placed) if [row[c] for c in columns][: len(prefix)] == prefix)
        assert first == rank - 1


@pytest.mark.parametrize("order", [[("t", True), ("id", True)], [("x", False), ("id", True)], [("at", False), ("id", True)], [("at", True), ("t", False), ("id", True)]])
def test_ntiles_of_texts_floats_and_moments(frame, order):
    df = frame(rows(2, 120, 50), SCHEMA)
    window = F.ntile(7).over(Window.orderBy(*sorting(order)))
    assert values(add_ntiles(df, [("tile", 7, order)]), "id", "tile") == values(df.withColumn("tile", window), "id", "tile")


def test_passes_do_not_grow_with_places(frame, monkeypatch):
    df = frame(rows(3, 400, 5000), SCHEMA).cache()
    passes, counted = [], selection._value_counts
    monkeypatch.setattr(selection, "_value_counts", lambda *a: passes.append(1) or counted(*a))
    for many in (1, 40):
        passes.clear()
        selection.select_places(df, [(ORDERS[0], 1 + 9 * i) for i in range(many)])
        assert len(passes) <= 2
