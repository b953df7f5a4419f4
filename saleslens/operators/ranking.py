"""Row numbers and buckets over a whole table without one big task."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, Row, Window, functions as F

from .selection import Order, can_select, figures_of, read_figures, select_places, sql_literal, whole_range
from .staging import stage

ROWS_PER_PARTITION = 5_000_000
_SLOT_BITS = 33


def number_rows(
    df: DataFrame, order: Sequence[Column], name: str = "row_number", rows: int | None = None
) -> DataFrame:
    """Exact 1-based row number in a total order (end the order with a unique key).

    Range partitions are sorted on their own; the number of a row is its place in
    its partition plus the rows of all earlier partitions. The partitioned rows
    are staged, as the range limits are sampled and both steps must see the same
    ones. Only one count per partition meets in a single task. Where the number of
    `rows` is known, it sets the number of partitions for large tables.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = (rows or 0) // ROWS_PER_PARTITION
    ranged = df.repartitionByRange(wanted, *order) if wanted > parts else df.repartitionByRange(*order)
    slotted = stage(
        ranged.sortWithinPartitions(*order).withColumn("_slot", F.monotonically_increasing_id()),
        "numbered",
    ).withColumn("_part", F.shiftright("_slot", _SLOT_BITS))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        slotted.groupBy("_part")
        .agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    )
    place = F.col("_slot").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1))
    return (
        slotted.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + place + 1)
        .drop("_part", "_slot", "_before")
    )


def sorting(order: Order) -> list[Column]:
    """Sort columns of (name, ascending) pairs; nulls first ascending, last descending."""
    return [F.asc(name) if ascending else F.desc(name) for name, ascending in order]


def bucket_starts(rows: int, buckets: int) -> list[int]:
    """Row numbers at which NTILE's second and later buckets begin: the first `rows % buckets` hold one row more."""
    size, larger = divmod(rows, buckets)
    starts = [i * size + min(i, larger) + 1 for i in range(1, buckets)]
    return [start for start in starts if start <= rows]


def _stands_before(order: Order, cut: Sequence[str | None]) -> str:
    """Condition that a row comes before the cut, of which the first columns are given as SQL literals (None: null)."""
    before = "false"
    for (name, ascending), at in reversed(list(zip(order, cut))):
        value = f"`{name}`"
        if at is None:
            first = "false" if ascending else f"{value} is not null"
            same = f"{value} is null"
        else:
            first = f"({value} is null or {value} < {at})" if ascending else f"coalesce({value} > {at}, false)"
            same = f"{value} <=> {at}"
        before = f"({first} or ({same} and {before}))"
    return before


def _cut_rows(df: DataFrame, order: Order, buckets: int, rows: int) -> list[Row]:
    """The first rows of the second and later buckets: located by the counts of sorted range partitions."""
    narrow = df.select(*dict.fromkeys(name for name, _ in order))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // ROWS_PER_PARTITION)
    columns = sorting(order)
    slotted = stage(
        narrow.repartitionByRange(parts, *columns).sortWithinPartitions(*columns).withColumn("_slot", F.monotonically_increasing_id()),
        "sorted",
    )
    counts = slotted.groupBy(F.shiftright("_slot", _SLOT_BITS).alias("part")).count().collect()
    slots, before = [], 0
    starts = bucket_starts(rows, buckets)
    for part, count in sorted(counts):
        slots += [(part << _SLOT_BITS) + start - before - 1 for start in starts if before < start <= before + count]
        before += count
    return slotted.filter(F.col("_slot").isin(slots)).orderBy("_slot").collect() if slots else []


def add_ntiles(df: DataFrame, tiles: Sequence[tuple[str, int, Order]]) -> DataFrame:
    """Add `NTILE(n) OVER (ORDER BY ...)` columns given as (name, n, total order).

    The table is staged once, and its percentiles are taken as it is written.
    Where the columns of an order can be counted (see `selection`), the n - 1
    rows at which buckets begin are found by counting, those of all tiles
    together; else, for texts and floats, the order columns
    are sorted by range. Every row is labelled by comparison with the first rows
    of the buckets, so no row meets another one.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    counted = [tile for tile in tiles if all(can_select(kinds[c]) for c, _ in tile[2])]
    ranges, seen = list(dict.fromkeys(whole_range(df, order) for _, _, order in counted)), Observation()
    result = stage(df.observe(seen, F.count(F.lit(1)).alias("rows"), *figures_of(ranges)), "ntile")
    figures = seen.get
    rows = figures["rows"]
    wanted = [(name, order, start) for name, buckets, order in counted for start in bucket_starts(rows, buckets)]
    found = select_places(result, [(order, start) for _, order, start in wanted], read_figures(ranges, figures))
    cuts: dict[str, list[Sequence[Any]]] = {}
    for (name, _, _), cut in zip(wanted, found):
        cuts.setdefault(name, []).append(cut)
    for name, buckets, order in tiles:
        if (name, buckets, order) not in counted:
            cuts[name] = [[cut[c] for c, _ in order] for cut in _cut_rows(result, order, buckets, rows)]
    labels = {}
    for name, _, order in tiles:
        spelled = [[None if v is None else sql_literal(v, kinds[c]) for v, (c, _) in zip(cut, order)] for cut in cuts.get(name, ())]
        labels[name] = F.expr(" + ".join(["1", *(f"if({_stands_before(order, cut)}, 0, 1)" for cut in spelled)]))
    return result.withColumns(labels)


def top_ranks(df: DataFrame, value: str, top_n: int, name: str) -> DataFrame:
    """Rows with RANK() OVER (ORDER BY value DESC) <= top_n, all ties included.

    The ranks that can occur come from the top n values; rows find theirs by a
    join to those few, so that ties never meet in one task.
    """
    best = df.select(value).orderBy(F.desc(value)).limit(top_n)
    placed = best.withColumn(name, F.row_number().over(Window.orderBy(F.desc(value))))
    ranks = placed.groupBy(F.col(value).alias("_value")).agg(F.min(name).alias(name))
    return df.join(F.broadcast(ranks), F.col(value).eqNullSafe(F.col("_value"))).drop("_value")
