"""Facts summed up per entity and per attribute of the entity.

Facts are always aggregated by their own key first. That step combines on the
map side, so a key with a third of all facts adds one row per map task, and the
dimension is joined to one row per key instead of to every fact. Dimension
tables hold one row per key. Facts without a dimension row form one group whose
attributes are null, as in a left join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .staging import stage


def rollup_by_attributes(
    facts: DataFrame,
    key: str,
    dimension: DataFrame,
    attributes: Sequence[str],
    measures: Mapping[str, tuple[Column, Column]],
    by: Sequence[str] = (),
) -> DataFrame:
    """Group facts by attributes of their dimension row (and by fact columns `by`).

    A measure is a pair: the aggregate over facts, and the aggregate that merges
    partial values of the same name.
    """
    per_key = facts.groupBy(key, *by).agg(*[partial.alias(n) for n, (partial, _) in measures.items()])
    named = dimension.select(F.col(key).alias("_dimension_key"), *[F.col(a).alias(f"_d_{a}") for a in attributes])
    joined = per_key.join(named, F.col(key) == F.col("_dimension_key"), "left")
    return joined.groupBy(*by, *[F.col(f"_d_{a}").alias(a) for a in attributes]).agg(
        *[merge.alias(n) for n, (_, merge) in measures.items()]
    )


def sums(**columns: str) -> dict[str, tuple[Column, Column]]:
    return {name: (F.sum(source), F.sum(name)) for name, source in columns.items()}


def rollup_by_entity(
    facts: DataFrame | Sequence[DataFrame],
    key: str,
    dimension: DataFrame,
    attributes: Sequence[str],
    measures: Mapping[str, Column],
    distinct: Mapping[str, str],
) -> DataFrame:
    """One row per entity with measures and distinct counts of fact columns.

    Each distinct count has its own aggregate, which shuffles nothing but the key
    and that column; the results are partitioned alike and joined without another
    shuffle. Facts without a dimension row need their distinct counts over all of
    them, so they are aggregated apart, and only where there are any. The
    aggregate is staged, so that this check does not read the facts again.
    Facts may come in parts that share no key (see `key_buckets`): a part that is
    bucketed by the key is aggregated without any shuffle.
    """
    parts = [facts] if isinstance(facts, DataFrame) else list(facts)
    aggregates = [m.alias(n) for n, m in measures.items()]
    counts = {n: F.countDistinct(column).alias(n) for n, column in distinct.items()}
    details = dimension.select(key, *[a for a in attributes if a != key])
    names = [*measures, *distinct]

    # A null key finds no partner here; it has no dimension row and is counted below.
    first, *others = ([aggregates] if aggregates else []) + [[count] for count in counts.values()]

    def of_part(part: DataFrame) -> DataFrame:
        found = part.groupBy(key).agg(*first)
        for count in others:
            found = found.join(part.groupBy(key).agg(*count), key, "left")
        return found

    per_key = stage(reduce(DataFrame.unionByName, map(of_part, parts)), "per-key")
    matched = per_key.join(details, key).select(*attributes, *names)

    lost = per_key.select(key).join(dimension.select(key), key, "left_anti").withColumnRenamed(key, "_lost")
    lost = stage(lost, "lost-keys")
    if lost.isEmpty():
        return matched
    facts = reduce(DataFrame.unionByName, parts)
    orphans = facts.join(lost, facts[key].eqNullSafe(lost["_lost"]), "left_semi").agg(*aggregates, *counts.values())
    types = dict((f.name, f.dataType) for f in details.schema)
    nulls = [F.lit(None).cast(types[a]).alias(a) for a in attributes]
    return matched.unionByName(orphans.select(*nulls, *names))
