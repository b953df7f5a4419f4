"""Items bought together."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .staging import stage

LARGE_BASKET = 500
SEED_ITEMS = 200


def distinct_items(lines: DataFrame, basket: str, item: str) -> DataFrame:
    """One row per basket and item, so that counting rows counts baskets."""
    return lines.select(F.col(basket).alias("basket"), F.col(item).alias("item")).dropna().distinct()


def with_sizes(items: DataFrame, name: str) -> DataFrame:
    """Each row with the number of items in its basket, which is counted before the shuffle and joined back."""
    sizes = items.groupBy("basket").agg(F.count("*").alias(name))
    return items.join(stage(sizes, "basket-sizes"), "basket")


def pair_counts(items: DataFrame, large_basket: int = LARGE_BASKET) -> DataFrame:
    """Baskets per pair item_a < item_b, from one row per basket and item.

    Pairs are counted while the join runs. A basket with more than `large_basket`
    items is cut: each part joins some of its items with all of them, and the
    parts go to different tasks.
    """
    sized = with_sizes(items, "_items")
    small = sized.filter(F.col("_items") <= large_basket).select("basket", "item")
    large = sized.filter(F.col("_items") > large_basket)
    parts = F.ceil(F.col("_items") / large_basket).cast("int")
    some = large.select("basket", F.pmod(F.hash("item"), parts).alias("part"), "item")
    every = large.select("basket", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "item")
    return _count(_pairs(small, small, ["basket"]).unionByName(_pairs(some, every, ["basket", "part"])))


def _pairs(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    a, b = left.withColumnRenamed("item", "item_a"), right.withColumnRenamed("item", "item_b")
    return a.join(b, on).filter("item_a < item_b").select("item_a", "item_b")


def _count(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("item_a", "item_b").agg(F.count("*").alias("baskets"))


def common_baskets(pairs: DataFrame, items: DataFrame, popularity: DataFrame) -> DataFrame:
    """Baskets that hold both items, for given pairs only: no other pair is built.

    The rarer item of a pair is spread over its baskets, and the other one looked up there.
    `popularity` has the number of `baskets` of each `item` of `items`.
    """
    counts = [popularity.select(F.col("item").alias(f"item_{s}"), F.col("baskets").alias(f"n_{s}")) for s in "ab"]
    placed = pairs.select("item_a", "item_b").join(counts[0], "item_a").join(counts[1], "item_b")
    rarer_a = F.col("n_a") <= F.col("n_b")
    rare = placed.select(
        "item_a",
        "item_b",
        F.when(rarer_a, F.col("item_a")).otherwise(F.col("item_b")).alias("item"),
        F.when(rarer_a, F.col("item_b")).otherwise(F.col("item_a")).alias("other"),
    )
    spread = rare.join(items.select("basket", "item"), "item").select("item_a", "item_b", "basket", "other")
    return _count(spread.join(items.select("basket", F.col("item").alias("other")), ["basket", "other"]))


def top_pairs(
    lines: DataFrame,
    basket: str,
    item: str,
    known_items: DataFrame,
    top_n: int,
    seed_items: int = SEED_ITEMS,
    large_basket: int = LARGE_BASKET,
) -> tuple[DataFrame, DataFrame]:
    """(counts of pairs, with every pair of the top n, ties included; popularity).

    A pair occurs in no more baskets than either of its items. The n-th best count
    among the pairs of the most popular items is a lower limit for the true n-th
    best, so items in fewer baskets than that can be left out before pairing. The
    popular items are doubled until they make n pairs.
    """
    items = stage(with_sizes(stage(distinct_items(lines, basket, item), "distinct"), "size"), "items")
    marked = known_items.select(F.col(item).alias("item")).distinct().withColumn("known", F.lit(True))
    counted = items.groupBy("item").agg(F.count("*").alias("baskets")).join(marked, "item", "left")
    popularity = stage(counted, "popularity")
    known, popularity = popularity.filter("known").drop("known"), popularity.drop("known")

    least, all_items = 1, known.count()
    while True:
        seeds = known.orderBy(F.desc("baskets"), "item").limit(seed_items).select("item")
        seeded = items.join(seeds, "item", "left_semi").select("basket", "item")
        if seed_items <= large_basket:  # then no basket can hold more of them
            seed_pairs = _count(_pairs(seeded, seeded, ["basket"]))
        else:
            seed_pairs = pair_counts(stage(seeded, "seeded"), large_basket)
        best = seed_pairs.orderBy(F.desc("baskets")).limit(top_n)
        found, worst = best.agg(F.count("*"), F.min("baskets")).first()
        if found == top_n:
            least = worst
            break
        if seed_items >= all_items:
            break
        seed_items *= 2

    kept = known.filter(F.col("baskets") >= least).select("item")
    kept_items = items.join(kept, "item", "left_semi")
    small = kept_items.filter(F.col("size") <= large_basket).select("basket", "item")
    large = kept_items.filter(F.col("size") > large_basket).select("basket", "item")
    counts = _count(_pairs(small, small, ["basket"]))
    if not large.isEmpty():
        counts = _add_large_baskets(counts, stage(large, "large-baskets"), least, large_basket)
    return counts, popularity


def _add_large_baskets(small: DataFrame, large: DataFrame, least: int, large_basket: int) -> DataFrame:
    """Add the large baskets to the counts, as far as a pair can still reach `least`.

    A pair from large baskets alone needs both items in at least `least` of them,
    which one or a few huge baskets cannot offer: only pairs of such items are
    built. All other pairs must come from small baskets with a count that can
    reach `least`, and are looked up one by one.
    """
    spread = stage(large.groupBy("item").agg(F.count("*").alias("large")), "large-items")
    often = spread.filter(F.col("large") >= least).select("item")
    built = pair_counts(large.join(often, "item", "left_semi").select("basket", "item"), large_basket)

    def of(side: str) -> DataFrame:
        return spread.select(F.col("item").alias(f"item_{side}"), F.col("large").alias(f"large_{side}"))

    bound = F.least(F.coalesce("large_a", F.lit(0)), F.coalesce("large_b", F.lit(0)))
    open_pairs = stage(
        small.join(of("a"), "item_a", "left")
        .join(of("b"), "item_b", "left")
        .withColumn("_more", bound)
        .filter(F.col("baskets") + F.col("_more") >= least),
        "open-pairs",
    )
    lookup = open_pairs.filter((F.col("_more") > 0) & (F.col("_more") < least))
    parts = [open_pairs.select("item_a", "item_b", "baskets"), built, common_baskets(lookup, large, spread.withColumnRenamed("large", "baskets"))]
    return (
        parts[0]
        .unionByName(parts[1])
        .unionByName(parts[2])
        .groupBy("item_a", "item_b")
        .agg(F.sum("baskets").alias("baskets"))
        .filter(F.col("baskets") >= least)
    )
