import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Window, functions as F

from saleslens.operators import staging
from saleslens.operators.baskets import common_baskets, distinct_items, pair_counts, top_pairs
from saleslens.operators.keys import drop_repeated_keys, hot_keys, latest_per_key
from saleslens.operators.ranking import add_ntiles, number_rows, sorting, top_ranks
from saleslens.operators.rollup import rollup_by_attributes, rollup_by_entity, sums
from saleslens.operators.rows import metrics_to_rows, share_of_total
from saleslens.operators.sequences import joined_texts, with_neighbours

from conftest import plan_of, values


def skewed(rows=400, keys=12, seed=1):
    """(id, key, moment, value); one key holds a third of the rows, moments repeat."""
    rng = random.Random(seed)
    return [
        (i, "hot" if i % 3 == 0 else rng.choice([f"k{j}" for j in range(keys)] + [None]), rng.randrange(40), rng.choice([None, "a", "b"]))
        for i in range(rows)
    ]


SKEWED = "id long, key string, moment int, value string"


def test_number_rows_equals_window(frame):
    df = frame(skewed(), SKEWED).repartition(5)
    order = [F.desc("moment"), F.asc("id")]
    got = values(number_rows(df, order, "n"), "id", "n")
    assert got == values(df.withColumn("n", F.row_number().over(Window.orderBy(*order)).cast("long")), "id", "n")


def test_number_rows_uses_more_partitions_for_known_large_tables(frame, monkeypatch):
    monkeypatch.setattr("saleslens.operators.ranking.ROWS_PER_PARTITION", 20)
    df = frame(skewed(), SKEWED)
    got = values(number_rows(df, [F.asc("id")], "n", rows=400), "id", "n")
    assert got == [(i, i + 1) for i in sorted(range(400), key=lambda i: repr((i, i + 1)))]


@pytest.mark.parametrize("rows", [0, 1, 3, 7, 101])
@pytest.mark.parametrize("buckets", [4, 5, 7])
@pytest.mark.parametrize("order", [[("moment", True), ("id", True)], [("value", False), ("moment", False), ("id", True)], [("value", True), ("id", False)]])
def test_ntile_equals_window(frame, rows, buckets, order):
    df = frame(skewed(rows), SKEWED).repartition(3)
    expected = df.withColumn("t", F.ntile(buckets).over(Window.orderBy(*sorting(order))))
    assert values(add_ntiles(df, [("t", buckets, order)]), "id", "t") == values(expected, "id", "t")


def test_several_ntiles(frame):
    df = frame(skewed(50), SKEWED)
    tiles = [("a", 4, [("moment", False), ("id", True)]), ("b", 5, [("value", True), ("id", True)])]
    windows = {name: F.ntile(n).over(Window.orderBy(*sorting(order))) for name, n, order in tiles}
    got = add_ntiles(df, tiles)
    assert values(got, "id", "a", "b") == values(df.withColumns(windows), "id", "a", "b")
    assert not any(word in plan_of(got) for word in ("Window", "Exchange"))


def test_top_ranks_keep_ties(frame):
    df = frame([("a", 9), ("b", 9), ("c", 7), ("d", 7), ("e", 7), ("f", 5), ("g", None)], "k string, v long")
    assert values(top_ranks(df, "v", 3, "r"), "k", "r") == [("a", 1), ("b", 1), ("c", 3), ("d", 3), ("e", 3)]
    ranked = df.withColumn("r", F.rank().over(Window.orderBy(F.desc("v"))))
    for n in range(1, 8):
        assert values(top_ranks(df, "v", n, "r"), "k", "r") == values(ranked.filter(F.col("r") <= n), "k", "r")


def test_hot_keys(frame):
    df = frame(skewed(), SKEWED)
    assert values(hot_keys(df, ["key"], 100)) == [("hot",)]
    assert hot_keys(df, ["key"], 200) is None


def test_hot_keys_on_a_sample(spark):
    df = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"))
    assert values(hot_keys(df, ["key"], 50_000)) == [(0,)]


def test_latest_per_key_prunes_before_the_shuffle(frame):
    df = frame(skewed(), SKEWED)
    latest = latest_per_key(df, ["key"], [F.desc("moment"), F.asc("id")])
    best = {}
    for id_, key, moment, _ in skewed():
        best[key] = min(best.get(key, (0, 10**9)), (-moment, id_))
    assert values(latest, "key", "id") == sorted(((k, i) for k, (_, i) in best.items()), key=repr)
    before_shuffle = plan_of(latest).split("Exchange")[1]
    assert "WindowGroupLimit" in before_shuffle


def test_drop_repeated_keys(frame):
    df = frame(
        [(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, "b", None), (5, "b", None), (6, None, "x")],
        "id int, k1 string, k2 string",
    )
    assert values(drop_repeated_keys(df, ["k1", "k2"]), "id") == [(3,), (4,), (5,), (6,)]


def neighbours_by_hand(rows):
    groups = defaultdict(list)
    for id_, key, moment, value in rows:
        groups[key].append((moment, id_, value))
    out = []
    for key, group in groups.items():
        group.sort()
        for i, (_, id_, _) in enumerate(group):
            before = group[i - 1][2] if i else None
            after = group[i + 1][2] if i + 1 < len(group) else None
            out.append((id_, before, group[i - 1][1] if i else None, after))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot_rows,slice_rows", [(1000, 10), (100, 7), (100, 1), (5, 13), (1, 1000)])
def test_neighbours_equal_by_hand(frame, hot_rows, slice_rows):
    df = frame(skewed(), SKEWED).repartition(3)
    got = with_neighbours(
        df, "key", ["moment", "id"], {"before": "value", "before_id": "id"}, {"after": "value"}, hot_rows, slice_rows
    )
    assert got.columns == [*df.columns, "before", "before_id", "after"]
    assert values(got, "id", "before", "before_id", "after") == neighbours_by_hand(skewed())


@pytest.mark.parametrize("hot_rows,slice_rows", [(1000, 10), (100, 7), (5, 13), (1, 1)])
def test_joined_texts_equal_by_hand(frame, hot_rows, slice_rows):
    rows = [(i, k, m, v or "-") for i, k, m, v in skewed()]
    got = joined_texts(
        frame(rows, SKEWED),
        ["key"],
        ["moment", "id"],
        "value",
        " → ",
        "text",
        {"n": (F.count("*"), F.sum("n")), "top": (F.max("id"), F.max("top"))},
        hot_rows,
        slice_rows,
    )
    groups = defaultdict(list)
    for id_, key, moment, value in rows:
        groups[key].append((moment, id_, value))
    expected = [(k, " → ".join(v for *_, v in sorted(g)), len(g), max(i for _, i, _ in g)) for k, g in groups.items()]
    assert values(got) == sorted(expected, key=repr)


def baskets(seed=3):
    rng = random.Random(seed)
    lines = [(b, rng.randrange(30)) for b in range(60) for _ in range(rng.randrange(1, 6))]
    lines += [(999, i) for i in range(30) for _ in range(3)]  # one basket with most of the items
    return lines + [(None, 1), (5, None), (7, 3), (7, 3)]


def pairs_by_hand(lines):
    items = defaultdict(set)
    for basket, item in lines:
        if basket is not None and item is not None:
            items[basket].add(item)
    return Counter(pair for group in items.values() for pair in itertools.combinations(sorted(group), 2))


@pytest.mark.parametrize("large_basket", [2000, 8, 3, 1])
def test_pair_counts(frame, large_basket):
    items = distinct_items(frame(baskets(), "b int, i int"), "b", "i")
    got = pair_counts(items, large_basket)
    assert values(got) == sorted(((a, b, n) for (a, b), n in pairs_by_hand(baskets()).items()), key=repr)


@pytest.mark.parametrize("large_basket", [500, 20, 4, 1])
@pytest.mark.parametrize("seed_items,top_n", [(2, 1), (5, 1), (5, 7), (200, 7), (200, 30), (200, 1000)])
def test_top_pairs_hold_the_best(frame, seed_items, top_n, large_basket):
    lines = frame(baskets(), "b int, i int")
    known = frame([(i,) for i in range(25)], "i int")
    got, popularity = top_pairs(lines, "b", "i", known, top_n, seed_items, large_basket)
    counts = {pair: n for pair, n in pairs_by_hand(baskets()).items() if max(pair) < 25}
    ranked = sorted(counts.items(), key=lambda e: (-e[1], e[0]))
    least = ranked[min(top_n, len(ranked)) - 1][1]
    found = {(r.item_a, r.item_b): r.baskets for r in got.collect()}
    assert all(found[pair] == n for pair, n in ranked if n >= least)
    assert all(counts[pair] == n for pair, n in found.items() if n >= least)
    assert popularity.filter("item = 3").first().baskets == len({b for b, i in baskets() if i == 3 and b is not None})


def test_huge_basket_builds_no_pairs_of_its_own(frame):
    """Its pairs occur once, the best pairs more often: they are only looked up."""
    lines = [(b, i) for b in range(20) for i in (1, 2, 3)] + [(99, i) for i in range(1, 400)]
    known = frame([(i,) for i in range(400)], "i int")
    got, _ = top_pairs(frame(lines, "b int, i int"), "b", "i", known, top_n=3, large_basket=50)
    assert values(got) == [(1, 2, 21), (1, 3, 21), (2, 3, 21)]


def test_common_baskets(frame):
    items = distinct_items(frame(baskets(), "b int, i int"), "b", "i")
    popularity = items.groupBy("item").agg(F.count("*").alias("baskets"))
    pairs = frame([(1, 2), (3, 9), (28, 29)], "item_a int, item_b int")
    by_hand = pairs_by_hand(baskets())
    expected = [(a, b, by_hand[a, b]) for a, b in [(1, 2), (3, 9), (28, 29)] if by_hand[a, b]]
    assert values(common_baskets(pairs, items, popularity), "item_a", "item_b", "baskets") == sorted(expected, key=repr)


def test_common_baskets_spread_the_rarer_item(frame):
    """One item in every basket, its partners in one each: as many rows as partners."""
    lines = [(b, 1) for b in range(300)] + [(b, 1000 + b) for b in range(50)]
    items = frame(lines, "basket int, item int")
    popularity = items.groupBy("item").agg(F.count("*").alias("baskets"))
    pairs = frame([(1, 1000 + b) for b in range(50)], "item_a int, item_b int")
    got = common_baskets(pairs, items, popularity)
    assert values(got) == sorted(((1, 1000 + b, 1) for b in range(50)), key=repr)
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "AS other" in text and "(n_a" in text


def test_seeds_grow_until_they_make_pairs(frame):
    """Popular items that never meet do not open the count to all pairs."""
    lines = [(1000 * i + n, i) for i in range(20) for n in range(10)]  # popular, alone in their baskets
    lines += [(10**6 + 10 * p + n, i) for p in range(15) for n in range(3) for i in (100 + 2 * p, 101 + 2 * p)]
    lines += [(2 * 10**6 + p, i) for p in range(200) for i in (500 + 2 * p, 501 + 2 * p)]
    known = frame([(i,) for i in {i for _, i in lines}], "i int")
    got, _ = top_pairs(frame(lines, "b int, i int"), "b", "i", known, top_n=15, seed_items=20)
    assert len(values(got)) == 15 and {r.baskets for r in got.collect()} == {3}


FACTS = [("p1", "o1", 10), ("p1", "o1", 5), ("p2", "o1", 1), ("lost1", "o9", 7), ("lost2", "o9", 8), (None, "o8", 1)]


def test_rollup_by_attributes_keeps_orphans_in_one_group(frame):
    facts = frame(FACTS, "k string, o string, v int")
    dimension = frame([("p1", "x"), ("p2", "x"), ("p3", "y")], "k string, a string")
    got = rollup_by_attributes(facts, "k", dimension, ["a"], sums(total="v"))
    assert values(got) == [("x", 16), (None, 16)]


def test_rollup_by_entity_counts_distinct_over_all_orphans(frame):
    facts = frame(FACTS, "k string, o string, v int")
    dimension = frame([("p1", "x"), ("p2", "y"), ("p3", "z")], "k string, a string")
    measures, distinct = {"total": F.sum("v")}, {"orders": "o", "amounts": "v"}
    got = rollup_by_entity(facts, "k", dimension, ["k", "a"], measures, distinct)
    joined = facts.join(dimension, "k", "left").select(F.when(F.col("a").isNotNull(), F.col("k")).alias("k"), "a", "o", "v")
    expected = joined.groupBy("k", "a").agg(
        F.sum("v").alias("total"), F.countDistinct("o").alias("orders"), F.countDistinct("v").alias("amounts")
    )
    assert values(got) == values(expected)
    assert (None, None, 16, 2, 3) in values(got)


def test_rollup_by_entity_without_orphans(frame):
    facts = frame(FACTS[:3], "k string, o string, v int")
    dimension = frame([("p1", "x"), ("p2", "y")], "k string, a string")
    got = rollup_by_entity(facts, "k", dimension, ["a"], {}, {"orders": "o"})
    assert values(got) == [("x", 1), ("y", 1)]


def test_metrics_to_rows_equals_union(frame):
    df = frame([(1, 2.5)], "a long, b double")
    rows = metrics_to_rows(df, [("A", [F.col("a").cast("double")]), ("B", [F.col("b")])], ["metric", "value"])
    assert values(rows) == [("A", 1.0), ("B", 2.5)]
    assert rows.columns == ["metric", "value"]


def test_share_of_total(frame):
    df = frame([("a", 1), ("b", 3)], "k string, n long")
    assert values(df.withColumn("s", share_of_total(F.col("n"))), "k", "s") == [("a", 25.0), ("b", 75.0)]


class FakeContext:
    master, applicationId = "yarn", "app"


class FakeSession:
    sparkContext = FakeContext()

    class conf:
        @staticmethod
        def get(key, default=None):
            return default


def test_stage_keeps_rows_and_types(frame):
    df = frame(skewed(20), SKEWED)
    assert values(staging.stage(df)) == values(df)
    assert staging.stage(df).dtypes == df.dtypes


def test_stage_uses_the_folder_the_cluster_names():
    class Named(FakeSession):
        class conf:
            @staticmethod
            def get(key, default=None):
                return {"spark.checkpoint.dir": "/shared/checkpoints/"}.get(key, default)

    assert staging.shared_folder(Named()) == "/shared/checkpoints"


def test_stage_uses_the_warehouse_without_such_a_folder(spark):
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        assert staging.shared_folder(spark) == f"{spark.conf.get('spark.sql.warehouse.dir')}/staged"
    folder = f"{staging.shared_folder(spark)}/saleslens/{spark.sparkContext.applicationId}"
    assert staging.new_path(spark, "x").startswith(f"{folder}/x-")
