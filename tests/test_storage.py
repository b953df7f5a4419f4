"""Stored changes, monthly bitmaps, facts in buckets of their key."""

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from saleslens.operators.key_buckets import store_by_key
from saleslens.operators.period_bitmaps import PERIODS, monthly_bitmaps, roll_up
from saleslens.plans import cleaning, warehouse
from saleslens.sources import schemas
from saleslens.sources.changes import StoredTable, delete_keys, update_where

from conftest import plan_of, values

# UPDATE and DELETE

RECORDS = "id long, name string, n int, part string"
ROWS = [(1, "a", 1, "p"), (2, "b", None, "p"), (3, "a", 3, "q"), (4, None, 4, "q"), (5, "c", 5, None), (6, "d", 6, "r s/=%"), (7, "b", 7, "t")]


@pytest.fixture
def table(frame, tmp_path):
    return StoredTable.create(frame(ROWS, RECORDS), str(tmp_path / "table"), "part")


def files(table):
    return {(p.parent.name, p.name) for p in Path(table.path).rglob("*.parquet")}


def others(found, *folders):
    return {f for f in found if f[0] not in folders}


def rows(spark, table):
    return sorted((tuple(r) for r in table.read(spark).select("id", "name", "n", "part").collect()), key=repr)


def test_update_writes_only_its_partitions(spark, table):
    before = files(table)
    assert update_where(spark, table, F.col("name") == "a", {"n": F.col("n") + 10, "name": F.lit("A")}) == ["p", "q"]
    expected = [(i, "A" if name == "a" else name, n + 10 if name == "a" else n, part) for i, name, n, part in ROWS]
    assert rows(spark, table) == sorted(expected, key=repr)
    assert others(before, "part=p", "part=q") == others(files(table), "part=p", "part=q") != set()
    assert not (before - others(before, "part=p", "part=q")) & files(table)


def test_update_that_meets_no_row_writes_nothing(spark, table):
    before = files(table)
    assert update_where(spark, table, F.col("n") > 100, {"name": F.lit("x")}) == []
    assert update_where(spark, table, F.lit(None).cast("boolean"), {"name": F.lit("x")}) == []
    assert files(table) == before


def test_update_of_odd_partitions(spark, table):
    assert update_where(spark, table, F.col("id").isin(5, 6), {"name": F.lit(None)}) == sorted(["r s/=%", None], key=repr)
    assert [r[1] for r in rows(spark, table) if r[0] in (5, 6)] == [None, None] and len(rows(spark, table)) == 7


def test_rows_cannot_move(spark, table):
    with pytest.raises(ValueError, match="part"):
        update_where(spark, table, F.col("id") == 1, {"part": F.lit("q")})


def test_delete_by_keys(spark, table, frame):
    before = files(table)
    doomed = frame([(2, "b"), (4, None), (7, "b"), (7, "b"), (99, "z"), (1, "b")], "id long, name string")
    assert delete_keys(spark, table, doomed) == ["p", "q", "t"]
    assert rows(spark, table) == sorted((r for r in ROWS if r[0] not in (2, 4, 7)), key=repr)
    assert others(files(table), "part=p", "part=q") == others(before, "part=p", "part=q", "part=t")
    assert not (Path(table.path) / "part=t").exists()
    assert delete_keys(spark, table, doomed) == []


def test_patients_are_cleaned_in_place(spark, tmp_path):
    schema = (
        "record_id int, patient_id int, first_name string, last_name string, date_of_birth date, admission_date string, "
        "gender string, patient_address string, phone_number string"
    )
    day = dt.date(1980, 1, 1)
    clean = ("2024-03-05", "Male", "1 A St, B, C", "555")
    records = [
        (1, 1, "a", "b", day, "2024-01-05", "M", "1 A St, B, C", None),
        (2, 1, "a", "b", day, "2024-02-05 08:00:00", "f", "PO", ""),
        (3, 2, "c", None, day, "n/a", "Male", "x", "1"),
        *((10 + i, 10 + i, "n", "m", day, *clean) for i in range(3)),
    ]
    tables = {"patient_records": spark.createDataFrame(records, schema)}
    table = cleaning.store_records(tables, str(tmp_path / "patients"))
    before = files(table)
    got = cleaning.clean_stored(spark, table)
    expected = cleaning.patient_clean(tables)
    assert values(got, *sorted(got.columns)) == values(expected, *sorted(expected.columns)) and got.count() == 5
    untouched = {f for f in before if f[0] == "admission_month=2024-03-01"}
    assert untouched and untouched <= files(table)


# bitmaps of months


def test_months_roll_up_to_exact_counts(frame):
    draw = random.Random(4)
    ids = [None, 0, -1, -40_000, 1, 32_768, 32_769, 10**12, *range(50)]
    facts = [
        (draw.choice(ids), draw.choice([None, dt.date(draw.randint(2022, 2024), draw.randint(1, 12), draw.randint(1, 28))]), i, i % 3)
        for i in range(3000)
    ]
    df = frame(facts, "id long, day date, amount int, shop int")
    monthly = monthly_bitmaps(df, "day", "id", {"total": "amount"}, by=["shop"]).cache()
    for period in PERIODS:
        exact = (
            df.filter("day is not null")
            .groupBy(F.trunc("day", period).alias("period_start"), "shop")
            .agg(F.countDistinct("id").alias("people"), F.sum("amount").alias("total"))
        )
        assert values(roll_up(monthly, period, ["total"], "people", ["shop"])) == values(exact)
    with pytest.raises(ValueError):
        roll_up(monthly, "WEEK", [], "people")


def test_sales_by_periods_of_no_sales(spark):
    assert warehouse.sales_by_periods({"fact_sales": spark.createDataFrame([], schemas.FACT_SALES)}).count() == 0


# facts by key


def star(spark):
    day = dt.date(2024, 1, 1)
    sales = [
        (f"SO{i % 70}", i % 9 if i % 3 else 1, i % 13 if i % 17 else None, day + dt.timedelta(i) if i % 19 else None, None, None, 10 * i, i % 4, 5)
        for i in range(600)
    ]
    return {
        "fact_sales": spark.createDataFrame(sales, schemas.FACT_SALES),
        "dim_products": spark.createDataFrame([(k, k, "n", f"p{k}", "c", "c", "s", "y", 5, "l", day) for k in range(7)], schemas.DIM_PRODUCTS),
        "dim_customers": spark.createDataFrame(
            [(k, k, f"c{k}", "f", "l", "x", "m", "g", dt.date(1980, 1, 1), day) for k in range(11)], schemas.DIM_CUSTOMERS
        ),
    }


@pytest.mark.parametrize("hot_rows", [50, 10_000])
def test_reports_over_facts_by_key(spark, tmp_path, hot_rows):
    tables, as_of = star(spark), dt.date(2025, 6, 1)
    for key, report in (("product_key", warehouse.report_products), ("customer_key", warehouse.report_customers_fixed)):
        expected = values(report(tables, as_of))
        stored = store_by_key(tables["fact_sales"], key, f"t_{key}_{hot_rows}", str(tmp_path / key), 3, hot_rows=hot_rows)
        assert (stored.hot is not None) == (hot_rows == 50 and key == "product_key")
        assert values(report(tables | {f"fact_sales_by_{key}": stored}, as_of)) == expected


def test_aggregates_by_the_key_need_no_exchange(spark, tmp_path):
    stored = store_by_key(star(spark)["fact_sales"], "product_key", "t_plan", str(tmp_path / "t"), 4, ["order_number", "customer_key"])
    (part,) = stored.parts(spark)
    assert part.columns == ["product_key", "order_number", "customer_key"]
    counts = [part.groupBy("product_key").agg(F.countDistinct(c).alias(c)) for c in ("order_number", "customer_key")]
    assert "Exchange" not in plan_of(counts[0])
    joined = counts[0].join(counts[1].hint("merge"), "product_key")
    assert "Exchange" not in plan_of(joined)
