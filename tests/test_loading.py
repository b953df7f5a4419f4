"""Loads that replace tables together, declared limits, storage by month."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from saleslens.operators.limits import REASONS, Limit, with_reasons
from saleslens.operators.months import in_period, month_column, with_month
from saleslens.plans import finance, warehouse
from saleslens.sources import csv_tables, given_loads, published, schemas

from conftest import plan_of, values

HEADER = ",".join(schemas.FACT_SALES.names)
LINES = ["SO1,1,2,2024-01-01,,2024-01-09,100,1,100", "SO2,3,4,,2024-01-02,2024-01-09,7,255,7"]
PAIR = schemas.table_schema("k integer, t string")


def extract(folder, name, lines, header=HEADER):
    path = folder / name
    path.write_text("\n".join([header, *lines]) + "\n")
    return str(path)


def files_below(folder):
    return sorted(str(p.relative_to(folder)) for p in Path(folder).rglob("*") if p.is_file())


def test_a_bad_extract_leaves_the_stored_rows(spark, tmp_path):
    target = str(tmp_path / "gold")
    csv_tables.load_tables(spark, {"fact_sales": extract(tmp_path, "a.csv", LINES)}, target)
    before = files_below(target)
    bad = extract(tmp_path, "b.csv", [LINES[0], "SO3,x,4,2024-01-01,,,7,1,7"])
    with pytest.raises(csv_tables.RejectedLines, match="SO3"):
        csv_tables.load_tables(spark, {"fact_sales": bad}, target)
    assert files_below(target) == before
    stored = published.open_table(spark, target, "fact_sales", schemas.FACT_SALES)
    assert values(stored, "order_number", "quantity") == [("SO1", 1), ("SO2", 255)]


def test_tables_are_replaced_together_or_not_at_all(spark, tmp_path):
    target = str(tmp_path / "gold")
    kinds = {"one": PAIR, "two": PAIR}

    def load(one, two):
        sources = {"one": extract(tmp_path, "1.csv", one, "k,t"), "two": extract(tmp_path, "2.csv", two, "k,t")}
        return csv_tables.load_tables(spark, sources, target, kinds)

    load(["1,a"], ["2,b"])
    with pytest.raises(csv_tables.RejectedLines):
        load(["7,new"], ["x,new"])
    assert [values(published.open_table(spark, target, n)) for n in kinds] == [[(1, "a")], [(2, "b")]]
    load(["7,new"], [])
    assert [values(published.open_table(spark, target, n, PAIR)) for n in kinds] == [[(7, "new")], []]


def test_a_file_that_cannot_be_read_leaves_the_stored_rows(spark, tmp_path):
    target = str(tmp_path / "gold")
    csv_tables.load_tables(spark, {"t": extract(tmp_path, "a.csv", ["1,a"], "k,t")}, target, {"t": PAIR})
    with pytest.raises(Exception):
        csv_tables.load_tables(spark, {"t": str(tmp_path / "none.csv")}, target, {"t": PAIR})
    failing = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("k"))
    with pytest.raises(Exception, match="lost"):
        published.publish(spark, target, {"t": failing})
    assert values(published.open_table(spark, target, "t")) == [(1, "a")]
    assert len(published.names_in(spark, f"{target}/t")) == 1


def test_a_reader_keeps_its_version(spark, tmp_path):
    target = str(tmp_path / "gold")
    published.publish(spark, target, {"t": spark.range(3), "u": spark.range(1)})
    reader, old = published.open_table(spark, target, "t"), published.path_of(spark, target, "t")
    published.publish(spark, target, {"t": spark.range(5)})
    assert reader.count() == 3 and published.open_table(spark, target, "t").count() == 5
    assert published.open_table(spark, target, "u").count() == 1
    assert published.remove_old(spark, target) == [old] and published.remove_old(spark, target) == []
    assert published.open_table(spark, target, "t").count() == 5


def test_a_check_stops_the_switch(spark, tmp_path):
    target = str(tmp_path / "gold")

    def full(name, stored):
        if stored.isEmpty():
            raise ValueError(f"{name} is empty")

    with pytest.raises(ValueError, match="t is empty"):
        published.publish(spark, target, {"t": spark.range(0)}, check=full)
    assert published.versions(spark, target) == {}
    with pytest.raises(LookupError):
        published.open_table(spark, target, "t")


def test_some_bad_lines_can_be_allowed(spark, tmp_path):
    path = extract(tmp_path, "a.csv", ["1,a", "x,b", "3,c", "4"], "k,t")
    with pytest.raises(csv_tables.RejectedLines):
        csv_tables.load_tables(spark, {"t": path}, str(tmp_path / "g"), {"t": PAIR}, max_rejects=1)
    loaded = csv_tables.load_tables(spark, {"t": path}, str(tmp_path / "g"), {"t": PAIR}, max_rejects=2)
    assert values(loaded["t"]) == [(1, "a"), (3, "c")]


def test_every_reason_is_named(spark, tmp_path):
    lines = [
        *LINES,
        f"{'S' * 51},1,2,2024-01-01,,,7,256,7",
        "SO4,x,2,2024-13-01,,,7,-1,7",
        "SO5,1,2,,,,7,99999,7",
        "SO6,1,2",
        "SO7,1,2,,,,7,1,7,8",
        f"{'ü' * 50},,,,,,,,",
        ",,,,,,,,",
    ]
    path = extract(tmp_path, "a.csv", lines)
    found = csv_tables.rejects(spark, path, schemas.FACT_SALES, schemas.GOLD_LIMITS["fact_sales"])
    assert {r.rejected_line[:3]: r.reasons for r in found.collect()} == {
        "SSS": ["order_number: longer than 50", "quantity: above 255"],
        "SO4": ["product_key: not int", "order_date: not date", "quantity: below 0"],
        "SO5": ["quantity: not smallint"],
        "SO6": ["not 9 fields"],
        "SO7": ["not 9 fields"],
    }
    assert set(lines[2:7]) == {r.rejected_line for r in found.collect()}
    with pytest.raises(csv_tables.RejectedLines, match="5 lines of fact_sales"):
        csv_tables.load_tables(spark, {"fact_sales": path}, str(tmp_path / "g"), limits=schemas.GOLD_LIMITS)


def test_limits_and_nulls(frame):
    df = frame([("1", None, "x"), (None, "abc", "y"), ("12", "abcd", None), ("z", "", "w")], "n string, t string, _kept string")
    schema = schemas.table_schema("n integer, t string")
    found = with_reasons(df, schema, {"n": Limit(least=2, most=10, required=True), "t": Limit(longest=3)})
    assert found.columns == ["n", "t", "_kept", REASONS]
    assert {r["_kept"]: (r.n, r[REASONS]) for r in found.collect()} == {
        "x": (1, ["n: below 2"]),
        "y": (None, ["n: missing"]),
        None: (12, ["n: above 10", "t: longer than 3"]),
        "w": (None, ["n: not int"]),
    }


def test_checks_group_each_column_by_itself(frame):
    rows = [(1, "b", None), (1, "", None), (None, None, None), (-2, "b", None), (1, "b", None)]
    found = given_loads.column_checks("t", frame(rows, "k integer, `a.b` string, d date"))
    assert "Expand" not in plan_of(found)
    assert values(found) == [
        ("t", "a.b", 5, 4, 2, "", "b"),
        ("t", "d", 5, 0, 0, None, None),
        ("t", "k", 5, 4, 2, "-2", "1"),
    ]
    assert values(given_loads.column_checks("t", frame([], "k integer"))) == [("t", "k", 0, 0, 0, None, None)]


# storage by month


SALES = [
    (f"SO{i}", i % 5, i % 7, dt.date(2023 + i % 3, 1 + i % 12, 1 + i % 28) if i % 11 else None, None, None, i, 1, i)
    for i in range(300)
]


def monthly(spark, tmp_path, df, column):
    kept = with_month(df, column)
    published.publish(spark, str(tmp_path / "m"), {"t": kept}, {"t": [month_column(column)]})
    return published.open_table(spark, str(tmp_path / "m"), "t", kept.schema)


def partition_filters(df):
    return [line for line in plan_of(df).splitlines() if "FileScan" in line][0].split("PartitionFilters: ")[1].split("PushedFilters")[0]


@pytest.mark.parametrize(
    "start, end",
    [(None, None), (dt.date(2024, 3, 15), None), (None, dt.date(2024, 2, 1)), (dt.date(2023, 12, 31), dt.date(2024, 1, 1))],
)
def test_a_period_is_the_same_in_both_layouts(spark, tmp_path, start, end):
    plain = spark.createDataFrame(SALES, schemas.FACT_SALES)
    stored = monthly(spark, tmp_path, plain, "order_date")
    got, want = (in_period(df, "order_date", start, end) for df in (stored, plain))
    assert values(got, *plain.columns) == values(want, *plain.columns)
    assert want.count() == sum(r[3] is not None and (not start or r[3] >= start) and (not end or r[3] < end) for r in SALES)
    assert "order_date_month" in partition_filters(got)


def test_jobs_prune_months(spark, tmp_path):
    sales = monthly(spark, tmp_path, spark.createDataFrame(SALES, schemas.FACT_SALES), "order_date")
    plan = plan_of(in_period(sales, "order_date", dt.date(2025, 1, 1)))
    assert "order_date_month" in partition_filters(warehouse._dated_sales({"fact_sales": sales})) and "PartitionFilters" in plan
    folders = {f.split("order_date_month=")[1][:10] for f in in_period(sales, "order_date", dt.date(2025, 6, 5)).inputFiles()}
    assert {"2025-06-01"} <= folders
    rows = [(i, i % 4, dt.datetime(2024, 1 + i % 12, 3), i % 2, "completed", "mobile", float(i)) for i in range(60)]
    schema = (
        "transaction_id int, customer_id int, transaction_date timestamp_ntz, is_fraudulent int, transaction_status string, "
        "device_type string, amount double"
    )
    plain = spark.createDataFrame(rows, schema).withColumn("amount", F.col("amount").cast("decimal(12,2)"))
    stored = monthly(spark, tmp_path / "f", plain, "transaction_date")
    start = dt.date(2024, 6, 2)
    got = finance.fin_kpis({"financial_transactions": stored}, start)
    assert values(got) == values(finance.fin_kpis({"financial_transactions": plain}, start))
    assert "transaction_date_month" in partition_filters(got)
