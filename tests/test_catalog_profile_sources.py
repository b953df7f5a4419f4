import datetime as dt

import pytest

from saleslens.plans import catalog, profile, warehouse
from saleslens.sources import csv_tables, schemas

from conftest import plan_of, values


def day(text):
    return dt.date.fromisoformat(text) if text else None


@pytest.fixture
def extracts(spark):
    products = [
        (1, "AA-BB-TENT-1", "Tent", None, "R ", day("2001-02-03"), None),
        (2, "CC-DD-LAMP-7", "Lamp", 20, "S ", day("2005-01-10"), day("2002-01-01")),
        (3, "CC-DD-LAMP-7", "Lamp", 22, "S ", day("2006-01-10"), day("2003-01-01")),
        (4, "CC-DD-LAMP-7", "Lamp", 21, "S ", day("2007-01-10"), None),
        (5, "EE-FF-ROPE-3", "Rope", 8, None, day("2007-01-10"), None),
    ]
    categories = [("CC_DD", "Light", "Lamps", "Yes"), ("AA_BB", "Camp", "Tents", "Yes")]
    return {
        "crm_prd_info": spark.createDataFrame(products, schemas.CRM_PRD_INFO),
        "erp_px_cat": spark.createDataFrame(categories, schemas.ERP_PX_CAT),
    }


def test_build_dim_products(extracts):
    got = [tuple(r) for r in catalog.build_dim_products(extracts).orderBy("product_key").collect()]
    assert got == [
        (1, 1, "TENT-1", "Tent", "AA_BB", "Camp", "Tents", "Yes", 0, "Road", day("2001-02-03")),
        (2, 4, "LAMP-7", "Lamp", "CC_DD", "Light", "Lamps", "Yes", 21, "Other Sales", day("2007-01-10")),
        (3, 5, "ROPE-3", "Rope", "EE_FF", None, None, None, 8, "n/a", day("2007-01-10")),
    ]


@pytest.mark.parametrize("hot_rows", [1, 100])
def test_versions_end_before_the_next(extracts, hot_rows):
    got = dict(values(catalog.product_versions(extracts, hot_rows=hot_rows, slice_rows=2), "prd_id", "prd_end_dt"))
    assert got == {1: None, 2: day("2006-01-09"), 3: day("2007-01-09"), 4: None, 5: None}


def test_conformed_categories(extracts):
    loaded = dt.datetime(2020, 2, 3, 4, 5, 6, 700000)
    got = catalog.conform_categories(extracts, loaded)
    assert {r.dwh_create_date for r in got.collect()} == {loaded}
    assert values(got.drop("dwh_create_date")) == values(extracts["erp_px_cat"])


def test_report_check_finds_each_violation(spark):
    good = (3, "a", "b", "c", 1, day("2020-01-20"), 60, "High-Performer", 10, 20, 60000, 20, 20, 3000.0, 3000, 6000)
    bad = (4, "a", "b", "c", 1, day("2020-01-20"), 59, "Mid-Range", 0, 0, 50001, 20, 20, 1.0, 5, 7)
    report = spark.createDataFrame([good, bad], schemas.REPORT_PRODUCTS)
    assert dict(values(catalog.check_report_products(report, dt.date(2025, 1, 1)))) == {
        "product_segment": 1,
        "avg_order_revenue": 1,
        "avg_monthly_revenue": 1,
        "recency_in_months": 1,
    }


def test_profiles(frame):
    df = frame([(1, "a", None), (2, "bbb", None), (2, None, None)], "n int, t string, d date")
    assert values(profile.profile_tables({"one": df, "two": df.limit(0)})) == [("one", 3, 3), ("two", 0, 3)]
    expected = [
        ("d", "date", 3, None, None, None, 0),
        ("n", "int", 0, 1, "1", "2", 2),
        ("t", "string", 1, 3, "a", "bbb", 2),
    ]
    for exact in (False, True):  # so few values are counted exactly by sketches, too
        assert values(profile.profile_columns(df, exact=exact), *profile.NAMES) == expected
        empty = [(c, kind, 0, None, None, None, 0) for c, kind, *_ in expected]
        assert values(profile.profile_columns(df.limit(0), exact=exact), *profile.NAMES) == empty


def test_sketches_merge_and_stay_within_their_error(spark):
    days = spark.range(200_000).selectExpr(
        "id % 10 as day", "id as n", "cast(id % 3000 as string) as t", "date '2020-01-01' + cast(id % 700 as int) as d", "id / 7 as x"
    )
    stored = profile.sketch_columns(days, by=["day"])
    assert stored.count() == 10
    halves = profile.merge_profiles(stored.withColumn("half", stored.day % 2), by=["half"])
    merged = profile.show_profile(halves, dict(days.drop("day").dtypes))
    whole = {r.column_name: r for r in profile.profile_columns(days.drop("day"), exact=True).collect()}
    for row in merged.collect():
        exact = whole[row.column_name].distinct_count
        assert abs(row.distinct_count - exact) <= 4 * profile.sketch_error() * exact
        assert row[:6] == whole[row.column_name][:6]
    assert [r.distinct_count for r in whole.values()] == [700, 200_000, 3000, 200_000]


def test_sketches_need_one_aggregate(spark):
    df = spark.range(10).selectExpr("id as a", "id as b", "cast(id as string) as c")
    plan = plan_of(profile.sketch_columns(df))
    assert plan.count("Exchange SinglePartition") == 1 and "Expand" not in plan and "Join" not in plan


HEADER = ",".join(schemas.FACT_SALES.names)
LINES = ["SO1,1,2,2024-01-01,,2024-01-09,100,1,100", "SO2,3,4,,2024-01-02,2024-01-09,7,255,7"]


def write(folder, name, lines):
    (folder / name).write_text("\n".join([HEADER, *lines]) + "\n")
    return str(folder / name)


def test_load_replaces_the_table(spark, tmp_path):
    target = str(tmp_path / "gold")
    for lines in (LINES, LINES[:1]):
        loaded = csv_tables.load_tables(spark, {"fact_sales": write(tmp_path, "f.csv", lines)}, target)
        assert loaded["fact_sales"].count() == len(lines)
    assert loaded["fact_sales"].schema == schemas.FACT_SALES
    row = loaded["fact_sales"].first()
    assert (row.order_date, row.shipping_date, row.quantity) == (day("2024-01-01"), None, 1)
    assert warehouse.total_sales(loaded).first().total_sales == 100


def test_bad_lines_stop_the_load_and_can_be_listed(spark, tmp_path):
    bad = "SO3,x,4,2024-01-01,,,7,1,7"
    path = write(tmp_path, "f.csv", [*LINES, bad])
    with pytest.raises(Exception):
        csv_tables.load_tables(spark, {"fact_sales": path}, str(tmp_path / "gold"))
    rejected = csv_tables.rejected_lines(spark, path, schemas.FACT_SALES)
    assert [r[csv_tables.REJECT] for r in rejected.collect()] == [bad]
    assert csv_tables.rejected_lines(spark, write(tmp_path, "g.csv", LINES), schemas.FACT_SALES).count() == 0


def test_extracts_keep_quotes_and_read_empty_texts_as_null(spark, tmp_path):
    rows = [(1, 'Bolt "L"', "x y", 5), (2, "", None, None), (3, "it's; 50%", "#", 7)]
    df = spark.createDataFrame(rows, "k int, a string, b string, n int")
    csv_tables.write_csv(df, str(tmp_path / "extract"))
    stored = csv_tables.load_tables(spark, {"t": str(tmp_path / "extract")}, str(tmp_path / "gold"), {"t": df.schema})["t"]
    assert values(stored) == [(1, 'Bolt "L"', "x y", 5), (2, None, None, None), (3, "it's; 50%", "#", 7)]


@pytest.mark.parametrize("text", ["a,b", "a\nb"])
def test_extracts_have_no_place_for_separators(spark, tmp_path, text):
    df = spark.createDataFrame([(1, text)], "k int, a string")
    with pytest.raises(Exception, match="comma or a line break"):
        csv_tables.write_csv(df, str(tmp_path / "extract"))
