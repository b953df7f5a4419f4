import datetime as dt

import pytest

from saleslens.plans import warehouse

from conftest import plan_of, values

AS_OF = dt.date(2024, 4, 30)
DIM_PRODUCTS = (
    "product_key int, product_id int, product_number string, product_name string, category_id string, "
    "category string, subcategory string, maintenance string, cost int, product_line string, start_date date"
)
DIM_CUSTOMERS = (
    "customer_key int, customer_id int, customer_number string, first_name string, last_name string, "
    "country string, marital_status string, gender string, birthdate date, create_date date"
)
FACT_SALES = (
    "order_number string, product_key int, customer_key int, order_date date, shipping_date date, due_date date, "
    "sales_amount int, quantity int, price int"
)


def day(text):
    return dt.date.fromisoformat(text) if text else None


@pytest.fixture
def make(frame):
    def tables(sales=(), products=(), customers=()):
        return {
            "dim_products": frame(
                [(k, k, f"N{k}", name, "C", cat, "sub", "Yes", cost, "Road", None) for k, name, cat, cost in products],
                DIM_PRODUCTS,
            ),
            "dim_customers": frame(
                [(k, k, f"C{k}", first, last, country, "Single", "Male", day(born), None) for k, first, last, country, born in customers],
                DIM_CUSTOMERS,
            ),
            "fact_sales": frame(
                [(o, p, c, day(d), None, None, amount, q, price) for o, p, c, d, amount, q, price in sales], FACT_SALES
            ),
        }

    return tables


PRODUCTS = [(1, "Bike", "Bikes", 1000), (2, "Tube", "Parts", 99), (3, "Chain", "Parts", 100), (4, "Bell", None, None), (5, "Bike", "Bikes", 501)]
CUSTOMERS = [(1, "Ann", "Lee", "IT", "1990-12-31"), (2, "Bob", None, "FR", "2010-01-01"), (3, "Cy", "Ray", "IT", None)]
SALES = [
    ("o1", 1, 1, "2023-01-31", 3000, 1, 3000),
    ("o1", 2, 1, "2023-01-31", 10, 2, 5),
    ("o2", 1, 1, "2024-02-01", 2991, 1, 2991),
    ("o3", 2, 2, None, 7, 0, 7),
    ("o4", 9, 9, "2024-03-05", 40, 1, 40),
    ("o5", 8, None, "2024-04-05", 60, 3, 20),
    ("o5", 5, 2, "2024-04-05", 60, 0, 20),
]


@pytest.fixture
def star(make):
    return make(SALES, PRODUCTS, CUSTOMERS)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_measures(star):
    assert dict(rows(warehouse.measures_report(star))) == {
        "Total Sales": 6168,
        "Total Quantity": 8,
        "Average Price": 869,
        "Total Orders": 5,
        "Total Products": 4,
        "Total Customers": 3,
    }
    assert warehouse.total_products(star).first().total_products == 5
    assert warehouse.order_lines(star).first().total_orders == 7
    assert warehouse.customers_with_orders(star).first().total_customers == 3


def test_measures_without_rows(make):
    got = dict(rows(warehouse.measures_report(make())))
    assert got["Total Sales"] is None and got["Average Price"] is None and got["Total Orders"] == 0


def test_ranges(star):
    assert rows(warehouse.order_date_range(star)) == [(day("2023-01-31"), day("2024-04-05"), 15)]
    assert rows(warehouse.customer_age_range(star, AS_OF)) == [(day("1990-12-31"), 34, day("2010-01-01"), 14)]


def test_dimension_lists(star):
    assert rows(warehouse.dim_countries(star)) == [("FR",), ("IT",)]
    assert rows(warehouse.dim_product_hierarchy(star))[0] == (None, "sub", "Bell")
    assert rows(warehouse.products_by_category(star)) == [("Bikes", 2), ("Parts", 2), (None, 1)]


def test_int_average_cost(star):
    assert dict(rows(warehouse.avg_cost_by_category(star))) == {"Bikes": 750, "Parts": 99, None: None}


def test_orphans_form_one_group(star):
    assert rows(warehouse.revenue_by_category(star)) == [("Bikes", 6051), (None, 100), ("Parts", 17)]
    assert rows(warehouse.revenue_by_customer(star)) == [
        (1, "Ann", "Lee", 6001),
        (None, None, None, 100),
        (2, "Bob", None, 67),
    ]
    assert rows(warehouse.items_by_country(star)) == [(None, 4), ("IT", 4), ("FR", 0)]


def test_rankings(star):
    assert rows(warehouse.top5_products(star, 2)) == [("Bike", 6051), (None, 100)]
    assert rows(warehouse.bottom5_products(star, 1)) == [("Tube", 17)]
    assert rows(warehouse.top10_customers(star, 1)) == [(1, "Ann", "Lee", 6001)]
    assert rows(warehouse.bottom3_customers_orders(star)) == [
        (None, None, None, 2),
        (1, "Ann", "Lee", 2),
        (2, "Bob", None, 2),
    ]


def test_ranked_products_keep_ties(make):
    products = [(i, f"p{i}", "c", 1) for i in range(4)]
    sales = [(f"o{i}", i, 1, "2024-01-01", amount, 1, 1) for i, amount in enumerate([5, 9, 9, 9])]
    got = rows(warehouse.top5_products_ranked(make(sales, products), top_n=2))
    assert got == [("p1", 9, 1), ("p2", 9, 1), ("p3", 9, 1)]


def test_top_lists_need_no_full_sort(star):
    assert "TakeOrderedAndProject" in plan_of(warehouse.top5_products(star))


def test_periods(star):
    assert rows(warehouse.sales_by_year_month(star))[0] == (2023, 1, 3010, 1, 3)
    assert [r[0] for r in rows(warehouse.sales_by_month_trunc(star))] == [
        day(d) for d in ("2023-01-01", "2024-02-01", "2024-03-01", "2024-04-01")
    ]
    assert [r[0] for r in rows(warehouse.sales_by_month_label(star))] == ["2023-Jan", "2024-Apr", "2024-Feb", "2024-Mar"]


def test_cumulative(star):
    assert rows(warehouse.cumulative_sales(star)) == [
        (day("2023-01-01"), 3010, 3010, 1502),
        (day("2024-01-01"), 3151, 6161, 1134),
    ]


def test_year_on_year(make):
    sales = [("o", 1, 1, f"{y}-05-05", amount, 1, 1) for y, amount in [(2020, 10), (2022, 15), (2023, 15)]]
    got = rows(warehouse.product_yoy(make(sales, PRODUCTS)))
    assert got == [
        (2020, "Bike", 10, 13, -3, "Below Avg", None, None, "No Change"),
        (2022, "Bike", 15, 13, 2, "Above Avg", 10, 5, "Increase"),
        (2023, "Bike", 15, 13, 2, "Above Avg", 15, 0, "No Change"),
    ]


def test_cost_ranges(make):
    products = [(i, "x", "c", cost) for i, cost in enumerate([99, 100, 500, 501, 1000, 1001, None])]
    assert dict(rows(warehouse.product_cost_ranges(make((), products)))) == {
        "Below 100": 1,
        "100-500": 2,
        "500-1000": 2,
        "Above 1000": 2,
    }


def test_customer_segments(make):
    customers = [(i, "a", "b", "IT", None) for i in range(1, 6)]
    sales = []
    for customer, (last, amount) in enumerate([("2024-01-01", 5001), ("2024-01-31", 5000), ("2023-12-31", 9999)], 1):
        sales += [("a", 1, customer, "2023-01-31", amount, 1, 1), ("b", 1, customer, last, 0, 1, 1)]
    sales += [("c", 1, 4, None, 9999, 1, 1), ("d", 1, 77, "2023-01-01", 9999, 1, 1), ("d", 1, 78, "2024-06-01", 9999, 1, 1)]
    got = dict(rows(warehouse.customer_segments(make(sales, PRODUCTS, customers))))
    assert got == {"VIP": 1, "Regular": 1, "New": 2}


def test_category_share(star):
    assert rows(warehouse.category_share(star))[0] == ("Bikes", 6051, 6168, 98.1)


def test_customer_report(star, spark):
    got = {r.customer_key: r for r in warehouse.report_customers_fixed(star, AS_OF, view="report_customers").collect()}
    ann, bob, lost = got[1], got[2], got[None]
    assert (ann.customer_name, ann.age, ann.age_group, ann.customer_segment) == ("Ann Lee", 34, "30-39", "VIP")
    assert (ann.recency, ann.total_orders, ann.total_products, ann.lifespan) == (2, 2, 2, 13)
    assert (ann.avg_order_value, ann.avg_monthly_spend) == (3000, 461)
    assert (bob.customer_name, bob.age_group, bob.total_sales, bob.lifespan, bob.avg_monthly_spend) == ("Bob ", "Under 20", 60, 0, 60)
    assert (lost.customer_name, lost.age_group, lost.total_orders, lost.total_sales) == (" ", "50 and above", 2, 100)
    literal = {r.customer_key: r for r in warehouse.report_customers(star, AS_OF).collect()}
    assert literal[1].lifespan == 2 and "total_products" not in literal[1].asDict()
    assert spark.table("report_customers").count() == 3


def test_product_report(make):
    products = [(i, f"p{i}", "c", 1) for i in range(1, 5)]
    sales = [
        ("o1", 1, 1, "2024-01-31", 50001, 0, 1),
        ("o2", 2, 1, "2023-01-31", 25000, 2, 1),
        ("o3", 2, 2, "2024-02-01", 25000, 3, 1),
        ("o4", 3, 1, "2024-01-31", 10000, 3, 1),
        ("o5", 4, 1, "2024-01-31", 9999, 1, 1),
    ]
    got = {r.product_key: r for r in warehouse.report_products(make(sales, products), AS_OF).collect()}
    assert [got[i].product_segment for i in range(1, 5)] == ["High-Performer", "Mid-Range", "Mid-Range", "Low-Performer"]
    assert got[1].avg_selling_price is None and got[2].avg_selling_price == 10416.7
    assert (got[2].lifespan, got[2].total_customers, got[2].avg_order_revenue, got[2].avg_monthly_revenue) == (13, 2, 25000, 3846)
    assert (got[1].lifespan, got[1].avg_monthly_revenue, got[1].recency_in_months) == (0, 50001, 3)


def test_dimension_joins_see_one_row_per_key(star):
    """The facts are aggregated by their own key below the join."""
    plan = plan_of(warehouse.revenue_by_category(star))
    assert plan.index("Join") < plan.index("partial_sum(sales_amount")


def test_scans_read_only_what_they_need(spark, star, tmp_path):
    star["fact_sales"].write.parquet(str(tmp_path / "fact"))
    tables = star | {"fact_sales": spark.read.schema(star["fact_sales"].schema).parquet(str(tmp_path / "fact"))}

    def scan(df):
        spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
        try:
            return next(line for line in plan_of(df).splitlines() if "FileScan" in line and "sales_amount" in line)
        finally:
            spark.conf.unset("spark.sql.maxMetadataStringLength")

    monthly = scan(warehouse.sales_by_year_month(tables))
    assert "IsNotNull(order_date)" in monthly
    assert "ReadSchema: struct<customer_key:int,order_date:date,sales_amount:int,quantity:int>" in monthly
    assert "ReadSchema: struct<product_key:int,sales_amount:int>" in scan(warehouse.revenue_by_category(tables))
