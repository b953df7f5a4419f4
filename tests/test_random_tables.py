"""Jobs against their SQL on random tables full of nulls, orphans, ties and hot keys."""

import datetime as dt
import inspect
import random
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as registered
from compare import differences
from oracle import cleaning as cleaning_sql, finance as finance_sql, journey as journey_sql, warehouse as warehouse_sql
from saleslens.plans import catalog, cleaning, finance, journey, warehouse
from saleslens.sources import given_tables as given

AS_OF = {"as_of": registered.AS_OF}
SCHEMAS = {
    "dim_products": "product_key long, product_id long, product_number string, product_name string, category_id string, "
    "category string, subcategory string, maintenance string, cost int, product_line string, start_date date",
    "dim_customers": "customer_key long, customer_id long, customer_number string, first_name string, last_name string, "
    "country string, marital_status string, gender string, birthdate date, create_date date",
    "fact_sales": "order_number string, product_key long, customer_key long, order_date date, shipping_date date, "
    "due_date date, sales_amount int, quantity int, price int",
    "j_customers": "customer_id long, customer_name string, signup_date date, acquisition_channel string, country string",
    "j_orders": "order_id long, customer_id long, order_timestamp timestamp_ntz, total_amount decimal(20,2)",
    "order_items": "order_id long, product_id long",
    "j_products": "product_id long, product_name string",
    "page_events": "event_id long, customer_id long, session_id string, event_timestamp timestamp_ntz, "
    "event_type string, page_url string",
    "f_customers": "customer_id long, customer_name string, income_bracket string, credit_score long",
    "accounts": "customer_id long, account_type string, balance decimal(20,2)",
    "financial_transactions": "transaction_id long, customer_id long, amount decimal(20,2), "
    "transaction_date timestamp_ntz, transaction_status string, transaction_type string, merchant_category string, "
    "device_type string, is_fraudulent int, location_city string, location_country string",
    "patient_records": "record_id long, patient_id long, first_name string, last_name string, date_of_birth date, "
    "admission_date string, gender string, patient_address string, phone_number string",
    "crm_prd_info": "prd_id long, prd_key string, prd_nm string, prd_cost int, prd_line string, prd_start_dt date, "
    "prd_end_dt date",
    "erp_px_cat": "id string, cat string, subcat string, maintenance string",
}


def random_tables(seed: int) -> dict[str, list[tuple]]:
    rng = random.Random(seed)

    def pick(*values):
        return rng.choice(values)

    def key(limit):  # a third on one key, some orphans, some nulls
        return 3 if rng.random() < 0.33 else pick(None, *range(limit + 3))

    def day(null=0.1):
        return None if rng.random() < null else dt.date(2000, 1, 1) + dt.timedelta(days=rng.randrange(700))

    def moment(null=0.05):
        date = day(null)
        return date and dt.datetime(date.year, date.month, date.day, rng.randrange(24))

    def money(limit=500):
        return None if rng.random() < 0.05 else Decimal(rng.randrange(limit * 100)) / 100

    names = ["x", "y", "z", None]
    pages = ["/home", "/product/1", "/cart", "/checkout", "/order/confirmation", "/else", "/products", None]
    return {
        "dim_products": [
            (i, i, f"N{i}", pick(*names), "c", pick("A", "B", None), pick("s", None), "Yes", pick(None, 99, 100, 500, 501, 1000, 1001), "Road", day())
            for i in range(8)
        ],
        "dim_customers": [
            (i, i, f"C{i}", pick("Ann", None), pick("Lee", None), pick("IT", "FR", None), "Single", pick("Male", None), pick(None, dt.date(1940 + rng.randrange(70), 1, 1)), day())
            for i in range(12)
        ],
        "fact_sales": [
            (f"o{rng.randrange(60)}", key(8), key(12), day(), day(), day(), pick(None, rng.randrange(4000)), pick(0, 1, 2, 3), pick(None, rng.randrange(90)))
            for _ in range(150)
        ],
        "j_customers": [(i, f"c{i}", day(), "web", pick("IT", None)) for i in range(20)],
        "j_orders": [(i, key(20), moment(), money()) for i in range(100)],
        "order_items": [(rng.randrange(15), key(9)) for _ in range(90)],
        "j_products": [(i, f"p{i}") for i in range(9)],
        "page_events": [
            (i, key(20), pick("s1", "s2", "s3", None), moment(), pick("page_view", "add_to_cart", "purchase", None), pick(*pages))
            for i in range(150)
        ],
        "f_customers": [(i, f"c{i}", pick("low", "high", None), pick(None, 500, 700)) for i in range(20)],
        "accounts": [(key(20), pick("checking", "savings"), pick(None, Decimal("5.00"), Decimal("7.50"))) for _ in range(30)],
        "financial_transactions": [
            (i, key(20), money(2000), moment(), pick("completed", "completed", "pending", None), pick("purchase", "transfer", None), pick("a", "b", None), pick("mobile", "web", None), pick(0, 1, None), pick("Rome", None), "Italy")
            for i in range(200)
        ],
        "patient_records": [
            (i, key(6), pick("Ann", "Bob", None), pick("Lee", None), pick(dt.date(1980, 1, 1), None), pick("n/a", None, "", "2024-01-05 08:30:00", "2024-01-06"), pick("M", "male", "FEMALE", "", None), pick("a, b, c", "a,b", "one", "", ",", None, "a, b, c, d"), pick("5", "", None))
            for i in range(80)
        ],
        "crm_prd_info": [
            (i, pick("AC-HE-K1", "AC-HE-K2", "CO-PE-K3", "CO-RF-K1"), pick(*names), pick(None, 5), pick("M ", "R ", " T", "q", None), dt.date(2000, 1, 1) + dt.timedelta(days=rng.randrange(9)), day())
            for i in range(25)
        ],
        "erp_px_cat": [("AC_HE", "Accessories", "Helmets", "Yes"), ("CO_RF", "Components", None, "No")],
    }


JOBS = (
    [(given.CLEANING, cleaning, cleaning_sql, n, {}) for n in cleaning_sql._BODIES if n != "patient_rejected_dates"]
    + [
        (given.FINANCE, finance, finance_sql, n, AS_OF if "rfm" in n else {"as_of_from": registered.AS_OF_FROM} if n == "fin_kpis" else {})
        for n in finance_sql._BODIES
    ]
    + [
        (given.JOURNEY, journey, journey_sql, n, AS_OF if n.split("_", 1)[1] in ("rfm_clv", "rfm_scores", "churn", "customer_activity", "kpis", "kpis_fixed") else {})
        for n in journey_sql._BODIES
    ]
    + [
        (given.WAREHOUSE, warehouse, warehouse_sql, n, AS_OF if n.startswith(("report", "customer_age")) else {})
        for n in warehouse_sql._BODIES
        if hasattr(warehouse, n)
    ]
    + [(given.CATALOG, catalog, warehouse_sql, n, {}) for n in ("product_versions", "build_dim_products")]
)


@pytest.fixture(scope="module", params=[1, 2])
def world(request, spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp(f"random{request.param}")
    connection, frames = duckdb.connect(), {}
    for name, rows in random_tables(request.param).items():
        path = str(folder / name)
        spark.createDataFrame(rows, SCHEMAS[name]).coalesce(1).write.parquet(path)
        frames[name] = spark.read.parquet(path)
        connection.execute(f"create table {name} as select * from '{path}/*.parquet'")
    return frames, connection


@pytest.mark.parametrize("group,module,sql,name,parameters", JOBS, ids=[job[3] for job in JOBS])
def test_job(world, group, module, sql, name, parameters):
    frames, connection = world
    tables = {table: frames[shape] for table, shape in group.items()}
    found = registered._comparable(getattr(module, name)(tables, **parameters))
    assert differences(found, connection, sql._BODIES[name]) is None


# Limits so low that hot keys, range partitions and large baskets occur.
LOW_LIMITS = {"hot_rows": 12, "slice_rows": 5, "large_basket": 3, "seed_items": 200}


def low_limits(job):
    return {name: value for name, value in LOW_LIMITS.items() if name in inspect.signature(job).parameters}


SPLIT_JOBS = [job for job in JOBS if low_limits(getattr(job[1], job[3]))]


@pytest.mark.parametrize("group,module,sql,name,parameters", SPLIT_JOBS, ids=[job[3] for job in SPLIT_JOBS])
def test_job_with_low_limits(world, group, module, sql, name, parameters):
    frames, connection = world
    tables = {table: frames[shape] for table, shape in group.items()}
    job = getattr(module, name)
    found = registered._comparable(job(tables, **parameters, **low_limits(job)))
    assert differences(found, connection, sql._BODIES[name]) is None
