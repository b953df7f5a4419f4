import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from saleslens.plans import journey

from conftest import plan_of, values

AS_OF = dt.date(2024, 4, 30)


def at(text):
    return dt.datetime.fromisoformat(text)


@pytest.fixture
def make(frame):
    def tables(customers=(), orders=(), items=(), products=(), events=()):
        return {
            "customers": frame(
                [(c, f"name {c}", dt.date.fromisoformat(d), "web", "IT") for c, d in customers],
                "customer_id long, customer_name string, signup_date date, acquisition_channel string, country string",
            ),
            "orders": frame(
                [(o, c, at(t), D(str(a))) for o, c, t, a in orders],
                "order_id long, customer_id long, order_timestamp timestamp_ntz, total_amount decimal(20,2)",
            ),
            "order_items": frame(list(items), "order_id long, product_id long"),
            "products": frame([(p, f"product {p}") for p in products], "product_id long, product_name string"),
            "page_events": frame(
                [(i, c, s, at(t), e, p) for i, (c, s, t, e, p) in enumerate(events)],
                "event_id long, customer_id long, session_id string, event_timestamp timestamp_ntz, "
                "event_type string, page_url string",
            ),
        }

    return tables


VISITS = [
    (1, "s1", "2024-01-01", "page_view", "/home"),
    (1, "s1", "2024-01-02", "page_view", "/product/9"),
    (1, "s1", "2024-01-03", "add_to_cart", "/cart"),
    (1, "s1", "2024-01-04", "purchase", "/order/confirmation"),
    (2, "s1", "2024-01-01", "page_view", "/home"),
    (2, "s2", "2024-01-01", "page_view", "/search"),
    (2, None, "2024-01-01", "page_view", "/home"),
]


def test_funnel(make):
    got = [tuple(r) for r in journey.journey_funnel(make(events=VISITS)).collect()]
    assert got == [
        ("Home Page", 3, 150.0),  # sessions are counted by id, flags by customer and id
        ("Product View", 1, 33.33),
        ("Add to Cart", 1, 100.0),
        ("Checkout", 0, 0.0),
        ("Purchase", 1, None),
        ("Overall", 1, 50.0),
    ]


def test_funnel_without_events(make):
    assert {r.conversion_rate for r in journey.journey_funnel(make()).collect()} == {None}


def test_paths(make):
    events = [*VISITS, (3, "s3", "2024-01-01", "page_view", "/home"), (3, "s3", "2024-01-01", "page_view", "/checkout")]
    got = {r.user_journey: tuple(r)[1:] for r in journey.journey_paths(make(events=events)).collect()}
    assert got == {
        "Home → Product → Cart → Confirmation": (1, 4.0, 1, 100.0),
        "Home": (2, 1.0, 0, 0.0),
        "Other": (1, 1.0, 0, 0.0),
        "Home → Checkout": (1, 2.0, 0, 0.0),
    }
    assert journey.journey_paths(make(events=events), min_frequency=2).count() == 1


def test_paths_same_with_hot_session(make):
    pages = ["/home", "/cart", "/checkout", "/product/1", "/x"]
    events = [
        (i % 4, "hot" if i % 2 else f"s{i % 7}", f"2024-01-{1 + i * i % 20:02}", "purchase" if i == 9 else "v", pages[i % 5])
        for i in range(120)
    ]
    tables = make(events=events)
    plain = values(journey.journey_paths(tables))
    assert values(journey.journey_paths(tables, hot_rows=10, slice_rows=7)) == plain


def test_cohorts(make):
    customers = [(1, "2024-01-31"), (2, "2024-01-10"), (3, "2024-02-01")]
    orders = [
        (1, 1, "2024-01-31", 10),
        (2, 1, "2024-02-01", 20),
        (3, 1, "2024-02-09", 5),
        (4, 2, "2023-12-01", 99),
        (5, 2, "2024-03-01", 7),
        (6, 3, "2024-03-05", 8),
    ]
    revenue = values(journey.journey_cohort_revenue(make(customers, orders)))
    assert ("2024-01", "2024-02", 1, D("25.00"), 25.0) in revenue and len(revenue) == 4
    got = [tuple(r) for r in journey.journey_cohorts(make(customers, orders)).collect()]
    assert got == [("2024-01", 1, 1, 1, 100.0, 100.0), ("2024-02", None, 1, None, None, None)]


def test_rfm(make):
    customers = [(1, "2024-01-01"), (2, "2024-01-01")]
    got = journey.journey_rfm_scores(make(customers, [(1, 1, "2024-04-20", 30), (2, 1, "2024-04-25", 10)]), AS_OF)
    rows = {r.customer_id: r for r in got.collect()}
    assert (rows[1].recency_days, rows[1].frequency, rows[1].avg_order_value) == (5, 2, D("20.00000000"))
    assert (rows[2].recency_days, rows[2].frequency, rows[2].monetary) == (999, 0, D("0.00"))
    assert (rows[2].rfm_cell, rows[1].rfm_cell) == ("111", "222")
    clv = journey.journey_rfm_clv(make(customers, [(1, 1, "2024-04-20", 30)]), AS_OF).collect()
    assert [(r.customer_count, r.predicted_clv_1yr, r.segment_percentage) for r in clv] == [(2, 7.5, 100.0)]


def test_affinity(make):
    items = [(o, p) for o in range(10) for p in (1, 2)] + [(0, 1), (0, 3), (20, 3), (21, 9), (21, 1)]
    items += [(30 + i, 3) for i in range(8)]
    got = [tuple(r) for r in journey.journey_affinity(make(items=items, products=[1, 2, 3])).collect()]
    assert got == [
        ("product 1", "product 2", 10, 90.91, 100.0, "High Affinity"),
        ("product 2", "product 3", 1, 10.0, 10.0, "Low Affinity"),  # exactly 10 percent is low
        ("product 1", "product 3", 1, 9.09, 10.0, "Low Affinity"),
    ]
    assert journey.journey_affinity(make(items=items, products=[1, 2, 3]), top_n=1).count() == 1
    assert journey.journey_affinity(make(items=items, products=[1, 2, 3]), seed_items=2, large_basket=1).count() == 3


def test_churn_limits(make):
    idle = {1: 30, 2: 31, 3: 60, 4: 61, 5: 90, 6: 91}
    customers = [(c, "2023-01-01") for c in range(1, 8)]
    orders = [(c, c, str(AS_OF - dt.timedelta(days=d)), 10) for c, d in idle.items()]
    orders += [(100 + i, 1, "2023-05-01", 10) for i in range(4)] + [(200 + i, 2, "2023-05-01", 10) for i in range(5)]
    rows = {r.customer_id: r for r in journey.journey_customer_activity(make(customers, orders), AS_OF).collect()}
    assert [rows[c].churn_risk for c in range(1, 8)] == [
        "Active",
        "Low Risk",
        "Low Risk",
        "Medium Risk",
        "Medium Risk",
        "High Risk",
        "Active",
    ]
    assert (rows[1].customer_type, rows[2].customer_type, rows[3].customer_type) == (
        "Repeat Buyer",
        "VIP Customer",
        "One-Time Buyer",
    )
    assert (rows[7].customer_type, rows[7].total_orders, rows[7].active_months) == ("Never Purchased", 0, 0)
    assert (rows[1].active_months, rows[1].avg_order_value, rows[7].total_spent) == (2, 10.0, None)
    ordered = [r.churn_risk for r in journey.journey_churn(make(customers, orders), AS_OF).collect()]
    assert ordered == sorted(ordered, key=["High Risk", "Medium Risk", "Low Risk", "Active"].index)


def fan_out(tables):
    """The side-by-side join as stated, row by row."""
    joined = (
        tables["customers"]
        .join(tables["orders"], "customer_id", "left")
        .join(tables["page_events"].select("customer_id", "session_id"), "customer_id", "left")
    )
    return joined.groupBy("customer_id").agg(
        F.count("order_id").alias("order_count"),
        F.coalesce(F.sum("total_amount"), F.lit(0)).alias("total_spent"),
        F.countDistinct("session_id").alias("total_sessions"),
        F.max("order_timestamp").alias("last_purchase_date"),
    )


@pytest.fixture
def mixed(make):
    customers = [(c, "2024-01-01") for c in range(1, 6)]
    orders = [(1, 1, "2024-04-01", 10), (2, 1, "2024-01-01", 20), (3, 2, "2024-03-31", 5), (4, 9, "2024-04-01", 99)]
    events = [(c, f"s{s}", "2024-01-01", "v", "/home") for c, s in [(1, 1), (1, 1), (1, 2), (3, 3), (9, 4), (4, 3)]]
    return make(customers, orders, events=events)


def test_tiers_equal_the_joined_rows(mixed):
    columns = ["customer_id", "order_count", "total_spent", "total_sessions", "last_purchase_date"]
    got = [(*map(lambda v: float(v) if isinstance(v, D) else v, r),) for r in values(journey.journey_tier_customers(mixed), *columns)]
    expected = [(*map(lambda v: float(v) if isinstance(v, D) else v, r),) for r in values(fan_out(mixed), *columns)]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert (1, 6, 90.0, 2, at("2024-04-01")) in got


def test_tiers(mixed):
    rows = {r.customer_id: r for r in journey.journey_tier_customers(mixed).collect()}
    assert (rows[1].engagement_score, rows[1].customer_tier) == (D("3.27"), "Bronze")
    assert (rows[1].spending_quartile, rows[5].spending_quartile) == (1, 4)
    tiers = [tuple(r) for r in journey.journey_tiers(mixed).collect()]
    assert [t[0] for t in tiers] == ["Bronze", "Lead"]
    assert [t[0] for t in journey.journey_tiers_fixed(mixed).collect()] == ["Lead"]


def test_kpis(mixed):
    got = dict(values(journey.journey_kpis(mixed, AS_OF)))
    assert got["Total Customers"] == 5.0 and got["Purchasing Customers"] == 2.0
    assert got["Total Revenue ($)"] == 95.0 and got["Average Order Value ($)"] == 13.57
    assert got["Conversion Rate (%)"] == 100.0, "three orders over three sessions of known customers"
    assert got["30-Day Revenue ($)"] == 35.0, "the day 30 days back counts"
    assert got["Customer Acquisition Cost (Est.)"] == 2.85
    fixed = dict(values(journey.journey_kpis_fixed(mixed, AS_OF)))
    assert fixed["Total Revenue ($)"] == 35.0 and fixed["30-Day Revenue ($)"] == 15.0


def test_kpis_do_not_join_side_by_side(mixed):
    plan = plan_of(journey.journey_kpis(mixed, AS_OF))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
