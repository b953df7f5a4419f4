"""Customer journey analysis.

Tables: customers, orders, order_items, products, page_events. `customers`,
`orders` and `products` hold one row per id.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import as_date, days_between, month_label
from ..functions.labels import above, at_least, first_match, position
from ..functions.numbers import ROUNDING_TYPE, percent, ratio, round_to, rounded_mean
from ..operators.baskets import LARGE_BASKET, SEED_ITEMS, top_pairs
from ..operators.journeys import reached_steps, session_paths
from ..operators.ranking import add_ntiles
from ..operators.rows import metrics_to_rows, share_of_total
from ..operators.scores import rfm_segment, score_customers
from ..operators.sequences import HOT_TEXT_ROWS, TEXT_SLICE_ROWS

Tables = dict[str, DataFrame]

RISKS = ["High Risk", "Medium Risk", "Low Risk"]
TIERS = [(8, "Platinum"), (6, "Gold"), (4, "Silver"), (2, "Bronze")]


def journey_funnel(tables: Tables) -> DataFrame:
    """Sessions per step and the rate against the step before."""
    page, event = F.col("page_url"), F.col("event_type")
    steps = {
        "home": page == "/home",
        "product": page.startswith("/product/"),
        "cart": event == "add_to_cart",
        "checkout": page == "/checkout",
        "purchase": event == "purchase",
    }
    totals = reached_steps(tables["page_events"], ["customer_id", "session_id"], steps).agg(
        F.countDistinct("session_id").alias("all"), *[F.sum(step).alias(step) for step in steps]
    )

    def row(step: str, base: str) -> list[Column]:
        return [F.col(step), percent(F.col(step), F.col(base))]

    return metrics_to_rows(
        totals,
        [
            ("Home Page", row("home", "all")),
            ("Product View", row("product", "home")),
            ("Add to Cart", row("cart", "product")),
            ("Checkout", row("checkout", "cart")),
            ("Purchase", row("purchase", "checkout")),
            ("Overall", row("purchase", "all")),
        ],
        ["funnel_step", "sessions", "conversion_rate"],
    )


def _page_label() -> Column:
    page = F.col("page_url")
    return first_match(
        [
            (page == "/home", "Home"),
            (page.startswith("/product/"), "Product"),
            (page == "/cart", "Cart"),
            (page == "/checkout", "Checkout"),
            (page == "/order/confirmation", "Confirmation"),
        ],
        "Other",
    )


def journey_paths(
    tables: Tables, min_frequency: int = 1, hot_rows: int = HOT_TEXT_ROWS, slice_rows: int = TEXT_SLICE_ROWS
) -> DataFrame:
    """How often each ordered sequence of pages occurs and converts."""
    events = tables["page_events"].select(
        "customer_id", "session_id", "event_timestamp", "event_id", "event_type", _page_label().alias("page")
    )
    sessions = session_paths(
        events,
        ["session_id", "customer_id"],
        ["event_timestamp", "event_id"],
        "page",
        F.col("event_type") == "purchase",
        hot_rows=hot_rows,
        slice_rows=slice_rows,
    )
    return (
        sessions.groupBy(F.col("path").alias("user_journey"))
        .agg(
            F.count("*").alias("frequency"),
            rounded_mean(F.col("steps")).alias("avg_steps"),
            F.sum("converted").alias("conversions"),
            percent(F.sum("converted"), F.count("*")).alias("conversion_pct"),
        )
        .filter(F.col("frequency") >= min_frequency)
        .orderBy(F.desc("frequency"), F.desc("conversion_pct"), "user_journey")
    )


def journey_cohort_revenue(tables: Tables) -> DataFrame:
    """Active customers, revenue and revenue per customer by signup and activity month."""
    activity = (
        tables["orders"]
        .groupBy("customer_id", month_label(F.col("order_timestamp")).alias("activity_month"))
        .agg(F.sum("total_amount").alias("revenue"))
    )
    signups = tables["customers"].select("customer_id", month_label(F.col("signup_date")).alias("signup_month"))
    return (
        activity.join(signups, "customer_id")
        .filter("activity_month >= signup_month")
        .groupBy("signup_month", "activity_month")
        .agg(F.count("*").alias("active_customers"), F.sum("revenue").alias("monthly_revenue"))
        .withColumn("arpu", round_to(ratio(F.col("monthly_revenue"), F.col("active_customers")), 2))
        .orderBy("signup_month", "activity_month")
    )


def journey_cohorts(tables: Tables) -> DataFrame:
    """Customers of each signup month active in that month and the two after it."""
    first_day = F.concat("signup_month", F.lit("-01")).cast("date")

    def active_after(months: int) -> Column:
        wanted = month_label(F.add_months(first_day, months))
        return F.max(F.when(F.col("activity_month") == wanted, F.col("active_customers")))

    return (
        journey_cohort_revenue(tables)
        .groupBy(F.col("signup_month").alias("cohort"), "signup_month")
        .agg(*[active_after(m).alias(f"m{m}_customers") for m in range(3)])
        .drop("signup_month")
        .withColumns(
            {f"m{m}_retention_rate": percent(F.col(f"m{m}_customers"), F.col("m0_customers")) for m in (1, 2)}
        )
        .orderBy("cohort")
    )


def _with_orders(tables: Tables, details: list[str], *measures: Column) -> DataFrame:
    """All customers, each with measures of its own orders (null without any)."""
    per_customer = tables["orders"].groupBy("customer_id").agg(*measures)
    return tables["customers"].select("customer_id", *details).join(per_customer, "customer_id", "left")


def journey_rfm_scores(tables: Tables, as_of: dt.date) -> DataFrame:
    """Scores and segment of every customer; 999 days where there is no order."""
    customers = _with_orders(
        tables,
        ["customer_name", "signup_date", "acquisition_channel"],
        F.max("order_timestamp").alias("_last"),
        F.count("order_id").alias("_orders"),
        F.sum("total_amount").alias("_spent"),
    ).withColumns(
        {
            "recency_days": F.coalesce(days_between(F.col("_last"), as_date(as_of)), F.lit(999)),
            "frequency": F.coalesce("_orders", F.lit(0)),
            "monetary": F.coalesce("_spent", F.lit(0)),
        }
    )
    value = F.coalesce(ratio(F.col("monetary"), F.col("frequency")), F.lit(0.0))
    customers = customers.withColumn("avg_order_value", value.cast(ROUNDING_TYPE)).drop("_last", "_orders", "_spent")
    return score_customers(customers, "customer_id").withColumn("rfm_segment", rfm_segment(3))


def journey_rfm_clv(tables: Tables, as_of: dt.date) -> DataFrame:
    """Segments with a one-year value estimate and their share of all customers."""
    monetary, frequency = F.col("monetary"), F.col("frequency")
    predicted = ratio(F.sum(monetary), F.count(monetary)) * ratio(F.sum(frequency), F.count(frequency))
    return (
        journey_rfm_scores(tables, as_of)
        .groupBy("rfm_segment")
        .agg(
            F.count("*").alias("customer_count"),
            rounded_mean(monetary).alias("avg_revenue"),
            rounded_mean(frequency).alias("avg_frequency"),
            rounded_mean(F.col("avg_order_value")).alias("avg_order_value"),
            round_to(predicted, 2).alias("predicted_clv_1yr"),
        )
        .withColumn("segment_percentage", share_of_total(F.col("customer_count")))
        .orderBy(F.desc("predicted_clv_1yr"), "rfm_segment")
    )


def journey_affinity(
    tables: Tables, top_n: int = 15, seed_items: int = SEED_ITEMS, large_basket: int = LARGE_BASKET
) -> DataFrame:
    """Products bought together most often, and each side's share of its orders."""
    products = tables["products"].select("product_id", "product_name")
    pairs, popularity = top_pairs(
        tables["order_items"], "order_id", "product_id", products, top_n, seed_items, large_basket
    )

    def side(letter: str) -> DataFrame:
        return popularity.join(products, F.col("item") == F.col("product_id")).select(
            F.col("item").alias(f"item_{letter}"),
            F.col("product_name").alias(f"product_{letter}_name"),
            F.col("baskets").alias(f"orders_{letter}"),
        )

    def affinity(letter: str) -> Column:
        return percent(F.col("baskets"), F.col(f"orders_{letter}"))

    a, b = F.col("product_a_affinity_pct"), F.col("product_b_affinity_pct")
    return (
        pairs.join(side("a"), "item_a")
        .join(side("b"), "item_b")
        .withColumns({f"product_{letter}_affinity_pct": affinity(letter) for letter in "ab"})
        .orderBy(F.desc("baskets"), F.desc("product_a_affinity_pct"), "item_a", "item_b")
        .limit(top_n)
        .select(
            "product_a_name",
            "product_b_name",
            F.col("baskets").alias("times_bought_together"),
            a,
            b,
            above(F.greatest(a, b), [(20, "High Affinity"), (10, "Medium Affinity")], "Low Affinity").alias(
                "affinity_level"
            ),
        )
    )


def journey_customer_activity(tables: Tables, as_of: dt.date) -> DataFrame:
    """Every customer's order history with a churn risk and a customer type.

    Customers without orders have no idle days and count as active.
    """
    amount = F.col("total_amount")
    customers = _with_orders(
        tables,
        ["customer_name", "signup_date", "acquisition_channel"],
        F.max("order_timestamp").alias("last_order_date"),
        F.count("order_id").alias("total_orders"),
        F.sum(amount).alias("total_spent"),
        ratio(F.sum(amount), F.count(amount)).alias("avg_order_value"),
        F.countDistinct(month_label(F.col("order_timestamp"))).alias("active_months"),
    )
    idle, orders = F.col("days_since_last_order"), F.col("total_orders")
    return (
        customers.fillna(0, ["total_orders", "active_months"])
        .withColumn("days_since_last_order", days_between(F.col("last_order_date"), as_date(as_of)))
        .withColumns(
            {
                "churn_risk": above(idle, list(zip((90, 60, 30), RISKS)), "Active"),
                "customer_type": first_match(
                    [
                        (orders == 0, "Never Purchased"),
                        (orders == 1, "One-Time Buyer"),
                        (orders.between(2, 5), "Repeat Buyer"),
                    ],
                    "VIP Customer",
                ),
            }
        )
    )


def journey_churn(tables: Tables, as_of: dt.date) -> DataFrame:
    return (
        journey_customer_activity(tables, as_of)
        .groupBy("churn_risk", "customer_type")
        .agg(
            F.count("*").alias("customer_count"),
            rounded_mean(F.col("total_spent")).alias("avg_lifetime_value"),
            rounded_mean(F.col("days_since_last_order")).alias("avg_days_inactive"),
        )
        .withColumn("percentage_of_total", share_of_total(F.col("customer_count")))
        .orderBy(position(F.col("churn_risk"), RISKS), F.desc("customer_count"), "customer_type")
    )


def _engagement(
    tables: Tables, repeat_orders: bool, as_of: dt.date | None = None, sessions: bool = True
) -> DataFrame:
    """Per customer: orders, spending and, unless not asked for, sessions.

    Joining orders and page events of a customer side by side repeats each order
    once per event. `repeat_orders` gives exactly those sums by multiplying the
    aggregated orders with the number of events, without building the rows.
    """
    recent = F.lit(False)
    if as_of is not None:
        recent = F.col("order_timestamp") >= F.date_sub(as_date(as_of), 30)
    amount = F.col("total_amount")
    customers = _with_orders(
        tables,
        ["customer_name", "country", "acquisition_channel"],
        F.count("order_id").alias("orders"),
        F.count(amount).alias("amounts"),
        F.sum(amount).alias("spent"),
        F.sum(F.when(recent, amount)).alias("recent_spent"),
        F.max("order_timestamp").alias("last_purchase_date"),
    )
    counts = [F.count("*").alias("events")] if repeat_orders else []
    counts += [F.countDistinct("session_id").alias("total_sessions")] if sessions else []
    if counts:
        visits = tables["page_events"].groupBy("customer_id").agg(*counts)
        customers = customers.join(visits, "customer_id", "left")
    zero = F.lit(0)
    copies = F.greatest(F.coalesce("events", zero), F.lit(1)) if repeat_orders else F.lit(1)
    return customers.select(
        "customer_id",
        "customer_name",
        "country",
        "acquisition_channel",
        F.coalesce("orders", zero).alias("own_orders"),
        (F.coalesce("orders", zero) * copies).alias("order_count"),
        (F.coalesce("amounts", zero) * copies).alias("amount_count"),
        (F.coalesce("spent", zero) * copies).alias("total_spent"),
        (F.coalesce("recent_spent", zero) * copies).alias("recent_spent"),
        *([F.coalesce("total_sessions", zero).alias("total_sessions")] if sessions else []),
        "last_purchase_date",
    )


def _tier_customers(tables: Tables, repeat_orders: bool) -> DataFrame:
    score = (
        F.col("order_count") * F.lit(Decimal("0.4"))
        + F.col("total_spent") * F.lit(Decimal("0.003"))
        + F.col("total_sessions") * F.lit(Decimal("0.3"))
    )
    return (
        _engagement(tables, repeat_orders)
        .withColumn("engagement_score", F.round(score, 2))
        .withColumn("customer_tier", at_least(F.col("engagement_score"), TIERS, "Lead"))
    )


def journey_tier_customers(tables: Tables, repeat_orders: bool = True) -> DataFrame:
    """Every customer's tier with quartiles of spending and of order count."""
    return add_ntiles(
        _tier_customers(tables, repeat_orders),
        [
            ("spending_quartile", 4, [("total_spent", False), ("customer_id", True)]),
            ("frequency_quartile", 4, [("order_count", False), ("customer_id", True)]),
        ],
    ).drop("own_orders", "amount_count", "recent_spent")


def journey_tiers(tables: Tables, repeat_orders: bool = True) -> DataFrame:
    return (
        _tier_customers(tables, repeat_orders)
        .groupBy("customer_tier")
        .agg(
            F.count("*").alias("customer_count"),
            rounded_mean(F.col("total_spent")).alias("avg_spending"),
            rounded_mean(F.col("order_count")).alias("avg_orders"),
            rounded_mean(F.col("engagement_score")).alias("avg_engagement"),
            F.sum("total_spent").alias("segment_total_revenue"),
        )
        .withColumn("segment_percentage", share_of_total(F.col("customer_count")))
        .orderBy(position(F.col("customer_tier"), [name for _, name in TIERS]))
    )


def journey_tiers_fixed(tables: Tables) -> DataFrame:
    return journey_tiers(tables, repeat_orders=False)


def journey_kpis(tables: Tables, as_of: dt.date, repeat_orders: bool = True) -> DataFrame:
    """Seven labelled figures; a converted session is a distinct order."""
    totals = _engagement(tables, repeat_orders, as_of, sessions=False).agg(
        F.count("*").alias("customers"),
        F.count_if(F.col("own_orders") > 0).alias("buyers"),
        F.sum("own_orders").alias("orders"),
        F.sum(F.when(F.col("amount_count") > 0, F.col("total_spent"))).alias("revenue"),
        F.sum("amount_count").alias("amounts"),
        F.sum("recent_spent").alias("recent"),
    )
    visits = tables["page_events"].select("customer_id", "session_id").distinct()
    sessions = visits.join(tables["customers"].select("customer_id"), "customer_id", "left_semi").agg(
        F.countDistinct("session_id").alias("sessions")
    )
    both = totals.unionByName(sessions, allowMissingColumns=True)
    figures = both.agg(*[F.max(c).alias(c) for c in both.columns])
    revenue, customers = F.col("revenue"), F.col("customers")
    return metrics_to_rows(
        figures,
        [
            ("Total Customers", [customers.cast("double")]),
            ("Purchasing Customers", [F.col("buyers").cast("double")]),
            ("Total Revenue ($)", [round_to(revenue, 2)]),
            ("Average Order Value ($)", [round_to(ratio(revenue, F.col("amounts")), 2)]),
            ("Conversion Rate (%)", [percent(F.col("orders"), F.col("sessions"))]),
            ("30-Day Revenue ($)", [round_to(F.col("recent"), 2)]),
            ("Customer Acquisition Cost (Est.)", [round_to(ratio(revenue * F.lit(Decimal("0.15")), customers), 2)]),
        ],
        ["metric", "value"],
    )


def journey_kpis_fixed(tables: Tables, as_of: dt.date) -> DataFrame:
    return journey_kpis(tables, as_of, repeat_orders=False)
