"""Exploration, ranking, trends, segments and reports over a sales star schema.

Tables: dim_products, dim_customers, fact_sales. Amounts are whole numbers, and
averages and quotients of whole numbers are cut toward zero.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dates import as_date, months_between_boundaries, years_between_boundaries
from ..functions.labels import first_match
from ..functions.numbers import ROUNDING_TYPE, percent, ratio, round_to, whole_mean, whole_ratio
from ..operators.months import in_period
from ..operators.period_bitmaps import PERIODS, monthly_bitmaps, roll_up
from ..operators.ranking import top_ranks
from ..operators.rollup import rollup_by_attributes, rollup_by_entity, sums
from ..operators.rows import as_view, metrics_to_rows
from ..operators.staging import stage

Tables = dict[str, DataFrame]

CUSTOMER = ["customer_key", "first_name", "last_name"]


def _sales(tables: Tables) -> DataFrame:
    return tables["fact_sales"]


def _dated_sales(tables: Tables) -> DataFrame:
    return in_period(_sales(tables), "order_date")


def _dated_parts(tables: Tables, key: str) -> list[DataFrame]:
    """Dated sales, from facts stored by this key if there are any (`fact_sales_by_<key>`: a `KeyBuckets`)."""
    stored = tables.get(f"fact_sales_by_{key}")
    if stored is None:
        return [_dated_sales(tables)]
    return [in_period(part, "order_date") for part in stored.parts(tables["dim_customers"].sparkSession)]


# Dimensions and date ranges


def dim_countries(tables: Tables) -> DataFrame:
    return tables["dim_customers"].select("country").distinct().orderBy("country")


def dim_product_hierarchy(tables: Tables) -> DataFrame:
    levels = ["category", "subcategory", "product_name"]
    return tables["dim_products"].select(*levels).distinct().orderBy(*levels)


def order_date_range(tables: Tables) -> DataFrame:
    first, last = F.min("order_date"), F.max("order_date")
    return _sales(tables).agg(
        first.alias("first_order_date"),
        last.alias("last_order_date"),
        months_between_boundaries(first, last).alias("order_range_months"),
    )


def customer_age_range(tables: Tables, as_of: dt.date) -> DataFrame:
    today = as_date(as_of)
    oldest, youngest = F.min("birthdate"), F.max("birthdate")
    return tables["dim_customers"].agg(
        oldest.alias("oldest_birthdate"),
        years_between_boundaries(oldest, today).alias("oldest_age"),
        youngest.alias("youngest_birthdate"),
        years_between_boundaries(youngest, today).alias("youngest_age"),
    )


# Single measures


def total_sales(tables: Tables) -> DataFrame:
    return _sales(tables).agg(F.sum("sales_amount").alias("total_sales"))


def total_quantity(tables: Tables) -> DataFrame:
    return _sales(tables).agg(F.sum("quantity").alias("total_quantity"))


def avg_price(tables: Tables) -> DataFrame:
    return _sales(tables).agg(whole_mean("price").alias("avg_price"))


def order_lines(tables: Tables) -> DataFrame:
    return _sales(tables).agg(F.count("order_number").alias("total_orders"))


def orders_distinct(tables: Tables) -> DataFrame:
    return _sales(tables).agg(F.countDistinct("order_number").alias("total_orders"))


def total_products(tables: Tables) -> DataFrame:
    return tables["dim_products"].agg(F.count("product_name").alias("total_products"))


def total_customers(tables: Tables) -> DataFrame:
    return tables["dim_customers"].agg(F.count("customer_key").alias("total_customers"))


def customers_with_orders(tables: Tables) -> DataFrame:
    return _sales(tables).agg(F.countDistinct("customer_key").alias("total_customers"))


def measures_report(tables: Tables) -> DataFrame:
    """The main measures as labelled rows; products count as distinct names here."""
    names = ["measure_name", "measure_value"]
    sales = _sales(tables).agg(
        F.sum("sales_amount").alias("sales"),
        F.sum("quantity").alias("quantity"),
        whole_mean("price").alias("price"),
        F.countDistinct("order_number").alias("orders"),
    )
    products = tables["dim_products"].agg(F.countDistinct("product_name").alias("n"))
    customers = tables["dim_customers"].agg(F.count("customer_key").alias("n"))
    return (
        metrics_to_rows(
            sales,
            [
                ("Total Sales", [F.col("sales")]),
                ("Total Quantity", [F.col("quantity")]),
                ("Average Price", [F.col("price")]),
                ("Total Orders", [F.col("orders")]),
            ],
            names,
        )
        .unionByName(metrics_to_rows(products, [("Total Products", [F.col("n")])], names))
        .unionByName(metrics_to_rows(customers, [("Total Customers", [F.col("n")])], names))
    )


# Magnitude by dimension


def _count_by(df: DataFrame, by: str, counted: str, name: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(counted).alias(name)).orderBy(F.desc(name), by)


def customers_by_country(tables: Tables) -> DataFrame:
    return _count_by(tables["dim_customers"], "country", "customer_key", "total_customers")


def customers_by_gender(tables: Tables) -> DataFrame:
    return _count_by(tables["dim_customers"], "gender", "customer_key", "total_customers")


def products_by_category(tables: Tables) -> DataFrame:
    return _count_by(tables["dim_products"], "category", "product_key", "total_products")


def avg_cost_by_category(tables: Tables) -> DataFrame:
    return (
        tables["dim_products"]
        .groupBy("category")
        .agg(whole_mean("cost").alias("avg_cost"))
        .orderBy(F.desc("avg_cost"), "category")
    )


def _by_product(tables: Tables, attributes: list[str], **measures: str) -> DataFrame:
    return rollup_by_attributes(
        _sales(tables), "product_key", tables["dim_products"], attributes, sums(**measures)
    )


def _by_customer(tables: Tables, attributes: list[str], **measures: str) -> DataFrame:
    return rollup_by_attributes(
        _sales(tables), "customer_key", tables["dim_customers"], attributes, sums(**measures)
    )


def revenue_by_category(tables: Tables) -> DataFrame:
    return _by_product(tables, ["category"], total_revenue="sales_amount").orderBy(
        F.desc("total_revenue"), "category"
    )


def revenue_by_customer(tables: Tables) -> DataFrame:
    return _by_customer(tables, CUSTOMER, total_revenue="sales_amount").orderBy(
        F.desc("total_revenue"), "customer_key"
    )


def items_by_country(tables: Tables) -> DataFrame:
    return _by_customer(tables, ["country"], total_sold_items="quantity").orderBy(
        F.desc("total_sold_items"), "country"
    )


# Ranking


def _revenue_by_product_name(tables: Tables) -> DataFrame:
    return _by_product(tables, ["product_name"], total_revenue="sales_amount")


def top5_products(tables: Tables, top_n: int = 5) -> DataFrame:
    return _revenue_by_product_name(tables).orderBy(F.desc("total_revenue"), "product_name").limit(top_n)


def top5_products_ranked(tables: Tables, top_n: int = 5) -> DataFrame:
    """Products up to rank n; products with equal revenue share a rank."""
    ranked = top_ranks(_revenue_by_product_name(tables), "total_revenue", top_n, "rank_products")
    return ranked.orderBy("rank_products", "product_name")


def bottom5_products(tables: Tables, top_n: int = 5) -> DataFrame:
    return _revenue_by_product_name(tables).orderBy("total_revenue", "product_name").limit(top_n)


def top10_customers(tables: Tables, top_n: int = 10) -> DataFrame:
    return revenue_by_customer(tables).limit(top_n)


def bottom3_customers_orders(tables: Tables, top_n: int = 3) -> DataFrame:
    return (
        rollup_by_entity(
            _sales(tables),
            "customer_key",
            tables["dim_customers"],
            CUSTOMER,
            measures={},
            distinct={"total_orders": "order_number"},
        )
        .orderBy("total_orders", "customer_key")
        .limit(top_n)
    )


# Change over time


def _by_period(tables: Tables, **periods: Column) -> DataFrame:
    return (
        _dated_sales(tables)
        .groupBy(*[period.alias(name) for name, period in periods.items()])
        .agg(
            F.sum("sales_amount").alias("total_sales"),
            F.countDistinct("customer_key").alias("total_customers"),
            F.sum("quantity").alias("total_quantity"),
        )
        .orderBy(*periods)
    )


def sales_by_year_month(tables: Tables) -> DataFrame:
    return _by_period(tables, order_year=F.year("order_date"), order_month=F.month("order_date"))


def sales_by_month_trunc(tables: Tables) -> DataFrame:
    return _by_period(tables, order_date=F.trunc("order_date", "MM"))


def sales_by_month_label(tables: Tables) -> DataFrame:
    """Labelled like 1998-Apr; sorted as text."""
    return _by_period(tables, order_date=F.date_format("order_date", "yyyy-MMM"))


def cumulative_sales(tables: Tables) -> DataFrame:
    """Yearly sales with the running total and the running mean of yearly mean prices."""
    years = (
        _dated_sales(tables)
        .groupBy(F.trunc("order_date", "YEAR").alias("order_date"))
        .agg(F.sum("sales_amount").alias("total_sales"), whole_mean("price").alias("avg_price"))
    )
    # One row per year: small enough for a window in one task.
    so_far = Window.orderBy("order_date")
    return (
        years.select(
            "order_date",
            "total_sales",
            F.sum("total_sales").over(so_far).alias("running_total_sales"),
            F.sum("avg_price").over(so_far).alias("_prices"),
            F.count("avg_price").over(so_far).alias("_years"),
        )
        .withColumn("moving_average_price", whole_ratio("_prices", "_years"))
        .drop("_prices", "_years")
        .orderBy("order_date")
    )


def product_yoy(tables: Tables) -> DataFrame:
    """Yearly sales per product name against its mean and its previous year with sales."""
    yearly = rollup_by_attributes(
        _dated_sales(tables).withColumn("order_year", F.year("order_date")),
        "product_key",
        tables["dim_products"],
        ["product_name"],
        sums(current_sales="sales_amount"),
        by=["order_year"],
    )
    product = Window.partitionBy("product_name")
    current = F.col("current_sales")

    def direction(difference: str, up: str, down: str, same: str) -> Column:
        return first_match([(F.col(difference) > 0, up), (F.col(difference) < 0, down)], same)

    return (
        yearly.withColumns(
            {
                "_sum": F.sum(current).over(product),
                "_years": F.count(current).over(product),
                "py_sales": F.lag(current).over(product.orderBy("order_year")),
            }
        )
        .withColumn("avg_sales", whole_ratio("_sum", "_years"))
        .withColumns({"diff_avg": current - F.col("avg_sales"), "diff_py": current - F.col("py_sales")})
        .select(
            "order_year",
            "product_name",
            "current_sales",
            "avg_sales",
            "diff_avg",
            direction("diff_avg", "Above Avg", "Below Avg", "Avg").alias("avg_change"),
            "py_sales",
            "diff_py",
            direction("diff_py", "Increase", "Decrease", "No Change").alias("py_change"),
        )
        .orderBy("product_name", "order_year")
    )


# Segments and shares


def product_cost_ranges(tables: Tables) -> DataFrame:
    """Products per cost range; a limit belongs to the lower range, no cost to the top one."""
    cost = F.col("cost")
    ranges = first_match([(cost < 100, "Below 100"), (cost <= 500, "100-500"), (cost <= 1000, "500-1000")], "Above 1000")
    return (
        tables["dim_products"]
        .groupBy(ranges.alias("cost_range"))
        .agg(F.count("product_key").alias("total_products"))
        .orderBy(F.desc("total_products"), "cost_range")
    )


def _segment(sales: str) -> Column:
    long_standing = F.col("lifespan") >= 12
    return first_match(
        [(long_standing & (F.col(sales) > 5000), "VIP"), (long_standing & (F.col(sales) <= 5000), "Regular")], "New"
    )


def sales_by_periods(tables: Tables) -> DataFrame:
    """Sales, quantity and distinct customers by month, quarter and year, all from one stored monthly table."""
    sums = {"total_sales": "sales_amount", "total_quantity": "quantity"}
    monthly = stage(monthly_bitmaps(_sales(tables), "order_date", "customer_key", sums), "monthly")
    periods = [
        roll_up(monthly, period, list(sums), "total_customers").withColumn("period", F.lit(period.lower())) for period in PERIODS
    ]
    return reduce(DataFrame.unionByName, periods).orderBy("period", "period_start")


def customer_segments(tables: Tables) -> DataFrame:
    """Customers per segment; sales of unknown customers form one uncounted customer."""
    first, last = F.min("order_date"), F.max("order_date")
    spending = rollup_by_attributes(
        _sales(tables),
        "customer_key",
        tables["dim_customers"],
        ["customer_key"],
        sums(total_spending="sales_amount")
        | {"first_order": (first, F.min("first_order")), "last_order": (last, F.max("last_order"))},
    )
    return (
        spending.withColumn("lifespan", months_between_boundaries(F.col("first_order"), F.col("last_order")))
        .groupBy(_segment("total_spending").alias("customer_segment"))
        .agg(F.count("customer_key").alias("total_customers"))
        .orderBy(F.desc("total_customers"), "customer_segment")
    )


def category_share(tables: Tables) -> DataFrame:
    # One row per category: small enough for a total in one task.
    overall = F.sum("total_sales").over(Window.partitionBy())
    return (
        _by_product(tables, ["category"], total_sales="sales_amount")
        .withColumn("overall_sales", overall)
        .withColumn("percentage_of_total", percent(F.col("total_sales"), F.col("overall_sales")))
        .orderBy(F.desc("total_sales"), "category")
    )


# Reports


def report_customers_fixed(tables: Tables, as_of: dt.date, view: str | None = None) -> DataFrame:
    """Customers with age group, segment, activity and spending."""
    first, last = F.min("order_date"), F.max("order_date")
    activity = rollup_by_entity(
        _dated_parts(tables, "customer_key"),
        "customer_key",
        tables["dim_customers"],
        ["customer_key", "customer_number", "first_name", "last_name", "birthdate"],
        {
            "total_sales": F.sum("sales_amount"),
            "total_quantity": F.sum("quantity"),
            "last_order_date": last,
            "lifespan": months_between_boundaries(first, last),
        },
        {"total_orders": "order_number", "total_products": "product_key"},
    )
    age = F.col("age")
    bands = [(20, "Under 20"), (30, "20-29"), (40, "30-39"), (50, "40-49")]
    result = activity.withColumn("age", years_between_boundaries(F.col("birthdate"), as_date(as_of))).select(
        "customer_key",
        "customer_number",
        F.concat_ws("", "first_name", F.lit(" "), "last_name").alias("customer_name"),
        "age",
        first_match([(age < limit, label) for limit, label in bands], "50 and above").alias("age_group"),
        _segment("total_sales").alias("customer_segment"),
        "last_order_date",
        months_between_boundaries(F.col("last_order_date"), as_date(as_of)).alias("recency"),
        "total_orders",
        "total_sales",
        "total_quantity",
        "total_products",
        "lifespan",
        F.when(F.col("total_sales") == 0, 0)
        .otherwise(whole_ratio("total_sales", "total_orders"))
        .alias("avg_order_value"),
        _per_month(),
    )
    return as_view(result, view)


def report_customers(tables: Tables, as_of: dt.date, view: str | None = None) -> DataFrame:
    """The same, with the number of products under the name `lifespan`."""
    full = report_customers_fixed(tables, as_of)
    return as_view(full.drop("lifespan").withColumnRenamed("total_products", "lifespan"), view)


def _per_month(name: str = "avg_monthly_spend") -> Column:
    sales = F.col("total_sales")
    return F.when(F.col("lifespan") == 0, sales).otherwise(whole_ratio("total_sales", "lifespan")).alias(name)


def report_products(tables: Tables, as_of: dt.date, view: str | None = None) -> DataFrame:
    """Products with revenue segment, activity and averages."""
    first, last = F.min("order_date"), F.max("order_date")
    price = ratio(F.col("sales_amount"), F.col("quantity")).cast(ROUNDING_TYPE)
    details = ["product_key", "product_name", "category", "subcategory", "cost"]
    activity = rollup_by_entity(
        _dated_parts(tables, "product_key"),
        "product_key",
        tables["dim_products"],
        details,
        {
            "last_sale_date": last,
            "lifespan": months_between_boundaries(first, last),
            "total_sales": F.sum("sales_amount"),
            "total_quantity": F.sum("quantity"),
            "avg_selling_price": round_to(ratio(F.sum(price), F.count(price)), 1),
        },
        {"total_orders": "order_number", "total_customers": "customer_key"},
    )
    segments = first_match(
        [(F.col("total_sales") > 50000, "High-Performer"), (F.col("total_sales") >= 10000, "Mid-Range")],
        "Low-Performer",
    )
    result = activity.select(
        *details,
        "last_sale_date",
        months_between_boundaries(F.col("last_sale_date"), as_date(as_of)).alias("recency_in_months"),
        segments.alias("product_segment"),
        "lifespan",
        "total_orders",
        "total_sales",
        "total_quantity",
        "total_customers",
        "avg_selling_price",
        F.when(F.col("total_orders") == 0, 0)
        .otherwise(whole_ratio("total_sales", "total_orders"))
        .alias("avg_order_revenue"),
        _per_month("avg_monthly_revenue"),
    )
    return as_view(result, view)
