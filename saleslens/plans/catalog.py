"""Product dimension from raw extracts, and checks of a stored report.

Tables: crm_prd_info (product versions), erp_px_cat (categories).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import as_date, months_between_boundaries
from ..functions.numbers import whole_ratio
from ..operators.keys import HOT_ROWS, latest_per_key
from ..operators.ranking import number_rows
from ..operators.rows import metrics_to_rows
from ..operators.sequences import SLICE_ROWS, with_neighbours

Tables = dict[str, DataFrame]

# Product line codes of the raw extract.
PRODUCT_LINES = {"M": "Mountain", "R": "Road", "S": "Other Sales", "T": "Touring"}


def _product_line(code: Column) -> Column:
    names = F.create_map(*[F.lit(text) for pair in PRODUCT_LINES.items() for text in pair])
    return F.coalesce(F.try_element_at(names, F.trim(code)), F.lit("n/a"))


def product_versions(tables: Tables, hot_rows: int = HOT_ROWS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Every version of a product; it ends the day before the next one starts.

    The end dates of the extract are unreliable and are not used.
    """
    versions = tables["crm_prd_info"].drop("prd_end_dt")
    return (
        with_neighbours(
            versions,
            "prd_key",
            ["prd_start_dt", "prd_id"],
            before={},
            after={"_next_start": "prd_start_dt"},
            hot_rows=hot_rows,
            slice_rows=slice_rows,
        )
        .withColumn("prd_end_dt", F.date_sub("_next_start", 1))
        .drop("_next_start")
    )


def build_dim_products(tables: Tables) -> DataFrame:
    """The newest version of each product with its category, line and a new key."""
    newest = latest_per_key(tables["crm_prd_info"], ["prd_key"], [F.desc("prd_start_dt"), F.desc("prd_id")])
    products = newest.select(
        F.col("prd_id").alias("product_id"),
        F.expr("substr(prd_key, 7)").alias("product_number"),
        F.col("prd_nm").alias("product_name"),
        F.translate(F.substring("prd_key", 1, 5), "-", "_").alias("category_id"),
        F.coalesce("prd_cost", F.lit(0)).alias("cost"),
        _product_line(F.col("prd_line")).alias("product_line"),
        F.col("prd_start_dt").alias("start_date"),
    )
    categories = tables["erp_px_cat"].select(
        F.col("id").alias("category_id"), F.col("cat").alias("category"), F.col("subcat").alias("subcategory"), "maintenance"
    )
    order = [F.asc("start_date"), F.asc("product_number"), F.asc("product_id")]
    return number_rows(products.join(categories, "category_id", "left"), order, "product_key").select(
        "product_key",
        "product_id",
        "product_number",
        "product_name",
        "category_id",
        "category",
        "subcategory",
        "maintenance",
        "cost",
        "product_line",
        "start_date",
    )


def conform_categories(tables: Tables, loaded_at: dt.datetime) -> DataFrame:
    """Categories stamped with the time of the load."""
    return tables["erp_px_cat"].withColumn("dwh_create_date", F.lit(loaded_at).cast("timestamp_ntz"))


def check_report_products(report: DataFrame, as_of: dt.date) -> DataFrame:
    """Number of rows of a stored product report that break each rule."""
    sales, lifespan, orders = F.col("total_sales"), F.col("lifespan"), F.col("total_orders")
    segment = (
        F.when(sales > 50000, "High-Performer").when(sales >= 10000, "Mid-Range").otherwise("Low-Performer")
    )
    per_order = F.when(orders == 0, 0).otherwise(whole_ratio("total_sales", "total_orders"))
    per_month = F.when(lifespan == 0, sales).otherwise(whole_ratio("total_sales", "lifespan"))
    recency = months_between_boundaries(F.col("last_sale_date"), as_date(as_of))
    rules = {
        "product_segment": segment,
        "avg_order_revenue": per_order,
        "avg_monthly_revenue": per_month,
        "recency_in_months": recency,
    }
    counts = report.agg(
        *[F.count_if(~F.col(column).eqNullSafe(expected)).alias(column) for column, expected in rules.items()]
    )
    return metrics_to_rows(counts, [(column, [F.col(column)]) for column in rules], ["rule", "violations"])
