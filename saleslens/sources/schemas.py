"""Declared schemas of the sales star and of the raw product extracts."""

from __future__ import annotations

from pyspark.sql.types import StringType, StructType

from ..operators.limits import Limit


def table_schema(columns: str) -> StructType:
    schema = StructType()
    for column in columns.split(", "):
        schema.add(*column.split())
    return schema


DIM_CUSTOMERS = table_schema(
    "customer_key integer, customer_id integer, customer_number string, first_name string, last_name string, "
    "country string, marital_status string, gender string, birthdate date, create_date date"
)

DIM_PRODUCTS = table_schema(
    "product_key integer, product_id integer, product_number string, product_name string, category_id string, "
    "category string, subcategory string, maintenance string, cost integer, product_line string, start_date date"
)

FACT_SALES = table_schema(
    "order_number string, product_key integer, customer_key integer, order_date date, shipping_date date, due_date date, "
    "sales_amount integer, quantity short, price integer"
)

REPORT_PRODUCTS = table_schema(
    "product_key integer, product_name string, category string, subcategory string, cost integer, last_sale_date date, "
    "recency_in_months integer, product_segment string, lifespan integer, total_orders integer, total_sales integer, "
    "total_quantity integer, total_customers integer, avg_selling_price double, avg_order_revenue integer, "
    "avg_monthly_revenue integer"
)

CRM_PRD_INFO = table_schema(
    "prd_id integer, prd_key string, prd_nm string, prd_cost integer, prd_line string, prd_start_dt date, prd_end_dt date"
)

ERP_PX_CAT = table_schema("id string, cat string, subcat string, maintenance string")

GOLD = {"dim_customers": DIM_CUSTOMERS, "dim_products": DIM_PRODUCTS, "fact_sales": FACT_SALES}

# The declared lengths and ranges of the star.
LONGEST_TEXT = 50
QUANTITIES = (0, 255)


def _star_limits(schema: StructType) -> dict[str, Limit]:
    texts = {f.name: Limit(longest=LONGEST_TEXT) for f in schema if isinstance(f.dataType, StringType)}
    return texts | ({"quantity": Limit(least=QUANTITIES[0], most=QUANTITIES[1])} if "quantity" in schema.names else {})


GOLD_LIMITS = {name: _star_limits(schema) for name, schema in GOLD.items()}
