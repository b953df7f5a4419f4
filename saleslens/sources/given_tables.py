"""The given test tables in the shape the jobs expect.

Each entry is one SQL text that Spark and the checking engine both read the same
way: a projection, so the work of a job grows with the given tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .schemas import table_schema


SHAPES: dict[str, str] = {
    "dim_products": """
        select
            p_partkey as product_key,
            p_partkey as product_id,
            'PN-' || cast(p_partkey as string) as product_number,
            p_name as product_name,
            p_type as category_id,
            case when p_partkey % 43 = 0 then null else p_type end as category,
            p_brand as subcategory,
            case when p_size % 2 = 0 then 'Yes' else 'No' end as maintenance,
            p_size * 25 as cost,
            case p_partkey % 4 when 0 then 'Road' when 1 then 'Mountain' when 2 then 'Touring' else 'Other Sales' end as product_line,
            cast(date '1995-01-01' + cast(p_partkey % 365 as int) as date) as start_date
        from part
    """,
    "dim_customers": """
        select
            c_custkey as customer_key,
            c_custkey as customer_id,
            c_name as customer_number,
            'Customer' as first_name,
            case when c_custkey % 89 = 0 then null else substr(c_name, 10) end as last_name,
            n_name as country,
            case c_custkey % 2 when 0 then 'Single' else 'Married' end as marital_status,
            case c_custkey % 3 when 0 then 'Male' when 1 then 'Female' else 'n/a' end as gender,
            case when c_custkey % 97 = 0 then null else cast(date '1932-01-01' + cast(c_custkey * 37 % 17000 as int) as date) end as birthdate,
            cast(date '1995-01-01' + cast(c_custkey % 365 as int) as date) as create_date
        from customer join nation on c_nationkey = n_nationkey
    """,
    "fact_sales": """
        select
            'SO' || cast(l_orderkey as string) as order_number,
            l_partkey as product_key,
            case when o_custkey % 5 = 0 and l_partkey % 40 <> 0 then o_custkey + 1 else o_custkey end as customer_key,
            case when l_orderkey % 101 = 0 then null else cast(o_orderdate as date) end as order_date,
            cast(l_shipdate as date) as shipping_date,
            cast(cast(o_orderdate as date) + 12 as date) as due_date,
            cast(floor(l_extendedprice / (case when l_partkey % 10 < 3 then 10 when l_partkey % 10 = 9 then 200 else 50 end)) as int) as sales_amount,
            cast(l_quantity as int) as quantity,
            cast(floor(l_extendedprice / (case when l_partkey % 10 < 3 then 10 when l_partkey % 10 = 9 then 200 else 50 end) / l_quantity) as int) as price
        from lineitem join orders on l_orderkey = o_orderkey
    """,
    "j_customers": """
        select
            c_custkey as customer_id,
            c_name as customer_name,
            cast(date '1995-01-01' + cast(c_custkey * 7 % 1000 as int) as date) as signup_date,
            c_mktsegment as acquisition_channel,
            n_name as country
        from customer join nation on c_nationkey = n_nationkey
    """,
    "j_orders": """
        select
            o_orderkey as order_id,
            case
                when o_custkey % 5 = 0 then o_custkey + 1
                when o_custkey % 5 = 2 and o_orderkey % 6 <> 0 then o_custkey + 1
                else o_custkey
            end as customer_id,
            o_orderdate as order_timestamp,
            cast(cast(floor(o_totalprice / 10) as bigint) as decimal(16,0)) * cast(0.01 as decimal(3,2)) as total_amount
        from orders
    """,
    "order_items": """
        select
            l_orderkey as order_id,
            case l_orderkey % 3 when 0 then l_partkey % 5 when 1 then 5 + l_partkey % 12 else l_partkey end as product_id
        from lineitem
    """,
    "j_products": """
        select
            p_partkey as product_id,
            p_name || ' ' || cast(p_partkey as string) as product_name
        from part
    """,
    "page_events": """
        select
            event_id as event_id,
            user_id as customer_id,
            cast(user_id as string) || '-' || substr(cast(ts as string), 1, 10) as session_id,
            ts as event_timestamp,
            case event_type when 'click' then 'add_to_cart' when 'purchase' then 'purchase' else 'page_view' end as event_type,
            case when event_id % 29 = 0 then '/search' when event_type = 'signup' then '/home' when event_type = 'view' then '/product/' || cast(event_id % 50 as string) when event_type = 'click' then '/cart' when event_type = 'error' then '/checkout' else '/order/confirmation' end as page_url
        from events
    """,
    "f_customers": """
        select
            c_custkey as customer_id,
            c_name as customer_name,
            c_mktsegment as income_bracket,
            300 + c_custkey * 13 % 551 as credit_score
        from customer
    """,
    "accounts": """
        select
            c_custkey as customer_id,
            case when c_custkey % 4 = 0 then 'savings' else 'checking' end as account_type,
            cast(cast(round(c_acctbal * 100) as bigint) as decimal(16,0)) * cast(0.01 as decimal(3,2)) as balance
        from customer
        union all
        select
            s_suppkey,
            'checking',
            cast(cast(round(s_acctbal * 100) as bigint) as decimal(16,0)) * cast(0.01 as decimal(3,2))
        from supplier
    """,
    "financial_transactions": """
        select
            o_orderkey as transaction_id,
            case when o_custkey % 11 = 0 then o_custkey + 1 else o_custkey end as customer_id,
            cast((cast(floor(o_totalprice) as bigint) * (case when o_orderkey % 211 = 0 then 20 when o_orderkey % 7 = 0 then 0 else 1 end) + 995) as decimal(16,0)) * cast(0.01 as decimal(3,2)) as amount,
            o_orderdate + (o_orderkey * 7919 % 86400) * interval '1' second as transaction_date,
            case o_orderstatus when 'P' then 'pending' else 'completed' end as transaction_status,
            case substr(o_orderpriority, 1, 1) when '1' then 'purchase' when '2' then 'purchase' when '3' then 'withdrawal' when '4' then 'transfer' else 'deposit' end as transaction_type,
            'cat_' || cast(o_orderkey % 8 as string) as merchant_category,
            case o_orderkey % 3 when 0 then 'mobile' when 1 then 'web' else 'atm' end as device_type,
            case when o_orderkey % 37 = 0 then 1 else 0 end as is_fraudulent,
            n_name as location_city,
            r_name as location_country
        from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
    """,
    "patient_records": """
        select
            o_orderkey as record_id,
            o_custkey * 8 + o_orderkey % 8 as patient_id,
            'First' || cast(o_custkey % 20 as string) as first_name,
            case when o_custkey % 31 = 0 then null else c_name end as last_name,
            cast(date '1940-01-01' + cast(o_custkey * 37 % 20000 as int) as date) as date_of_birth,
            case when o_orderkey % 41 = 0 then 'n/a' else substr(cast(o_orderdate as string), 1, 10) || ' 08:30:00' end as admission_date,
            case o_orderkey % 8 when 0 then 'M' when 1 then 'Male' when 2 then 'MALE' when 3 then 'F' when 4 then 'Female' when 5 then 'FEMALE' when 6 then 'x' else null end as gender,
            case when o_orderkey % 23 = 0 then 'PO Box 7' else cast(o_orderkey % 999 as string) || ' Main St, ' || n_name || ', ' || r_name end as patient_address,
            case o_orderkey % 5 when 0 then null when 1 then '' else '555-' || cast(o_orderkey as string) end as phone_number
        from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
    """,
    "crm_prd_info": """
        select
            p_partkey as prd_id,
            lpad(cast(cast((p_partkey - p_partkey % 3) / 3 as bigint) % 37 as string), 2, '0') || '-PX-P'
                || cast(cast((p_partkey - p_partkey % 3) / 3 as bigint) as string) as prd_key,
            p_name as prd_nm,
            case when p_partkey % 47 = 0 then null else p_size * 10 end as prd_cost,
            case p_partkey % 5 when 0 then 'R ' when 1 then 'M ' when 2 then 'S ' when 3 then 'T ' else null end as prd_line,
            cast(date '2003-07-01' + cast(p_partkey % 3 * 365 + p_partkey % 100 as int) as date) as prd_start_dt,
            case when p_partkey % 3 = 2 then null else cast(date '2003-07-01' + cast(p_partkey % 200 as int) as date) end as prd_end_dt
        from part
    """,
    "erp_px_cat": """
        select distinct
            case when cast((p_partkey - p_partkey % 3) / 3 as bigint) % 37 = 36 then 'ZZ_PX'
                else lpad(cast(cast((p_partkey - p_partkey % 3) / 3 as bigint) % 37 as string), 2, '0') || '_PX' end as id,
            'Category ' || cast(cast((p_partkey - p_partkey % 3) / 3 as bigint) % 37 % 4 as string) as cat,
            'Group ' || cast(cast((p_partkey - p_partkey % 3) / 3 as bigint) % 37 as string) as subcat,
            case when cast((p_partkey - p_partkey % 3) / 3 as bigint) % 37 % 2 = 0 then 'Yes' else 'No' end as maintenance
        from part
    """,
}

# Declared, so that reading a table needs no job to look into its files.
BASE_TABLES = {
    "region": "r_regionkey integer, r_name string",
    "nation": "n_nationkey integer, n_name string, n_regionkey integer",
    "customer": "c_custkey long, c_name string, c_nationkey integer, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey integer, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size integer, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber integer, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}

# Which shape stands for which table of a group of jobs.
WAREHOUSE = {name: name for name in ("dim_products", "dim_customers", "fact_sales")}
JOURNEY = {
    "customers": "j_customers",
    "orders": "j_orders",
    "order_items": "order_items",
    "products": "j_products",
    "page_events": "page_events",
}
FINANCE = {
    "customers": "f_customers",
    "accounts": "accounts",
    "financial_transactions": "financial_transactions",
}
CLEANING = {"patient_records": "patient_records"}
CATALOG = {"crm_prd_info": "crm_prd_info", "erp_px_cat": "erp_px_cat"}


def shaped(spark: SparkSession, folder: str, shape: str) -> DataFrame:
    """One shape over the Parquet tables of a folder."""
    text, base = SHAPES[shape], {}
    for name, columns in BASE_TABLES.items():
        marked = re.sub(rf"\b(from|join) {name}\b", rf"\1 {{{name}}}", text)
        if marked != text:
            text, base[name] = marked, spark.read.schema(table_schema(columns)).parquet(f"{folder}/{name}.parquet")
    return spark.sql(text, **base)


class GivenTables(dict):
    """The tables of a group of jobs, each built when a job asks for it."""

    def __init__(self, spark: SparkSession, folder: str, group: dict[str, str]):
        super().__init__()
        self._make = lambda name: shaped(spark, folder, group[name])
        self._names = list(group)

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self._make(name)
        return self[name]

    def items(self):
        return [(name, self[name]) for name in self._names]
