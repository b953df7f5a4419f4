"""Expected results of the sales, catalog and profile jobs."""

from .spelling import big, dbl, pct, rounded, small, with_shapes

AS_OF = "DATE '2001-08-01'"
BY_PRODUCT = "fact_sales f LEFT JOIN dim_products p ON p.product_key = f.product_key"
BY_CUSTOMER = "fact_sales f LEFT JOIN dim_customers c ON c.customer_key = f.customer_key"
DATED = "order_date IS NOT NULL"
REVENUE = big("sum(sales_amount)")
NAMED_REVENUE = f"SELECT product_name, {REVENUE} AS total_revenue FROM {BY_PRODUCT} GROUP BY product_name"
CUSTOMER_REVENUE = (
    f"SELECT c.customer_key, c.first_name, c.last_name, {REVENUE} AS total_revenue FROM {BY_CUSTOMER} GROUP BY ALL"
)


def whole_mean(column: str) -> str:
    return big(f"sum({column}) // count({column})")


def _periods(*names_and_values: str) -> str:
    periods = ", ".join(names_and_values)
    places = ", ".join(str(i + 1) for i in range(len(names_and_values)))
    return f"""
        SELECT {periods}, {REVENUE} AS total_sales, count(DISTINCT customer_key) AS total_customers,
            {big('sum(quantity)')} AS total_quantity
        FROM fact_sales f WHERE f.{DATED} GROUP BY {places}"""


def _segment(sales: str) -> str:
    return (
        f"CASE WHEN lifespan >= 12 AND {sales} > 5000 THEN 'VIP' "
        f"WHEN lifespan >= 12 AND {sales} <= 5000 THEN 'Regular' ELSE 'New' END"
    )


_CUSTOMERS = f"""
    bought AS (
        SELECT c.customer_key, c.customer_number,
            coalesce(c.first_name, '') || ' ' || coalesce(c.last_name, '') AS customer_name,
            year({AS_OF}) - year(c.birthdate) AS age, count(DISTINCT f.order_number) AS total_orders,
            sum(f.sales_amount) AS total_sales, sum(f.quantity) AS total_quantity,
            count(DISTINCT f.product_key) AS total_products, max(f.order_date) AS last_order_date,
            date_diff('month', min(f.order_date), max(f.order_date)) AS lifespan
        FROM {BY_CUSTOMER} WHERE f.{DATED} GROUP BY 1, 2, 3, 4
    ), report AS (
        SELECT customer_key, customer_number, customer_name, {small('age')} AS age,
            CASE WHEN age < 20 THEN 'Under 20' WHEN age < 30 THEN '20-29' WHEN age < 40 THEN '30-39'
                 WHEN age < 50 THEN '40-49' ELSE '50 and above' END AS age_group,
            {_segment('total_sales')} AS customer_segment, last_order_date,
            {small(f"date_diff('month', last_order_date, {AS_OF})")} AS recency, total_orders,
            {big('total_sales')} AS total_sales, {big('total_quantity')} AS total_quantity, total_products,
            {small('lifespan')} AS lifespan,
            {big('CASE WHEN total_sales = 0 THEN 0 ELSE total_sales // total_orders END')} AS avg_order_value,
            {big('CASE WHEN lifespan = 0 THEN total_sales ELSE total_sales // lifespan END')} AS avg_monthly_spend
        FROM bought
    )"""

_PRODUCTS = f"""
    sold AS (
        SELECT p.product_key, product_name, category, subcategory, cost, max(order_date) AS last_sale_date,
            date_diff('month', min(order_date), max(order_date)) AS lifespan,
            count(DISTINCT order_number) AS total_orders, count(DISTINCT customer_key) AS total_customers,
            sum(sales_amount) AS total_sales, sum(quantity) AS total_quantity,
            sum(CAST(CAST(sales_amount AS DOUBLE) / nullif(quantity, 0) AS DECIMAL(30,8))) AS prices,
            count(sales_amount / nullif(quantity, 0)) AS priced
        FROM {BY_PRODUCT} WHERE f.{DATED} GROUP BY p.product_key, product_name, category, subcategory, cost
    ), report AS (
        SELECT product_key, product_name, category, subcategory, cost, last_sale_date,
            {small(f"date_diff('month', last_sale_date, {AS_OF})")} AS recency_in_months,
            CASE WHEN total_sales > 50000 THEN 'High-Performer' WHEN total_sales >= 10000 THEN 'Mid-Range'
                 ELSE 'Low-Performer' END AS product_segment,
            {small('lifespan')} AS lifespan, total_orders, {big('total_sales')} AS total_sales,
            {big('total_quantity')} AS total_quantity, total_customers,
            {rounded('CAST(prices AS DOUBLE) / nullif(priced, 0)', 1)} AS avg_selling_price,
            {big('CASE WHEN total_orders = 0 THEN 0 ELSE total_sales // total_orders END')} AS avg_order_revenue,
            {big('CASE WHEN lifespan = 0 THEN total_sales ELSE total_sales // lifespan END')} AS avg_monthly_revenue
        FROM sold
    )"""

_TABLE_COLUMNS = {"dim_customers": 10, "dim_products": 11, "fact_sales": 9}
_CUSTOMER_COLUMNS = {
    "customer_key": "bigint",
    "customer_id": "bigint",
    "customer_number": "string",
    "first_name": "string",
    "last_name": "string",
    "country": "string",
    "marital_status": "string",
    "gender": "string",
    "birthdate": "date",
    "create_date": "date",
}

_LINE = """CASE trim(prd_line) WHEN 'M' THEN 'Mountain' WHEN 'R' THEN 'Road' WHEN 'S' THEN 'Other Sales'
    WHEN 'T' THEN 'Touring' ELSE 'n/a' END"""

# The tables of the star: their columns, and the field that a damaged extract has a word in.
_STAR = {
    "dim_customers": ("customer_id", "customer_key", "customer_key customer_id customer_number first_name last_name country "
        "marital_status gender birthdate create_date"),
    "dim_products": ("cost", "product_key", "product_key product_id product_number product_name category_id category subcategory "
        "maintenance cost product_line start_date"),
    "fact_sales": ("quantity", "product_key", "order_number product_key customer_key order_date shipping_date due_date "
        "sales_amount quantity price"),
}


def _line(column: str, key: str, columns: str) -> str:
    """The text of a line whose field `column` is spoiled."""
    fields = [f"'n/a'" if c == column else f"coalesce(cast({c} as varchar), '')" for c in columns.split()]
    return " || ',' || ".join(fields)


def _reasons(table: str, number: str, key: str, columns: str) -> str:
    """Lines whose fields are spoiled by rules on the key, and why each is refused."""
    text, kind = _SPOILED[table]
    words = f"{key} % 13 = 0"
    spoiled = {number: f"CASE WHEN {words} THEN 'n/a' ELSE cast({number} AS VARCHAR) END",
        text: f"CASE WHEN {key} % 17 = 0 THEN rpad({text}, 51, 'x') ELSE {text} END"}
    reasons = {text: f"CASE WHEN {key} % 17 = 0 THEN '{text}: longer than 50' END", number: f"CASE WHEN {words} THEN '{number}: not {kind}' END"}
    refused = f"{words} OR {key} % 17 = 0"
    if table == "fact_sales":
        spoiled[number] = f"""CASE WHEN {words} THEN 'n/a' WHEN {key} % 19 = 0 THEN '300' WHEN {key} % 23 = 0 THEN '-1'
            ELSE cast({number} AS VARCHAR) END"""
        reasons[number] = f"""CASE WHEN {words} THEN 'quantity: not smallint' WHEN {key} % 19 = 0 THEN 'quantity: above 255'
            WHEN {key} % 23 = 0 THEN 'quantity: below 0' END"""
        refused += f" OR {key} % 19 = 0 OR {key} % 23 = 0"
    line = " || ',' || ".join(f"coalesce({spoiled.get(c, f'cast({c} AS VARCHAR)')}, '')" for c in columns.split())
    listed = ", ".join(reasons[c] for c in columns.split() if c in reasons)
    return f"SELECT '{table}' AS table_name, {line} AS rejected_line, concat_ws('; ', {listed}) AS reasons FROM {table} WHERE {refused}"


# For each table of the star: the text that is made too long, and the type of the number that a word takes the place of.
_SPOILED = {"dim_customers": ("customer_number", "int"), "dim_products": ("product_name", "int"), "fact_sales": ("order_number", "smallint")}

_BODIES = {
    "sales_by_periods": " UNION ALL ".join(
        f"""SELECT '{period}' AS period, CAST(date_trunc('{period}', order_date) AS DATE) AS period_start, {REVENUE} AS total_sales,
            {big('sum(quantity)')} AS total_quantity, count(DISTINCT customer_key) AS total_customers
            FROM fact_sales WHERE {DATED} GROUP BY ALL"""
        for period in ("month", "quarter", "year")
    ),
    "load_reject_reasons": " UNION ALL ".join(_reasons(t, *parts) for t, parts in _STAR.items()),
    "load_gold": " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS row_count, count({c}) AS filled,
            count(DISTINCT {c}) AS different, CAST(min({c}) AS VARCHAR) AS least, CAST(max({c}) AS VARCHAR) AS greatest FROM {t}"""
        for t, (_, _, columns) in _STAR.items()
        for c in columns.split()
    ),
    "load_rejects": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, {_line(*parts)} AS rejected_line FROM {t} WHERE {parts[1]} % 13 = 0"
        for t, parts in _STAR.items()
    ),
    "profile_tables": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS row_count, {small(str(n))} AS column_count FROM {t}"
        for t, n in _TABLE_COLUMNS.items()
    ),
    "profile_columns": " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, '{t}' AS data_type, count(*) - count({c}) AS null_count,
            {small(f'max(length(CAST({c} AS VARCHAR)))')} AS max_length, CAST(min({c}) AS VARCHAR) AS min_value,
            CAST(max({c}) AS VARCHAR) AS max_value, count(DISTINCT {c}) AS distinct_count FROM dim_customers"""
        for c, t in _CUSTOMER_COLUMNS.items()
    ),
    "profile_sketched": " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, '{t}' AS data_type, count(*) - count({c}) AS null_count,
            {small(f'max(length(CAST({c} AS VARCHAR)))')} AS max_length, CAST(min({c}) AS VARCHAR) AS min_value,
            CAST(max({c}) AS VARCHAR) AS max_value, true AS distinct_within_error FROM dim_customers"""
        for c, t in _CUSTOMER_COLUMNS.items()
        if c != "country"
    ),
    "dim_countries": "SELECT DISTINCT country FROM dim_customers",
    "dim_product_hierarchy": "SELECT DISTINCT category, subcategory, product_name FROM dim_products",
    "order_date_range": f"""
        SELECT min(order_date) AS first_order_date, max(order_date) AS last_order_date,
            {small("date_diff('month', min(order_date), max(order_date))")} AS order_range_months
        FROM fact_sales""",
    "customer_age_range": f"""
        SELECT min(birthdate) AS oldest_birthdate, {small(f'year({AS_OF}) - year(min(birthdate))')} AS oldest_age,
            max(birthdate) AS youngest_birthdate, {small(f'year({AS_OF}) - year(max(birthdate))')} AS youngest_age
        FROM dim_customers""",
    "total_sales": f"SELECT {REVENUE} AS total_sales FROM fact_sales",
    "total_quantity": f"SELECT {big('sum(quantity)')} AS total_quantity FROM fact_sales",
    "avg_price": f"SELECT {whole_mean('price')} AS avg_price FROM fact_sales",
    "order_lines": "SELECT count(order_number) AS total_orders FROM fact_sales",
    "orders_distinct": "SELECT count(DISTINCT order_number) AS total_orders FROM fact_sales",
    "total_products": "SELECT count(product_name) AS total_products FROM dim_products",
    "total_customers": "SELECT count(customer_key) AS total_customers FROM dim_customers",
    "customers_with_orders": "SELECT count(DISTINCT customer_key) AS total_customers FROM fact_sales",
    "measures_report": f"""
        SELECT 'Total Sales' AS measure_name, {REVENUE} AS measure_value FROM fact_sales
        UNION ALL SELECT 'Total Quantity', {big('sum(quantity)')} FROM fact_sales
        UNION ALL SELECT 'Average Price', {whole_mean('price')} FROM fact_sales
        UNION ALL SELECT 'Total Orders', count(DISTINCT order_number) FROM fact_sales
        UNION ALL SELECT 'Total Products', count(DISTINCT product_name) FROM dim_products
        UNION ALL SELECT 'Total Customers', count(customer_key) FROM dim_customers""",
    "customers_by_country": "SELECT country, count(customer_key) AS total_customers FROM dim_customers GROUP BY country",
    "customers_by_gender": "SELECT gender, count(customer_key) AS total_customers FROM dim_customers GROUP BY gender",
    "products_by_category": "SELECT category, count(product_key) AS total_products FROM dim_products GROUP BY category",
    "avg_cost_by_category": f"SELECT category, {whole_mean('cost')} AS avg_cost FROM dim_products GROUP BY category",
    "revenue_by_category": f"SELECT category, {REVENUE} AS total_revenue FROM {BY_PRODUCT} GROUP BY category",
    "revenue_by_customer": CUSTOMER_REVENUE,
    "items_by_country": f"""
        SELECT c.country, {big('sum(f.quantity)')} AS total_sold_items FROM {BY_CUSTOMER} GROUP BY c.country""",
    "top5_products": f"{NAMED_REVENUE} ORDER BY total_revenue DESC NULLS LAST, product_name NULLS FIRST LIMIT 5",
    "top5_products_ranked": f"""
        WITH named AS ({NAMED_REVENUE})
        SELECT *, {small('rank() OVER (ORDER BY total_revenue DESC NULLS LAST)')} AS rank_products FROM named
        QUALIFY rank_products <= 5""",
    "bottom5_products": f"{NAMED_REVENUE} ORDER BY total_revenue NULLS FIRST, product_name NULLS FIRST LIMIT 5",
    "top10_customers": f"{CUSTOMER_REVENUE} ORDER BY total_revenue DESC NULLS LAST, c.customer_key NULLS FIRST LIMIT 10",
    "bottom3_customers_orders": f"""
        SELECT c.customer_key, c.first_name, c.last_name, count(DISTINCT f.order_number) AS total_orders
        FROM {BY_CUSTOMER} GROUP BY ALL ORDER BY total_orders, c.customer_key NULLS FIRST LIMIT 3""",
    "sales_by_year_month": _periods(
        f"{small('year(f.order_date)')} AS order_year", f"{small('month(f.order_date)')} AS order_month"
    ),
    "sales_by_month_trunc": _periods("CAST(date_trunc('month', f.order_date) AS DATE) AS order_date"),
    "sales_by_month_label": _periods("strftime(f.order_date, '%Y-%b') AS order_date"),
    "cumulative_sales": f"""
        WITH years AS (
            SELECT CAST(date_trunc('year', f.order_date) AS DATE) AS y, sum(sales_amount) AS sales,
                sum(price) // count(price) AS mean_price
            FROM fact_sales f WHERE f.{DATED} GROUP BY 1
        )
        SELECT y AS order_date, {big('sales')} AS total_sales,
            {big('sum(sales) OVER (ORDER BY y)')} AS running_total_sales,
            {big('sum(mean_price) OVER (ORDER BY y) // count(mean_price) OVER (ORDER BY y)')} AS moving_average_price
        FROM years""",
    "product_yoy": f"""
        WITH yearly AS (
            SELECT year(f.order_date) AS y, product_name, {REVENUE} AS sales
            FROM {BY_PRODUCT} WHERE f.{DATED} GROUP BY ALL
        ), compared AS (
            SELECT *, {big('sum(sales) OVER (PARTITION BY product_name) // count(sales) OVER (PARTITION BY product_name)')} AS mid,
                lag(sales) OVER (PARTITION BY product_name ORDER BY y) AS before
            FROM yearly
        )
        SELECT {small('y')} AS order_year, product_name, sales AS current_sales, mid AS avg_sales, sales - mid AS diff_avg,
            CASE WHEN sales > mid THEN 'Above Avg' WHEN sales < mid THEN 'Below Avg' ELSE 'Avg' END AS avg_change,
            before AS py_sales, sales - before AS diff_py,
            CASE WHEN sales > before THEN 'Increase' WHEN sales < before THEN 'Decrease' ELSE 'No Change' END AS py_change
        FROM compared""",
    "product_cost_ranges": """
        SELECT CASE WHEN cost IS NULL OR cost > 1000 THEN 'Above 1000' WHEN cost > 500 THEN '500-1000'
            WHEN cost >= 100 THEN '100-500' ELSE 'Below 100' END AS cost_range, count(product_key) AS total_products
        FROM dim_products GROUP BY 1""",
    "customer_segments": f"""
        WITH spending AS (
            SELECT c.customer_key, sum(f.sales_amount) AS spent,
                date_diff('month', min(f.order_date), max(f.order_date)) AS lifespan
            FROM {BY_CUSTOMER} GROUP BY c.customer_key
        )
        SELECT {_segment('spent')} AS customer_segment, count(customer_key) AS total_customers FROM spending GROUP BY 1""",
    "category_share": f"""
        WITH shares AS (SELECT category, {REVENUE} AS sales FROM {BY_PRODUCT} GROUP BY category)
        SELECT category, sales AS total_sales, {big('(SELECT sum(sales) FROM shares)')} AS overall_sales,
            {pct('sales', '(SELECT sum(sales) FROM shares)')} AS percentage_of_total
        FROM shares""",
    "report_customers": f"""
        WITH {_CUSTOMERS}
        SELECT * EXCLUDE (lifespan, total_products), total_products AS lifespan FROM report""",
    "report_customers_fixed": f"WITH {_CUSTOMERS} SELECT * FROM report",
    "report_products": f"WITH {_PRODUCTS} SELECT * FROM report",
    "check_report_products": f"""
        WITH {_PRODUCTS}, stored AS (
            SELECT *, avg_order_revenue + CASE WHEN product_key % 17 = 0 THEN 1 ELSE 0 END AS shown_order,
                CASE WHEN product_key % 19 = 0 THEN 'Low-Performer' ELSE product_segment END AS shown_segment
            FROM report
        )
        SELECT 'product_segment' AS rule, {big('count_if(shown_segment <> product_segment)')} AS violations FROM stored
        UNION ALL SELECT 'avg_order_revenue', {big('count_if(shown_order <> avg_order_revenue)')} FROM stored
        UNION ALL SELECT 'avg_monthly_revenue', count(*) FILTER (false) FROM stored
        UNION ALL SELECT 'recency_in_months', count(*) FILTER (false) FROM stored""",
    "product_versions": """
        SELECT prd_id, prd_key, prd_nm, prd_cost, prd_line, prd_start_dt,
            CAST(lead(prd_start_dt) OVER (PARTITION BY prd_key ORDER BY prd_start_dt, prd_id) - 1 AS DATE) AS prd_end_dt
        FROM crm_prd_info""",
    "build_dim_products": f"""
        WITH newest AS (
            SELECT * FROM crm_prd_info
            QUALIFY lead(prd_start_dt) OVER (PARTITION BY prd_key ORDER BY prd_start_dt, prd_id) IS NULL
        )
        SELECT row_number() OVER (ORDER BY prd_start_dt, substr(prd_key, 7), prd_id) AS product_key, prd_id AS product_id,
            substr(prd_key, 7) AS product_number, prd_nm AS product_name,
            replace(substr(prd_key, 1, 5), '-', '_') AS category_id, cat AS category, subcat AS subcategory, maintenance,
            coalesce(prd_cost, 0) AS cost, {_LINE} AS product_line, prd_start_dt AS start_date
        FROM newest LEFT JOIN erp_px_cat ON id = replace(substr(prd_key, 1, 5), '-', '_')""",
    "conform_categories": "SELECT *, TIMESTAMP '2020-02-03 04:05:06.7' AS dwh_create_date FROM erp_px_cat",
}

# Jobs over tables that were stored in another way give the same.
_BODIES["load_gold_keeps_old"] = _BODIES["load_gold"]
_BODIES["report_products_by_month"] = _BODIES["report_products_by_key"] = _BODIES["report_products"]
_BODIES["report_customers_fixed_by_key"] = _BODIES["report_customers_fixed"]

SQL = {key: with_shapes(body) for key, body in _BODIES.items()}
