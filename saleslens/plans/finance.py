"""Analysis of financial transactions.

Tables: customers, accounts, financial_transactions. `customers` holds one row
per customer_id.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dates import as_date, days_between
from ..functions.labels import above, first_match, position
from ..functions.numbers import ROUNDING_TYPE, count_where, mean, percent, ratio, round_to, rounded_mean
from ..operators.keys import HOT_ROWS, latest_per_key
from ..operators.months import in_period
from ..operators.ranking import add_ntiles
from ..operators.rows import as_view, metrics_to_rows
from ..operators.scores import rfm_segment, score_customers
from ..operators.sequences import SLICE_ROWS, with_neighbours
from ..operators.staging import stage

Tables = dict[str, DataFrame]

CUSTOMER = ["customer_id", "customer_name", "income_bracket"]


def _completed(tables: Tables) -> DataFrame:
    return tables["financial_transactions"].filter("transaction_status = 'completed'")


def _is_fraud() -> Column:
    return F.col("is_fraudulent") == 1


def _share(condition: Column, digits: int) -> Column:
    return percent(count_where(condition), F.count("*"), digits)


def fin_clv_quartiles(tables: Tables) -> DataFrame:
    """Customers in four spending quartiles with yearly value estimates."""
    spending = (
        _completed(tables)
        .groupBy("customer_id")
        .agg(
            F.count("transaction_id").alias("total_transactions"),
            F.sum("amount").alias("total_spent"),
            days_between(F.min("transaction_date"), F.max("transaction_date")).alias("customer_lifetime_days"),
        )
    )
    yearly = ratio(F.col("total_spent"), F.col("customer_lifetime_days")) * 365
    customers = (
        tables["customers"]
        .select("customer_id")
        .join(spending, "customer_id")
        .withColumn("estimated_annual_clv", yearly.cast(ROUNDING_TYPE))
    )
    order = [("total_spent", False), ("customer_id", True)]
    return (
        add_ntiles(customers, [("customer_value_segment", 4, order)])
        .groupBy("customer_value_segment")
        .agg(
            F.count("*").alias("customer_count"),
            rounded_mean(F.col("total_spent")).alias("avg_total_spent"),
            rounded_mean(F.col("estimated_annual_clv")).alias("avg_annual_clv"),
            rounded_mean(F.col("total_transactions")).alias("avg_transactions"),
        )
        .orderBy("customer_value_segment")
    )


def fin_monthly_trend(tables: Tables) -> DataFrame:
    """Monthly volume with a three-month moving average and growth."""
    months = (
        _completed(tables)
        .groupBy(F.year("transaction_date").alias("year"), F.month("transaction_date").alias("month"))
        .agg(
            F.count("*").alias("transaction_count"),
            F.sum("amount").alias("total_volume"),
            count_where(_is_fraud()).alias("fraud_cases"),
        )
    )
    # One row per calendar month: small enough for a window in one task.
    by_month = Window.orderBy("year", "month")
    last_three = by_month.rowsBetween(-2, 0)
    volume, previous = F.col("total_volume"), F.col("volume_previous_month")
    return (
        months.withColumn("volume_previous_month", F.lag("total_volume").over(by_month))
        .select(
            "year",
            "month",
            "transaction_count",
            "total_volume",
            round_to(ratio(F.sum(volume).over(last_three), F.count(volume).over(last_three)), 2).alias(
                "moving_avg_3month"
            ),
            "volume_previous_month",
            round_to(ratio(volume - previous, previous) * 100, 2).alias("mom_growth_percentage"),
            percent(F.col("fraud_cases"), F.col("transaction_count"), 4).alias("fraud_rate_percentage"),
        )
        .orderBy("year", "month")
    )


def _exact_spread(amount: str) -> Column:
    """Population standard deviation from exact sums of cents, the same for every order of the rows."""
    cents = (F.col(amount) * 100).cast("decimal(18,0)")
    n, total, squares = F.count(amount), F.sum(cents), F.sum((cents * cents).cast("decimal(28,0)"))
    varied = (n * squares).cast("decimal(38,0)") - (total * total).cast("decimal(38,0)")
    return F.sqrt(varied.cast("double")) / n / 100


def _with_zscores(tables: Tables, min_purchases: int) -> DataFrame:
    """The patterns are staged, so both sides of the last join are plain shuffles and adaptive execution can
    split a customer with many transactions."""
    completed = _completed(tables)
    patterns = (
        completed.filter("transaction_type = 'purchase'")
        .groupBy("customer_id")
        .agg(
            mean(F.col("amount")).alias("avg_amount"),
            _exact_spread("amount").alias("std_amount"),
            F.count("*").alias("_purchases"),
        )
        .filter(F.col("_purchases") >= min_purchases)
        .drop("_purchases")
        .join(tables["customers"].select("customer_id", "customer_name"), "customer_id")
    )
    z_score = ratio(F.col("amount").cast("double") - F.col("avg_amount"), F.col("std_amount"))
    levels = [(3, "High Anomaly"), (2, "Medium Anomaly")]
    return (
        completed.join(stage(patterns, "usual-purchases"), "customer_id")
        .withColumn("z_score", z_score)
        .withColumn("anomaly_level", above(F.abs("z_score"), levels, "Normal"))
    )


def fin_zscore_rows(tables: Tables, min_purchases: int = 3) -> DataFrame:
    """Each completed transaction against its customer's usual purchase."""
    return _with_zscores(tables, min_purchases).select(
        "transaction_id",
        "customer_id",
        "customer_name",
        "amount",
        "transaction_date",
        "merchant_category",
        *[round_to(F.col(c), 4).alias(c) for c in ("avg_amount", "std_amount", "z_score")],
        "anomaly_level",
    )


def fin_zscore_anomalies(tables: Tables, min_purchases: int = 3) -> DataFrame:
    return (
        _with_zscores(tables, min_purchases)
        .groupBy("anomaly_level")
        .agg(
            F.count("*").alias("transaction_count"),
            rounded_mean(F.col("amount")).alias("avg_amount"),
            _share(_is_fraud(), 2).alias("fraud_capture_rate"),
        )
        .orderBy(position(F.col("anomaly_level"), ["High Anomaly", "Medium Anomaly"]))
    )


def fin_rfm_scores(tables: Tables, as_of: dt.date) -> DataFrame:
    """Scores and segment of each customer with completed transactions."""
    activity = (
        _completed(tables)
        .groupBy("customer_id")
        .agg(
            days_between(F.max("transaction_date"), as_date(as_of)).alias("recency_days"),
            F.count("transaction_id").alias("frequency"),
            F.sum("amount").alias("monetary"),
        )
    )
    customers = tables["customers"].select(*CUSTOMER).join(activity, "customer_id")
    return score_customers(customers, "customer_id").withColumn("customer_segment", rfm_segment(4))


def fin_rfm_segments(tables: Tables, as_of: dt.date) -> DataFrame:
    return (
        fin_rfm_scores(tables, as_of)
        .groupBy("customer_segment")
        .agg(
            F.count("*").alias("customer_count"),
            rounded_mean(F.col("monetary")).alias("avg_spending"),
            rounded_mean(F.col("frequency")).alias("avg_frequency"),
            rounded_mean(F.col("recency_days")).alias("avg_recency_days"),
        )
        .orderBy(F.desc("avg_spending"), "customer_segment")
    )


def _volume_by(tables: Tables, by: list[str], average: str, *extra: Column) -> DataFrame:
    return (
        _completed(tables)
        .groupBy(*by)
        .agg(
            F.count("*").alias("transaction_count"),
            F.sum("amount").alias("total_volume"),
            rounded_mean(F.col("amount")).alias(average),
            *extra,
            _share(_is_fraud(), 4).alias("fraud_rate_percent"),
        )
    )


def _by_volume(df: DataFrame, by: list[str]) -> DataFrame:
    return df.orderBy(F.desc("total_volume"), *by)


def fin_merchant_category(tables: Tables) -> DataFrame:
    by = ["merchant_category"]
    unique = F.countDistinct("customer_id").alias("unique_customers")
    return _by_volume(
        _volume_by(tables, by, "avg_transaction_value", unique).withColumn(
            "revenue_per_customer", round_to(ratio(F.col("total_volume"), F.col("unique_customers")), 2)
        ),
        by,
    )


def fin_geography(tables: Tables) -> DataFrame:
    by = ["location_city", "location_country"]
    unique = F.countDistinct("customer_id").alias("unique_customers")
    mobile = _share(F.col("device_type") == "mobile", 2).alias("mobile_usage_percent")
    return _by_volume(_volume_by(tables, by, "avg_transaction_size", unique, mobile), by)


def _day_part(hour: Column) -> Column:
    return first_match([(hour <= 12, "Morning"), (hour <= 18, "Afternoon")], "Evening")


def _purchase_share() -> Column:
    return _share(F.col("transaction_type") == "purchase", 2).alias("purchase_rate_percent")


def fin_device_channel(tables: Tables) -> DataFrame:
    """Per device; `peak_usage_time` is the day part of the earliest transaction."""
    by = ["device_type"]
    peak = _day_part(F.hour(F.min("transaction_date"))).alias("peak_usage_time")
    return _by_volume(_volume_by(tables, by, "avg_transaction_size", _purchase_share(), peak), by)


def fin_device_channel_fixed(tables: Tables) -> DataFrame:
    """Per device; `peak_usage_time` is the day part of the busiest hour."""
    by = ["device_type"]
    hours = (
        _completed(tables)
        .filter("transaction_date is not null")
        .groupBy(F.col("device_type").alias("_device"), F.hour("transaction_date").alias("peak_hour"))
        .agg(F.count("*").alias("peak_hour_transactions"))
    )
    busiest = latest_per_key(hours, ["_device"], [F.desc("peak_hour_transactions"), F.asc("peak_hour")])
    devices = _volume_by(tables, by, "avg_transaction_size", _purchase_share())
    return _by_volume(
        devices.join(busiest, F.col("device_type").eqNullSafe(F.col("_device")), "left")
        .drop("_device")
        .withColumn("peak_usage_time", _day_part(F.col("peak_hour"))),
        by,
    )


def fin_sequence_rows(tables: Tables, hot_rows: int = HOT_ROWS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Each completed transaction with its customer's previous and next one."""
    moves = _completed(tables).select(
        "transaction_id", "customer_id", "transaction_date", "transaction_type", "amount", "merchant_category"
    )
    return (
        with_neighbours(
            moves,
            "customer_id",
            ["transaction_date", "transaction_id"],
            before={
                "previous_transaction_type": "transaction_type",
                "previous_amount": "amount",
                "_previous_date": "transaction_date",
            },
            after={"next_transaction_type": "transaction_type"},
            hot_rows=hot_rows,
            slice_rows=slice_rows,
        )
        .withColumn(
            "days_since_last_transaction", days_between(F.col("_previous_date"), F.col("transaction_date"))
        )
        .drop("_previous_date")
    )


def fin_sequences(
    tables: Tables, min_occurrences: int = 2, hot_rows: int = HOT_ROWS, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Patterns of three transaction types in a row."""
    arrow = F.lit(" → ")
    pattern = F.concat("previous_transaction_type", arrow, "transaction_type", arrow, "next_transaction_type")
    return (
        fin_sequence_rows(tables, hot_rows, slice_rows)
        .filter("previous_transaction_type is not null and next_transaction_type is not null")
        .groupBy(pattern.alias("transaction_sequence"))
        .agg(
            F.count("*").alias("total_occurrences"),
            rounded_mean(F.col("amount")).alias("avg_transaction_amount"),
            rounded_mean(F.col("days_since_last_transaction")).alias("avg_days_between"),
        )
        .filter(F.col("total_occurrences") >= min_occurrences)
        .orderBy(F.desc("total_occurrences"), "transaction_sequence")
    )


def fin_fraud_deep_dive(tables: Tables) -> DataFrame:
    """Groups of like transactions that hold at least one fraud case."""
    by = ["transaction_hour", "transaction_day", "transaction_type", "merchant_category", "device_type", "location_city"]
    amount = F.col("amount")
    return (
        _completed(tables)
        .withColumns(
            {
                "transaction_hour": F.hour("transaction_date"),
                "transaction_day": F.date_format("transaction_date", "EEEE"),
            }
        )
        .groupBy(*by)
        .agg(
            F.count("*").alias("total_transactions"),
            count_where(_is_fraud()).alias("fraud_cases"),
            _share(_is_fraud(), 4).alias("fraud_rate_percent"),
            rounded_mean(F.when(_is_fraud(), amount)).alias("avg_fraud_amount"),
            rounded_mean(F.when(F.col("is_fraudulent") == 0, amount)).alias("avg_legit_amount"),
        )
        .filter("fraud_cases > 0")
        .orderBy(F.desc("fraud_rate_percent"), *by)
    )


def fin_customer_summary(tables: Tables) -> DataFrame:
    """Income brackets over customers with completed transactions or with none at all.

    A customer counts once per distinct checking balance, and each further account
    with the same balance repeats the transactions.
    """
    counted = F.coalesce(F.col("transaction_status") == "completed", F.lit(False)) | F.col("transaction_id").isNull()
    activity = (
        tables["financial_transactions"]
        .groupBy("customer_id")
        .agg(
            F.count_if(counted).alias("_rows"),
            F.count(F.when(counted, F.col("transaction_id"))).alias("_transactions"),
            F.sum(F.when(counted, F.col("amount"))).alias("_spent"),
            F.count_if(counted & _is_fraud()).alias("_fraud"),
        )
    )
    balances = (
        tables["accounts"]
        .filter("account_type = 'checking'")
        .groupBy("customer_id", "balance")
        .agg(F.count("*").alias("_accounts"))
    )
    copies = F.coalesce("_accounts", F.lit(1))
    summary = (
        tables["customers"]
        .select("customer_id", "income_bracket", "credit_score")
        .join(activity, "customer_id", "left")
        .filter("_rows is null or _rows > 0")
        .join(balances, "customer_id", "left")
        .select(
            "income_bracket",
            "credit_score",
            "balance",
            (F.coalesce("_transactions", F.lit(0)) * copies).alias("total_transactions"),
            (F.col("_spent") * copies).alias("total_spent"),
            (F.coalesce("_fraud", F.lit(0)) * copies).alias("fraud_attempts"),
        )
    )
    return (
        summary.groupBy("income_bracket")
        .agg(
            F.count("*").alias("customer_count"),
            rounded_mean(F.col("total_spent")).alias("avg_total_spent"),
            rounded_mean(F.col("credit_score")).alias("avg_credit_score"),
            rounded_mean(F.col("balance")).alias("avg_balance"),
            rounded_mean(F.col("total_transactions")).alias("avg_transactions"),
            percent(F.sum("fraud_attempts"), F.sum("total_transactions"), 4).alias("overall_fraud_rate"),
        )
        .orderBy(F.desc("avg_total_spent"), "income_bracket")
    )


def fin_kpis(tables: Tables, as_of_from: dt.date) -> DataFrame:
    """One row of key figures from a start date on."""
    return (
        in_period(tables["financial_transactions"], "transaction_date", as_of_from)
        .agg(
            F.count("*").alias("total_transactions"),
            F.sum("amount").alias("total_volume"),
            F.countDistinct("customer_id").alias("active_customers"),
            rounded_mean(F.col("amount")).alias("avg_transaction_size"),
            count_where(_is_fraud()).alias("fraud_cases"),
            _share(_is_fraud(), 4).alias("fraud_rate"),
            _share(F.col("transaction_status") == "completed", 2).alias("success_rate"),
            _share(F.col("device_type") == "mobile", 2).alias("mobile_rate"),
        )
    )


def fin_customer_analytics(tables: Tables, view: str | None = None) -> DataFrame:
    """Customers with completed transactions; optionally registered as a view."""
    activity = (
        _completed(tables)
        .groupBy("customer_id")
        .agg(
            F.count("transaction_id").alias("transaction_count"),
            F.sum("amount").alias("total_spent"),
            mean(F.col("amount")).alias("avg_transaction_value"),
            F.max("transaction_date").alias("last_transaction_date"),
            F.countDistinct("merchant_category").alias("diversity_score"),
        )
    )
    result = tables["customers"].select(*CUSTOMER, "credit_score").join(activity, "customer_id")
    return as_view(result, view)


def fin_fraud_monitoring(tables: Tables, view: str | None = None) -> DataFrame:
    """Fraudulent transactions of any status with a value band."""
    bands = [(1000, "High Value"), (100, "Medium Value")]
    result = (
        tables["financial_transactions"]
        .filter(_is_fraud())
        .select(
            "transaction_date",
            "customer_id",
            "amount",
            "merchant_category",
            "device_type",
            "location_city",
            above(F.col("amount"), bands, "Low Value").alias("value_category"),
        )
    )
    return as_view(result, view)


def fin_exec_summary(tables: Tables) -> DataFrame:
    """Six labelled figures from one pass over each table."""
    names = ["metric", "value"]
    customers = metrics_to_rows(
        tables["customers"].agg(F.count("*").cast("double").alias("n")), [("Total Customers", [F.col("n")])], names
    )
    totals = _completed(tables).agg(
        F.count("*").cast("double").alias("n"),
        round_to(F.sum("amount"), 2).alias("volume"),
        rounded_mean(F.col("amount")).alias("average"),
        _share(_is_fraud(), 4).alias("fraud"),
        _share(F.col("device_type") == "mobile", 2).alias("mobile"),
    )
    return customers.unionByName(
        metrics_to_rows(
            totals,
            [
                ("Total Transactions", [F.col("n")]),
                ("Total Volume ($)", [F.col("volume")]),
                ("Average Transaction ($)", [F.col("average")]),
                ("Fraud Rate (%)", [F.col("fraud")]),
                ("Mobile Usage (%)", [F.col("mobile")]),
            ],
            names,
        )
    )
