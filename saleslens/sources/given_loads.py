"""Loads of the given tables: extracts, damaged extracts, and jobs over tables that were stored first."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.key_buckets import store_by_key
from ..operators.months import month_column, with_month
from ..operators.staging import new_path
from ..plans import cleaning
from . import csv_tables, given_tables as given, published, schemas

Query = Callable[[SparkSession, str], DataFrame]

#: The key by which lines of an extract are damaged, a text and a number of it.
KEYS = {"dim_products": "product_key", "dim_customers": "customer_key", "fact_sales": "product_key"}
TEXTS = {"dim_products": "product_name", "dim_customers": "customer_number", "fact_sales": "order_number"}
NUMBERS = {"dim_products": "cost", "dim_customers": "customer_id", "fact_sales": "quantity"}


def _write(spark: SparkSession, folder: str, damage: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> dict[str, str]:
    """The star as CSV extracts; their paths."""
    paths = {}
    for name, df in given.GivenTables(spark, folder, given.WAREHOUSE).items():
        paths[name] = new_path(spark, f"extract-{name}")
        csv_tables.write_csv(damage(name, df), paths[name])
    return paths


def _words_for_numbers(name: str, df: DataFrame) -> DataFrame:
    """Every thirteenth key has a word for a number."""
    number = NUMBERS[name]
    return df.withColumn(number, F.when(F.col(KEYS[name]) % 13 == 0, "n/a").otherwise(F.col(number).cast("string")))


def _beyond_limits(name: str, df: DataFrame) -> DataFrame:
    """As before, and some texts are too long, some quantities above or below their range."""
    key, text = F.col(KEYS[name]), TEXTS[name]
    df = _words_for_numbers(name, df).withColumn(text, F.when(key % 17 == 0, F.rpad(text, 51, "x")).otherwise(F.col(text)))
    if name != "fact_sales":
        return df
    spoiled = F.when(key % 13 == 0, F.col("quantity")).when(key % 19 == 0, "300").when(key % 23 == 0, "-1")
    return df.withColumn("quantity", spoiled.otherwise(F.col("quantity")))


def column_checks(name: str, df: DataFrame) -> DataFrame:
    """For each column of a stored table: its filled fields, its distinct values, the least and the greatest.

    Each column is read and grouped by itself, so a row is shuffled as one value
    at a time, and equal values of a map task once; counts of all columns in one
    aggregate would write every row anew for each of them.
    """

    def figures(column: str) -> DataFrame:
        value = F.col("value")
        values = df.select(F.col(f"`{column}`").alias("value")).groupBy("value").agg(F.count("*").alias("n"))
        return values.agg(
            F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("row_count"),
            F.coalesce(F.sum(F.when(value.isNotNull(), F.col("n"))), F.lit(0).cast("long")).alias("filled"),
            F.count(value).alias("different"),
            F.min(value).cast("string").alias("least"),
            F.max(value).cast("string").alias("greatest"),
        ).select(F.lit(name).alias("table_name"), F.lit(column).alias("column_name"), "*")

    return reduce(DataFrame.unionByName, map(figures, df.columns))


def _checks(stored: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (column_checks(name, df) for name, df in stored.items()))


def load_gold(spark: SparkSession, folder: str) -> DataFrame:
    """Write the star as CSV extracts, load them, and sum up what was stored."""
    return _checks(csv_tables.load_tables(spark, _write(spark, folder), new_path(spark, "gold"), limits=schemas.GOLD_LIMITS))


def load_gold_keeps_old(spark: SparkSession, folder: str) -> DataFrame:
    """What readers find after good extracts were loaded and a load of damaged ones failed."""
    target = new_path(spark, "gold")
    csv_tables.load_tables(spark, _write(spark, folder), target, limits=schemas.GOLD_LIMITS)
    try:
        csv_tables.load_tables(spark, _write(spark, folder, _beyond_limits), target, limits=schemas.GOLD_LIMITS)
    except csv_tables.RejectedLines:
        return _checks({name: published.open_table(spark, target, name, schema) for name, schema in schemas.GOLD.items()})
    raise AssertionError("damaged extracts were loaded")


def load_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of damaged extracts that do not fit their schemas."""
    found = []
    for name, path in _write(spark, folder, _words_for_numbers).items():
        lines = csv_tables.rejected_lines(spark, path, schemas.GOLD[name])
        found.append(lines.select(F.lit(name).alias("table_name"), F.col(csv_tables.REJECT).alias("rejected_line")))
    return reduce(DataFrame.unionByName, found)


def load_reject_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of damaged extracts that break the schema or a declared limit, with all reasons."""
    found = []
    for name, path in _write(spark, folder, _beyond_limits).items():
        lines = csv_tables.rejects(spark, path, schemas.GOLD[name], schemas.GOLD_LIMITS[name])
        reasons: Column = F.array_join("reasons", "; ").alias("reasons")
        found.append(lines.select(F.lit(name).alias("table_name"), "rejected_line", reasons))
    return reduce(DataFrame.unionByName, found)


def stored_by_month(job: Callable[..., DataFrame], date: str, shown: Callable[[DataFrame], DataFrame], **parameters) -> Query:
    """A job over tables of which the one with this date column was stored by its months."""
    group, dated = {
        "order_date": (given.WAREHOUSE, "fact_sales"),
        "transaction_date": (given.FINANCE, "financial_transactions"),
    }[date]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        tables, target = given.GivenTables(spark, folder, group), new_path(spark, "monthly")
        by_month = with_month(tables[dated], date)
        published.publish(spark, target, {dated: by_month}, {dated: [month_column(date)]})
        tables[dated] = published.open_table(spark, target, dated, by_month.schema)
        return shown(job(tables, **parameters))

    return run


def patients_cleaned_in_place(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of a stored table after its updates and deletes."""
    table = cleaning.store_records(given.GivenTables(spark, folder, given.CLEANING), new_path(spark, "patients"))
    return cleaning.clean_stored(spark, table)


def report_by_key(job: Callable[..., DataFrame], key: str, columns: list[str], shown: Callable[[DataFrame], DataFrame], **parameters) -> Query:
    """A report over facts that were stored in buckets of its key."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        tables, path = given.GivenTables(spark, folder, given.WAREHOUSE), new_path(spark, f"by-{key}")
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        name = "facts_" + path.rsplit("-", 1)[1]
        tables[f"fact_sales_by_{key}"] = store_by_key(tables["fact_sales"], key, name, path, buckets, columns)
        return shown(job(tables, **parameters))

    return run
