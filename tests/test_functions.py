import datetime as dt

from pyspark.sql import functions as F

from saleslens.functions.dates import days_between, month_label, months_between_boundaries, years_between_boundaries
from saleslens.functions.labels import above, at_least, first_match, position, tidy_gender
from saleslens.functions.numbers import (
    count_where,
    mean,
    percent,
    ratio,
    round_to,
    rounded_mean,
    whole_mean,
    whole_ratio,
)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def day(text):
    return F.lit(dt.date.fromisoformat(text))


def test_month_span_counts_boundaries(spark):
    def span(start, end):
        return one(spark, months_between_boundaries(day(start), day(end)))

    assert span("2024-01-31", "2024-02-01") == 1
    assert span("2023-12-31", "2024-01-01") == 1
    assert span("2024-02-01", "2024-02-29") == 0
    assert span("2024-03-01", "2023-03-31") == -12


def test_year_span_counts_boundaries(spark):
    assert one(spark, years_between_boundaries(day("2023-12-31"), day("2024-01-01"))) == 1


def test_days_ignore_time_of_day(spark):
    late = F.lit("2024-01-01 23:59:00").cast("timestamp_ntz")
    early = F.lit("2024-01-02 00:01:00").cast("timestamp_ntz")
    assert one(spark, days_between(late, early)) == 1


def test_month_label(spark):
    assert one(spark, month_label(day("2024-02-03"))) == "2024-02"


def test_division_by_zero_is_null(spark):
    assert one(spark, ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, percent(F.lit(1), F.lit(0))) is None
    df = spark.range(1).select(F.lit(5).alias("a"), F.lit(0).alias("b"))
    assert df.select(whole_ratio("a", "b").alias("x")).first().x is None


def test_rounding_is_half_up(spark):
    assert one(spark, round_to(F.lit(1.005), 2)) == 1.01
    assert one(spark, round_to(F.lit(2.675), 2)) == 2.68
    assert one(spark, round_to(F.lit(-1.005), 2)) == -1.01


def test_whole_numbers_cut_toward_zero(spark, frame):
    df = frame([("a", 1), ("a", 2), ("b", -3), ("b", -4), ("c", None)], "k string, v int")
    got = {r.k: r.x for r in df.groupBy("k").agg(whole_mean("v").alias("x")).collect()}
    assert got == {"a": 1, "b": -3, "c": None}


def test_means_skip_nulls(frame):
    df = frame([(1.0,), (None,), (2.0,)], "v double")
    row = df.agg(mean(F.col("v")).alias("m"), rounded_mean(F.col("v"), 1).alias("r")).first()
    assert (row.m, row.r) == (1.5, 1.5)


def test_count_where_is_null_without_rows(frame):
    df = frame([], "v int")
    assert df.agg(count_where(F.col("v") == 1).alias("n")).first().n is None


def test_bands(frame):
    df = frame([(100,), (101,), (1000,), (1001,), (None,)], "v int")
    got = [r.b for r in df.select(above(F.col("v"), [(1000, "high"), (100, "mid")], "low").alias("b")).collect()]
    assert got == ["low", "mid", "mid", "high", "low"]
    got = [r.b for r in df.select(at_least(F.col("v"), [(1000, "high"), (101, "mid")], "low").alias("b")).collect()]
    assert got == ["low", "mid", "high", "high", "low"]


def test_first_match_wins(frame):
    v = F.col("v")
    df = frame([(5,)], "v int")
    assert df.select(first_match([(v > 1, "a"), (v > 2, "b")], "c").alias("x")).first().x == "a"


def test_position_puts_unknown_last(frame):
    df = frame([("x",), ("b",), ("a",)], "v string")
    assert [r.v for r in df.orderBy(position(F.col("v"), ["a", "b"])).collect()] == ["a", "b", "x"]


def test_gender_codes(frame):
    df = frame([("M",), ("MALE",), ("Male",), ("f",), ("Female",), ("x",), ("",), (None,)], "g string")
    got = [r.x for r in df.select(tidy_gender(F.col("g")).alias("x")).collect()]
    assert got == ["Male"] * 3 + ["Female"] * 2 + ["Unknown"] * 3
