"""Cleaning of patient-style records.

Table: patient_records. The column steps need no shuffle and no state, so they
work on a streaming DataFrame as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from ..functions.dates import full_date
from ..functions.labels import tidy_gender
from ..operators.keys import drop_repeated_keys, latest_per_key
from ..sources.changes import StoredTable, delete_keys, update_where

Tables = dict[str, DataFrame]

PERSON = ["patient_id", "first_name", "last_name", "date_of_birth"]
NO_PHONE = "Not Provided"


def _records(tables: Tables) -> DataFrame:
    return tables["patient_records"]


def _phone_missing() -> Column:
    return F.col("phone_number").isNull() | (F.col("phone_number") == "")


def _address_part(which: str) -> Column:
    if which == "street":
        return F.substring_index("patient_address", ",", 1)
    if which == "state":
        return F.substring_index("patient_address", ",", -1)
    return F.substring_index(F.substring_index("patient_address", ",", 2), ",", -1)


def standardize_admission(df: DataFrame) -> DataFrame:
    """Text to date; text that is no full date becomes null."""
    return df.withColumn("admission_date", full_date(F.col("admission_date")))


def standardize_gender(df: DataFrame) -> DataFrame:
    return df.withColumn("gender", tidy_gender(F.col("gender")))


def split_address(df: DataFrame) -> DataFrame:
    """Trimmed street, city and state; without a comma each is the whole text."""
    return df.withColumns({part: F.trim(_address_part(part)) for part in ("street", "city", "state")})


def fill_phone(df: DataFrame) -> DataFrame:
    return df.withColumn("phone_number", F.when(_phone_missing(), NO_PHONE).otherwise(F.col("phone_number")))


def _admitted(df: DataFrame) -> Column:
    """The admission as a date, whether it is one already or still a text."""
    admission = F.col("admission_date")
    return full_date(admission) if df.schema["admission_date"].dataType == StringType() else admission


def newest_record(df: DataFrame) -> DataFrame:
    """One row per person: the newest admission, rows without a date last."""
    newest = [_admitted(df).desc_nulls_last(), F.asc("record_id")]
    return latest_per_key(df, PERSON, newest)


def patient_preview(tables: Tables) -> DataFrame:
    return _records(tables)


def patient_admission_date(tables: Tables) -> DataFrame:
    return _records(tables).select(
        "record_id", "admission_date", full_date(F.col("admission_date")).alias("standardized_date")
    )


def rejected_admissions(tables: Tables) -> DataFrame:
    """How many admission texts are present but are no full date."""
    text = F.col("admission_date")
    return _records(tables).agg(F.count_if(text.isNotNull() & full_date(text).isNull()).alias("rejected"))


def patient_gender_counts(tables: Tables) -> DataFrame:
    return _records(tables).groupBy("gender").agg(F.count("*").alias("records"))


def patient_gender_std(tables: Tables) -> DataFrame:
    return standardize_gender(_records(tables))


def patient_address_parts(tables: Tables) -> DataFrame:
    return _records(tables).select(
        "patient_address", *[_address_part(part).alias(part) for part in ("street", "city", "state")]
    )


def patient_address_split(tables: Tables) -> DataFrame:
    return split_address(_records(tables))


def patient_missing_phone(tables: Tables) -> DataFrame:
    return _records(tables).filter(_phone_missing()).select("patient_id", "phone_number")


def patient_phone_fill(tables: Tables) -> DataFrame:
    return fill_phone(_records(tables))


def patient_dedupe(tables: Tables) -> DataFrame:
    """Remove all copies of a repeated person, the newest included."""
    return drop_repeated_keys(_records(tables), PERSON)


def patient_dedupe_fixed(tables: Tables) -> DataFrame:
    """Keep the newest copy of each person."""
    return newest_record(_records(tables))


def patient_clean(tables: Tables) -> DataFrame:
    """All steps in one pass: the columns first, then one shuffle to drop copies."""
    columns = fill_phone(split_address(standardize_gender(standardize_admission(_records(tables)))))
    return newest_record(columns)


def store_records(tables: Tables, path: str) -> StoredTable:
    """The records as a table stored by month of admission, as yet uncleaned."""
    month = F.trunc(_admitted(_records(tables)), "MM")
    return StoredTable.create(_records(tables).withColumn("admission_month", month), path, "admission_month")


def clean_stored(spark: SparkSession, table: StoredTable) -> DataFrame:
    """Clean a stored table in place, writing only months that hold a changed row; its rows with the added columns.

    Genders and phones are updates, older copies of a person are deleted; the
    date and the parts of the address are columns that readers add.
    """
    gender = tidy_gender(F.col("gender"))
    update_where(spark, table, ~gender.eqNullSafe(F.col("gender")), {"gender": gender})
    update_where(spark, table, _phone_missing(), {"phone_number": F.lit(NO_PHONE)})
    stored = table.read(spark)
    older = stored.select("record_id").join(newest_record(stored).select("record_id"), "record_id", "left_anti")
    delete_keys(spark, table, older)
    return split_address(standardize_admission(table.read(spark))).drop(table.partition)
