"""Truncate-and-load of CSV extracts with declared schemas."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.limits import REASONS, Limit, with_reasons
from ..operators.months import month_column, with_month
from ..operators.staging import stage
from . import published
from .schemas import GOLD

REJECT = "_rejected_line"
_UNEVEN = "_uneven"


def read_csv(spark: SparkSession, path: str, schema: StructType, mode: str = "FAILFAST") -> DataFrame:
    """Comma separated, one header line, no quoting; a bad line stops the read."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("quote", "")
        .option("mode", mode)
        .option("columnNameOfCorruptRecord", REJECT)
        .csv(path)
    )


def write_csv(df: DataFrame, path: str) -> None:
    """Write an extract that `read_csv` reads: a header line, no quoting. Null and empty texts are both empty
    fields, which are read as null. A text that holds a comma or a line break has no place in it and is an error."""
    texts = [F.col(f"`{f.name}`") for f in df.schema if isinstance(f.dataType, StringType)]
    unfit = reduce(lambda a, b: a | b, [F.coalesce(c.rlike("[,\\r\\n]"), F.lit(False)) for c in texts], F.lit(False))
    checked = df.filter(F.when(unfit, F.raise_error(F.lit("a text holds a comma or a line break"))).otherwise(F.lit(True)))
    checked.write.option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def rejected_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Lines that do not fit the schema, with the text as it was read.

    They are staged, as Spark does not answer from the rejected text of a CSV
    scan alone.
    """
    wider = StructType([*schema.fields]).add(REJECT, StringType())
    return stage(read_csv(spark, path, wider, "PERMISSIVE").filter(f"{REJECT} is not null"), "rejects")


def checked_lines(
    spark: SparkSession, path: str, schema: StructType, limits: Mapping[str, Limit] | None = None
) -> DataFrame:
    """Every line of an extract as typed columns, with the reasons against it and its text where there are any.

    A line with too few or too many fields has that as its only reason.
    """
    texts = StructType([StructField(f.name, StringType()) for f in schema.fields]).add(REJECT, StringType())
    lines = read_csv(spark, path, texts, "PERMISSIVE")
    rebuilt = F.concat_ws(",", *(F.coalesce(f"`{f.name}`", F.lit("")) for f in schema.fields))
    lines = lines.withColumns({_UNEVEN: F.col(REJECT).isNotNull(), REJECT: F.coalesce(REJECT, rebuilt)})
    checked = with_reasons(lines, schema, limits or {})
    reasons = F.when(F.col(_UNEVEN), F.array(F.lit(f"not {len(schema)} fields"))).otherwise(F.col(REASONS))
    checked = checked.withColumn(REASONS, reasons).drop(_UNEVEN)
    return checked.withColumn(REJECT, F.when(F.size(REASONS) > 0, F.col(REJECT)))


def rejects(spark: SparkSession, path: str, schema: StructType, limits: Mapping[str, Limit] | None = None) -> DataFrame:
    """`rejected_line` and `reasons` of the lines that break the schema or its limits."""
    found = checked_lines(spark, path, schema, limits).filter(F.size(REASONS) > 0)
    return found.select(F.col(REJECT).alias("rejected_line"), F.col(REASONS).alias("reasons"))


class RejectedLines(ValueError):
    """An extract has more bad lines than the load allows."""


def load_tables(
    spark: SparkSession,
    sources: Mapping[str, str],
    target: str,
    schemas: Mapping[str, StructType] = GOLD,
    limits: Mapping[str, Mapping[str, Limit]] | None = None,
    max_rejects: int = 0,
    months: Mapping[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Replace tables under `target` by their CSV extracts, all or none; returns the stored tables.

    Each extract is read once. Lines that break the schema or the `limits` are
    counted on the way and left out; if one extract has more than `max_rejects`
    of them, the load fails, and readers go on to see what was there before (see
    `published`). A table named in `months` is stored by the months of its date
    column, see `operators/months.py`.
    """
    counts = {name: Observation() for name in sources}
    fitting, months = {}, dict(months or {})
    for name, path in sources.items():
        lines = checked_lines(spark, path, schemas[name], (limits or {}).get(name))
        refused = F.count_if(F.size(REASONS) > 0).alias("refused")
        fitting[name] = lines.observe(counts[name], refused).filter(F.size(REASONS) == 0).select(*schemas[name].names)
        if name in months:
            fitting[name] = with_month(fitting[name], months[name])

    def few_rejects(name: str, stored: DataFrame) -> None:
        refused = counts[name].get["refused"]
        if refused > max_rejects:
            shown = rejects(spark, sources[name], schemas[name], (limits or {}).get(name)).first()
            raise RejectedLines(f"{refused} lines of {name} don't fit, more than {max_rejects}; one: {shown.asDict()}")

    parts = {name: [month_column(column)] for name, column in months.items()}
    published.publish(spark, target, fitting, parts, few_rejects)
    return {name: published.open_table(spark, target, name, fitting[name].schema) for name in sources}
