"""UPDATE and DELETE on stored, partitioned tables: only partitions that hold a changed row are written again."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.keys import matches
from ..operators.staging import stage
from .published import remove


@dataclass(frozen=True)
class StoredTable:
    """Parquet files in a folder for each value of one column; `schema` holds that column, too."""

    path: str
    schema: StructType
    partition: str

    @classmethod
    def create(cls, df: DataFrame, path: str, partition: str) -> StoredTable:
        df.write.partitionBy(partition).parquet(path)
        kept = [f for f in df.schema if f.name != partition]
        return cls(path, StructType([*kept, df.schema[partition]]), partition)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path)


def _touched(rows: DataFrame, table: StoredTable) -> dict:
    """Partitions that hold these rows, and their folders: as many values as there are partitions at most."""
    folder = F.regexp_replace("_metadata.file_path", "/[^/]*$", "")
    found = rows.select(F.col(table.partition).alias("value"), folder.alias("folder")).distinct().collect()
    return {r.value: r.folder for r in found}


def _within(table: StoredTable, values: Sequence) -> Column:
    column = F.col(table.partition)
    known = column.isin([v for v in values if v is not None])
    return known | column.isNull() if None in values else F.coalesce(known, F.lit(False))


def _rewrite(spark: SparkSession, table: StoredTable, touched: Mapping, rows: DataFrame) -> list:
    """Replace the touched partitions by these rows, which are staged first as they come from the same files."""
    staged = stage(rows, "changed")
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(table.partition).parquet(table.path)
    left = {r[0] for r in staged.select(table.partition).distinct().collect()}
    for value, folder in touched.items():
        if value not in left:  # no row was written there, so its files would stay
            remove(spark, folder)
    return sorted(touched, key=repr)


def update_where(spark: SparkSession, table: StoredTable, condition: Column, assignments: Mapping[str, Column]) -> list:
    """Set columns of the rows that meet the condition; returns the partitions that were written again.

    The files of all other partitions stay as they are, names included. A
    condition that is null isn't met. The partition column can't be set, as rows
    would have to move. The touched partitions are switched when their rows are
    all written; an update that is repeated after a failure has the same result.
    """
    if table.partition in assignments:
        raise ValueError(f"{table.partition} decides where a row is stored")
    met = F.coalesce(condition, F.lit(False))
    stored = table.read(spark)
    touched = _touched(stored.filter(met), table)
    if not touched:
        return []
    values = {c: F.when(met, value).otherwise(F.col(c)).cast(table.schema[c].dataType) for c, value in assignments.items()}
    return _rewrite(spark, table, touched, stored.filter(_within(table, list(touched))).withColumns(values))


def delete_keys(spark: SparkSession, table: StoredTable, keys: DataFrame) -> list:
    """Delete the rows whose values in the columns of `keys` occur there, nulls included; returns the partitions written again.

    A partition that is left without rows loses its folder.
    """
    doomed, stored = stage(keys.distinct(), "doomed"), table.read(spark)
    named = stored.select("*", "_metadata")
    touched = _touched(named.join(doomed, matches(named, doomed, doomed.columns), "left_semi"), table)
    if not touched:
        return []
    there = stored.filter(_within(table, list(touched)))
    return _rewrite(spark, table, touched, there.join(doomed, matches(there, doomed, doomed.columns), "left_anti"))
