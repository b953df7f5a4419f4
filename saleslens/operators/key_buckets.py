"""Facts stored by key, so that aggregates per key read them without a shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .keys import HOT_ROWS, hot_keys, split_hot
from .staging import stage


@dataclass(frozen=True)
class KeyBuckets:
    """A table in buckets of its key, and the rows of hot keys beside it, which one bucket couldn't hold."""

    table: str
    hot: DataFrame | None

    def parts(self, spark: SparkSession) -> list[DataFrame]:
        """The rows, in parts that share no key: the first needs no shuffle by key."""
        plain = spark.table(self.table)
        return [plain] if self.hot is None else [plain, self.hot]


def store_by_key(
    df: DataFrame, key: str, table: str, path: str, buckets: int, columns: Sequence[str] | None = None, hot_rows: int = HOT_ROWS
) -> KeyBuckets:
    """Store `df` (or some columns of it) under `path` as the catalog table `table`, bucketed and sorted by `key`.

    The one shuffle by key happens here, once for all aggregates that follow.
    Keys with more than `hot_rows` rows are kept apart unbucketed, and are
    aggregated with the usual map-side combine. Choose `buckets` so that one
    fits a task (100-200 MB). The table can be registered again in a later
    session by its name, schema and path.
    """
    kept = df.select(key, *(c for c in columns or df.columns if c != key))
    hot = hot_keys(kept, [key], hot_rows)
    plain, apart = (kept, None) if hot is None else split_hot(kept, [key], hot)[::-1]
    writer = plain.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key)
    writer.option("path", path).saveAsTable(table)
    return KeyBuckets(table, None if apart is None else stage(apart, "hot-facts"))
