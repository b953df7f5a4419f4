"""Tables that are replaced together: readers see the old ones or all of the new ones.

    <target>/current                      names the version of each table
    <target>/<table>/<version>/...        Parquet files, never changed by a later load

A load writes fresh versions beside the old ones, reads them back, and then
replaces the file `current` by a rename. A load that fails, or an executor or
driver that is lost before that, leaves `current` and all that it names alone;
readers that opened an older version go on with it until it is removed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

POINTER = "current"

#: Raises an error if the stored rows of a table aren't fit to be shown.
Check = Callable[[str, DataFrame], None]


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it wants it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def remove(spark: SparkSession, path: str) -> None:
    files, hadoop = _files(spark, path)
    files.delete(hadoop, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders directly below a folder; none if there is no such folder."""
    files, hadoop = _files(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(hadoop)) if files.exists(hadoop) else []


def versions(spark: SparkSession, target: str) -> dict[str, str]:
    """The version of each table that readers see; empty before the first load."""
    files, pointer = _files(spark, f"{target}/{POINTER}")
    if not files.exists(pointer):
        return {}
    lines = spark.read.text(f"{target}/{POINTER}").collect()  # one short line for each table
    return dict(line.value.rsplit(" ", 1) for line in lines if line.value)


def path_of(spark: SparkSession, target: str, name: str) -> str:
    """The folder of the version that readers see."""
    known = versions(spark, target)
    if name not in known:
        raise LookupError(f"no table {name} has been loaded into {target}")
    return f"{target}/{name}/{known[name]}"


def open_table(spark: SparkSession, target: str, name: str, schema: StructType | None = None) -> DataFrame:
    """The rows that readers see now; later loads don't change them."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path_of(spark, target, name))


def _switch(spark: SparkSession, target: str, known: Mapping[str, str]) -> None:
    """Replace the pointer by a rename, so that no reader finds it half written."""
    fresh = f"{target}/.{POINTER}-{uuid.uuid4().hex}"
    files, path = _files(spark, fresh)
    out = files.create(path)
    out.write(bytearray("".join(f"{name} {version}\n" for name, version in sorted(known.items())), "utf-8"))
    out.close()
    fs = spark._jvm.org.apache.hadoop.fs
    context = fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    overwrite[0] = fs.Options.Rename.OVERWRITE
    context.rename(files.makeQualified(path), files.makeQualified(fs.Path(f"{target}/{POINTER}")), overwrite)


def publish(
    spark: SparkSession,
    target: str,
    tables: Mapping[str, DataFrame],
    partitions: Mapping[str, Sequence[str]] | None = None,
    check: Check | None = None,
) -> dict[str, str]:
    """Replace tables under `target`, all of them or none; returns the versions that readers see.

    Each table is written once, by its `partitions` if it has any, and its stored
    rows are counted against those that were written. `check` sees every stored
    table before any is shown. Where anything fails, the fresh versions are
    removed and the error goes on. Tables that aren't named stay as they are.
    Of two loads at the same time, the one that switches last decides for its
    tables.
    """
    fresh: dict[str, str] = {}
    try:
        for name, df in tables.items():
            fresh[name] = uuid.uuid4().hex
            path, seen = f"{target}/{name}/{fresh[name]}", Observation()
            df.observe(seen, F.count(F.lit(1)).alias("rows")).write.partitionBy(*(partitions or {}).get(name, ())).parquet(path)
            stored = spark.read.schema(df.schema).parquet(path)
            found = stored.count()
            if found != seen.get["rows"]:
                raise OSError(f"{found} rows of {name} were stored, {seen.get['rows']} were written")
            if check is not None:
                check(name, stored)
        known = versions(spark, target) | fresh
        _switch(spark, target, known)
        return known
    except BaseException:
        for name, version in fresh.items():
            remove(spark, f"{target}/{name}/{version}")
        raise


def remove_old(spark: SparkSession, target: str) -> list[str]:
    """Remove the versions that no reader can open any more; returns their folders.

    To be called when no load is running and no query reads an older version.
    """
    known, gone = versions(spark, target), []
    for name in known:
        for version in names_in(spark, f"{target}/{name}"):
            if version != known[name]:
                gone.append(f"{target}/{name}/{version}")
                remove(spark, gone[-1])
    return gone
