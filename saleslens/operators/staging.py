"""Intermediate tables in the folder that all executors share.

A staged table cuts the lineage, survives lost executors, has an exact row
count in its footers and gives later steps one fixed version of the rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session, else a folder in its warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return (configured or f"{spark.conf.get('spark.sql.warehouse.dir')}/staged").rstrip("/")


def application_folder(spark: SparkSession) -> str:
    """The folder of this application's staged tables; it goes when the application ends."""
    folder = f"{shared_folder(spark)}/saleslens/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path not used before, below the folder of this application."""
    return f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write the rows as Parquet and return a reader of that table."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
