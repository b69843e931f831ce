"""The folder that driver and executors share, and tables cut off from their lineage in it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see; where a local session (tests) names none, one under the warehouse."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
    return (found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared").rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)  # holds for what exists
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there, and lost executors cost no rework."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.mode("append").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of `materialize` before the application ends; nothing that reads it may be read any more."""
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch)
    fs = where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    fs.delete(where, True)
    fs.cancelDeleteOnExit(where)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written within gives its shuffles' files back when it is written, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)
