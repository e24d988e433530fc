"""Tables that are written once on the way and read back, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a local session takes a temporary folder and any other one a folder
    in the warehouse, and keeps to it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.startswith("local["):
            found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        else:
            found = f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Whether a query's shuffles are removed with its end; else they stay until the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves none of its shuffles on the executors' disks."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def settle(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: later work starts from the files, so a lost
    executor costs only its own tasks, and the shuffles behind them go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    with released(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def pinned(df: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """(df computed once, whether it has at most `most` rows): a local table of that many, or else a settled one."""
    few = df.limit(most + 1).toArrow()
    if few.num_rows <= most:
        return df.sparkSession.createDataFrame(few, df.schema), True
    return settle(df), False


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Removes settled tables that nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, df._settled)
