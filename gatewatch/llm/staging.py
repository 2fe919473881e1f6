"""Tables written to the shared folder, which cut lineage and outlive lost executors."""

from __future__ import annotations

import os
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatewatch.session import scratch_dir


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under ``spark.checkpoint.dir`` and read back."""
    path = scratch_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """``df`` written once in buckets of ``key``, as a table in the shared folder: grouping it by the key moves no row of it again."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    known = f"{name}_{os.path.basename(path)[-32:]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").saveAsTable(known)
    return spark.table(known)


def discard(*tables: DataFrame) -> None:
    """Removes tables made by ``staged`` or ``bucketed`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            spark.sql(f"DROP TABLE IF EXISTS {os.path.basename(folder).replace('-', '_')}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Inside, the shuffle files of a query are removed when it ends: for jobs whose every step is written to the shared folder."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """A hint to send a table of a few short columns to all tasks where it has few rows; else both sides of a join are shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def numbered(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``df`` with each row's place from 1 in the given order. Ranges of rows are numbered apart and then moved by the number
    of rows before them, so that no task sorts more than its range.
    """
    ranged = staged(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    inside = ranged.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return inside.join(F.broadcast(before), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")
