"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from variscope.session import shared_folder


def stored(df: DataFrame, purpose: str, partition_by: str | None = None) -> DataFrame:
    """Write a frame below ``spark.checkpoint.dir`` and read it back.

    It cuts the lineage with one run of the plan (``checkpoint()`` runs it twice) and survives a lost
    executor. The files go when the application ends.
    """
    spark: SparkSession = df.sparkSession
    path = shared_folder(spark, purpose)
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def running_total(df: DataFrame, group: list[str], chunk: str, order: list[Column], value: Column, start: str, number: str | None = None) -> DataFrame:
    """Add ``start``: the sum of ``value`` over the rows before, in the order (chunk, order), of each group.

    Chunks are ranges of the order. Rows are only summed inside their chunk; the chunks' totals are summed
    apart, one row a chunk, so no task holds a whole group. ``number`` names an added column with the place
    of the row in its chunk, from 1. Groups and chunks must not be null.
    """
    keys = [*group, chunk]
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    over = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = over.orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn(start, F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if number:
        rows = rows.withColumn(number, F.row_number().over(inside))
    return rows.join(totals, keys).withColumn(start, (F.col(start) + F.col("_base")).cast("long")).drop("_base")
