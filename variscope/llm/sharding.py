"""Contiguous shards of equal bytes from global prefix sums.

Rows are dealt into ranges of their order and summed inside each range; the ranges' totals give every range
its base. A row's shard follows from the bytes before it, so shards are contiguous in the order and differ
by less than one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from variscope.llm.scratch import stored

SHARDS = 16


def ranged(rows: DataFrame, order: list[str]) -> DataFrame:
    """A stored copy of ``rows``, dealt by ranges of ``order``, with the number of the range in ``_range``.

    The number is data of the stored rows, so a task that runs again cannot change it.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def shards(rows: DataFrame, order: list[str], size: str = "size", n_shards: int = SHARDS) -> DataFrame:
    """Add ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each shard).

    ``size`` is a positive long. Rows are put in ``order`` (nulls first); rows equal in it are one run that
    may be cut, and may change places with each other. An empty table stays empty.
    """
    taken = {"shard", "slot"} & set(rows.columns)
    if taken:
        raise ValueError(f"the input has columns that sharding adds: {sorted(taken)}")
    if n_shards < 1:
        raise ValueError("there must be a shard")
    dealt = ranged(rows, order)
    totals = dealt.groupBy("_range").agg(F.sum(size).alias("_bytes"), F.count("*").alias("_rows"))
    # One row a range.
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(
        "_range",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(Window.partitionBy(F.lit(0))).alias("_all"),
    )
    inside = Window.partitionBy("_range").orderBy(*order)
    placed = dealt.withColumn("_start", F.coalesce(F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_row", F.row_number().over(inside) - 1)
    placed = placed.join(base, "_range").withColumn("_row", F.col("_row") + F.col("_rows_before"))
    start = F.col("_start") + F.col("_bytes_before")
    # start x n_shards div total, in two steps so that large totals do not overflow.
    placed = placed.withColumn("shard", F.least(F.floor(start / (F.col("_all") / n_shards)), F.lit(n_shards - 1)).cast("int"))
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # n_shards rows
    out = placed.join(F.broadcast(first), "shard")
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], "shard", (F.col("_row") - F.col("_first")).cast("long").alias("slot"))
