"""Exact quantiles, ranks and robust scales of columns of any length.

``percentile`` keeps one value->count map per group in one task, and a global ``percentile_approx`` merges
one sketch per input task in a single reducer. Neither holds for a column of 10^12 rows. Here wanted ranks are
located in two scans: a fine histogram on a logarithmic scale, then the counts of the distinct values inside the
few bars that hold a wanted rank. Both pre-aggregate before their shuffle, and what a single task ever sees is the
bars of one histogram or the distinct values of one bar, whose ends differ by a sixth of a thousandth. The result is
exact, for any distribution and any ties, and the path is the same for any length.

Ranks of all rows come from a range partition: rows are dealt by their order, ties by the columns that break
them, and a row's rank is its place in its range and the rows of its group in the ranges before.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from variscope.functions.values import quoted
from variscope.session import shared_table

BARS_PER_OCTAVE = 4096


def _bar(v: Column) -> Column:
    """A monotone bar number: logarithmic in |v|, so it needs no knowledge of the range."""
    return (
        F.signum(v) * F.floor(F.log2(F.abs(v) * 1024 + 1) * BARS_PER_OCTAVE)
    ).cast("bigint")


def _bars_with_ranks(bars: DataFrame, group: list[str], order: str, offset: Column) -> DataFrame:
    """Keep the bars that hold at least one wanted rank, with the rows that lie before each."""
    running = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        bars.withColumn("_end", offset + F.sum("_count").over(running))
        .withColumn("_before", F.col("_end") - F.col("_count"))
        .withColumn(
            "_ranks",
            F.filter("_ranks", lambda r: (r > F.col("_before")) & (r <= F.col("_end"))),
        )
        .filter(F.size("_ranks") > 0)
        .drop("_end", "_count")
    )


def exact_quantiles(
    df: DataFrame, value: Column | str, probabilities: Sequence[float], by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """One row per group: ``by`` columns, ``n`` and ``q``, the array of interpolated quantiles.

    ``by`` must name few groups (none, or the columns of a profile): the bars that hold the wanted
    ranks, at most two per probability and group, are broadcast to the second scan. ``weight`` is a
    column that says how often a value occurs. Nulls and NaN have no rank; a group without values has no row.
    """
    by = list(by)
    value = F.col(value) if isinstance(value, str) else value
    times = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    numbers = df.select(*by, value.cast("double").alias("_v"), times.alias("_w")).filter(
        F.col("_v").isNotNull() & ~F.isnan("_v")
    )
    base = (
        numbers
        .withColumn("_v", F.col("_v") + F.lit(0.0))
        .withColumn("_b1", _bar(F.col("_v")))
        .withColumn("_g", F.lit(0))
    )
    group = ["_g", *by]

    bars = base.groupBy(*group, "_b1").agg(F.sum("_w").alias("_count"))
    positions = [
        (F.col("_n") - 1) * F.lit(float(p)) for p in probabilities
    ]
    ranks = F.array_distinct(
        F.flatten(
            F.array(
                *[
                    F.array(F.floor(h).cast("bigint") + 1, F.ceil(h).cast("bigint") + 1)
                    for h in positions
                ]
            )
        )
    )
    whole = W.partitionBy(*group)
    bars = bars.withColumn("_n", F.sum("_count").over(whole)).withColumn("_ranks", ranks)
    wanted = _bars_with_ranks(bars, group, "_b1", F.lit(0))
    inside = base.join(F.broadcast(wanted), [*group, "_b1"])
    distinct = inside.groupBy(*group, "_b1", "_before", "_n", "_ranks", "_v").agg(F.sum("_w").alias("_count"))
    picked = _bars_with_ranks(distinct.withColumnRenamed("_before", "_below"), [*group, "_b1"], "_v", F.col("_below"))
    by_rank = (
        picked.select(*group, "_n", "_v", F.explode("_ranks").alias("_rank"))
        .groupBy(*group)
        .agg(
            F.max("_n").alias("_n"),
            F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"),
        )
    )

    def interpolated(h: Column) -> Column:
        low = F.try_element_at("_at", F.floor(h).cast("bigint") + 1)
        high = F.try_element_at("_at", F.ceil(h).cast("bigint") + 1)
        return low + (high - low) * (h - F.floor(h))

    return by_rank.select(
        *by, F.col("_n").alias("n"), F.array(*[interpolated(h) for h in positions]).alias("q")
    )


def ordered_ranges(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The rows dealt to ranges of an order, each range sorted by itself, with their places ``_at``: the range in
    the upper bits, the row's number in it in the lower 33. Stored, as the ranges are cut by a sample."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return shared_table(dealt.withColumn("_at", F.monotonically_increasing_id()), "ordered")


def rank_within(
    df: DataFrame, by: Sequence[str], key: Column, ties: Sequence[str], name: str
) -> DataFrame:
    """Row number inside ``by``, largest ``key`` first, then by ``ties``.

    Rows of one group, and rows of equal keys too, are spread over ranges of the whole order; only the sizes
    of each group in each range are added up.
    """
    by = list(by)
    placed = ordered_ranges(df.withColumn("_key", key.cast("double")), [*[F.col(quoted(c)) for c in by], F.desc_nulls_last("_key"), *[F.col(quoted(c)) for c in ties]])
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    # One row for each group and range that meet: as many as there are groups and ranges.
    sizes = placed.groupBy(*[quoted(c) for c in by], "_range").agg(F.count("*").alias("_count"), F.min("_at").alias("_first"))
    before = W.partitionBy(*[quoted(c) for c in by]).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("_above", F.coalesce(F.sum("_count").over(before), F.lit(0))).drop("_count")
    sizes = sizes.select(F.col("_range").alias("_r"), "_first", "_above", *[F.col(quoted(c)).alias(f"_by{i}") for i, c in enumerate(by)])
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        same = same & F.col(quoted(c)).eqNullSafe(F.col(f"_by{i}"))
    rank = F.col("_above") + F.col("_at") - F.col("_first") + 1
    return placed.join(sizes, same).select(*[F.col(quoted(c)) for c in df.columns], rank.cast("bigint").alias(name))


def median_value(df: DataFrame, value: Column | str) -> float | None:
    """The exact median as one number on the driver, None for an empty column."""
    row = exact_quantiles(df, value, [0.5]).first()
    return None if row is None else row["q"][0]


def robust_scale(df: DataFrame, value: Column | str, minimum_one: bool = True) -> Row:
    """``Row(center, mad, std, scale, n)`` of a column: 1.4826 x MAD, else the population deviation.

    ``minimum_one`` is the investigation rule (a scale of 0 becomes 1); without it the time-series
    rule holds (0 below two values).
    """
    value = F.col(value) if isinstance(value, str) else value
    narrow = df.select(value.cast("double").alias("v"))
    center = median_value(narrow, "v")
    if center is None:
        return Row(center=0.0, mad=0.0, std=0.0, scale=1.0 if minimum_one else 0.0, n=0)
    deviation = F.abs(F.col("v") - F.lit(center))
    spread = exact_quantiles(narrow, deviation, [0.5]).first()
    mad, n = spread["q"][0], spread["n"]
    std = 0.0
    if mad == 0 and n > 1:
        std = narrow.agg(F.stddev_pop("v")).first()[0]
    scale = mad * 1.4826 or std or (1.0 if minimum_one else 0.0)
    if n < 2 and not minimum_one:
        scale = 0.0
    if math.isnan(scale):
        scale = 1.0
    return Row(center=center, mad=mad, std=std, scale=scale, n=n)
