from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from variscope.functions.quantiles import exact_quantiles, ordered_ranges, rank_within, robust_scale
from variscope.functions.values import array_percentile, array_robust_scale

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def columns():
    rng = random.Random(11)
    return {
        "one": [5.0],
        "ties": [2.0] * 40 + [3.0] * 41,
        "normal": [rng.gauss(0, 1) for _ in range(501)],
        "money": [round(rng.uniform(-5e4, 9e5), 2) for _ in range(800)],
        "offset": [1e6 + rng.random() * 1e-3 for _ in range(300)],
        "outlier": [rng.random() for _ in range(200)] + [1e15, -1e15],
        "zeros": [0.0, -0.0, 0.0, 1e-9, -1e-9],
    }


@pytest.mark.parametrize("name", list(columns()))
def test_exact_quantiles(spark, name):
    values = columns()[name]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(5)
    row = exact_quantiles(df, "v", PROBS).first()
    assert row["n"] == len(values)
    assert row["q"] == pytest.approx(list(np.quantile(values, PROBS)), rel=1e-12, abs=1e-12)


def test_grouped_and_weighted_quantiles(spark):
    rows = [("a", float(i % 7), i % 3 + 1) for i in range(50)] + [("b", float(i), 2) for i in range(9)]
    df = spark.createDataFrame(rows, "g string, v double, w bigint")
    got = {r["g"]: r["q"] for r in exact_quantiles(df, "v", [0.25, 0.5], ["g"], weight="w").collect()}
    for g in "ab":
        spread = [v for k, v, w in rows if k == g for _ in range(w)]
        assert got[g] == pytest.approx(list(np.quantile(spread, [0.25, 0.5])))


def test_robust_scale_rules(spark):
    one = spark.createDataFrame([(3.0,)], "v double")
    assert robust_scale(one, "v").scale == 1.0 and robust_scale(one, "v", minimum_one=False).scale == 0.0
    flat = spark.createDataFrame([(1.0,)] * 9 + [(11.0,)], "v double")
    assert robust_scale(flat, "v").scale == pytest.approx(3.0)  # MAD is 0: the deviation
    line = spark.createDataFrame([(float(i),) for i in range(9)], "v double")
    assert robust_scale(line, "v").scale == pytest.approx(2 * 1.4826)
    empty = line.filter("v < 0")
    assert robust_scale(empty, "v").scale == 1.0


def test_array_helpers(spark):
    df = spark.createDataFrame([([4.0, 1.0, 3.0, 2.0],), ([],), ([7.0],), ([2.0, 2.0, 2.0, 9.0],)], "a array<double>")
    got = df.select(array_percentile(F.col("a"), 0.5).alias("m"), array_robust_scale(F.col("a")).alias("s")).collect()
    assert [r["m"] for r in got] == [2.5, None, 7.0, 2.0]
    assert [r["s"] for r in got] == pytest.approx([1.4826, 0.0, 0.0, float(np.std([2, 2, 2, 9]))])


def test_rank_within_matches_a_sort(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), round(abs(rng.gauss(0, 50)), 1), f"n{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "g string, size double, name string").repartition(7)
    got = {r["name"]: r["rank"] for r in rank_within(df, ["g"], F.col("size"), ["name"], "rank").collect()}
    for g in "ab":
        ordered = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in ordered] == list(range(1, len(ordered) + 1))


def test_equal_keys_are_spread_over_all_ranges(spark):
    df = spark.range(100_000).select(F.lit("d").alias("g"), F.lit(5.0).alias("size"), F.col("id").alias("name"))
    ranked = rank_within(df, ["g"], F.col("size"), ["name"], "rank")
    assert ranked.filter("rank <> name + 1").count() == 0 and ranked.count() == 100_000
    placed = ordered_ranges(df, [F.col("g"), F.desc("size"), F.col("name")])
    sizes = [r["n"] for r in placed.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 2 * 100_000 / len(sizes)


def test_ranks_of_null_groups_and_keys(spark):
    rows = [(None, 1.0, "a"), (None, None, "b"), ("x", 2.0, "c"), ("x", None, None), (None, 1.0, "z")]
    df = spark.createDataFrame(rows, "`g.h` string, size double, name string")
    got = {(r["g.h"], r["name"]): r["rank"] for r in rank_within(df, ["g.h"], F.col("size"), ["name"], "rank").collect()}
    assert got == {(None, "a"): 1, (None, "z"): 2, (None, "b"): 3, ("x", "c"): 1, ("x", None): 2}
    assert rank_within(df.limit(0), ["g.h"], F.col("size"), ["name"], "rank").count() == 0
