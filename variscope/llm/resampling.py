"""Importance resampling of documents towards a target distribution of hashed word n-grams.

Features are counted in ``BUCKETS`` buckets for the corpus and for the target; the logarithm of the two smoothed
shares is a bucket's gain, and gains are an array that each task indexes with its documents' features. A document's
weight is its mean gain, its score adds Gumbel noise drawn from its id, so the highest scores are a sample without
replacement.

The sample needs exact ranks of all scores. They come from parallel sorting by regular sampling: each partition
sorts its own run, every ``STEP``-th row of a run is a regular sample, the sorted samples give splitters, the
segments between splitters are exchanged and merged in their ranges, and the ranges' prefix counts make local places
ranks. Keys are unique down to the row's place in its run, so no tie makes a range large. Samples that are too many
for one sort are ranked in the same way.
"""

from __future__ import annotations

from bisect import bisect_right
from math import log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variscope.llm.scratch import stored
from variscope.llm.words import alnum_words

BUCKETS = 10_000
LONGEST = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
#: Every so many rows of a run give a sample; two at least.
STEP = 64
#: Samples that the driver sorts by itself.
SORTED_AT_ONCE = 1 << 16
#: Rows of a range.
RANGE_ROWS = 1 << 20
#: Features whose buckets a task remembers.
REMEMBERED = 1 << 20
#: A row's place is its run, and its number there in so many bits.
PLACE_BITS = 33


class FeatureBuckets(dict):
    """Buckets of features, computed once for each feature that is remembered."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        bucket = crc32(feature) % self.buckets
        if len(self) < REMEMBERED:
            self[feature] = bucket
        return bucket


def features(words: list[bytes], longest: int) -> list[bytes]:
    """All runs of 1 to ``longest`` consecutive words, joined by one space, repeats included."""
    out = list(words)
    for n in range(2, longest + 1):
        out += map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))
    return out


def utf8(text: Column | str) -> Column:
    return F.encode(F.col(text) if isinstance(text, str) else text, "UTF-8")


def bucket_counts(table: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, text: str = "text") -> np.ndarray:
    """How many features of all whole texts lie in each bucket; tasks send their counts, at most one row a bucket."""

    def count(batches):
        place, total = FeatureBuckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                found = features(alnum_words(t), longest)
                total += np.bincount(np.fromiter(map(place.__getitem__, found), np.int64, len(found)), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    counted = table.select(utf8(text)).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counted.collect():  # at most one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain in thousandths: floor(1000 ln) of its smoothed share of the target over that of the corpus."""
    n, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([np.floor(1000 * log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's key, n_words, n_features and weight, the floored mean gain of its features (0 if it has none)."""
    kind = docs.schema[key].dataType
    counts = ["n_words", "n_features", "weight"]
    schema = T.StructType([T.StructField(key, kind), *[T.StructField(c, T.LongType()) for c in counts]])

    def weigh(batches):
        place = FeatureBuckets(len(gain))
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                words = alnum_words(t)
                found = features(words, longest)
                total = int(gain[np.fromiter(map(place.__getitem__, found), np.int64, len(found))].sum())
                rows.append((len(words), len(found), total // len(found) if found else 0))
            numbers = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers], [key, *counts])

    return docs.select(key, utf8(text).alias("text")).mapInArrow(weigh, schema)


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, drawn from the key (as a string, null as an empty one)."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def sorted_runs(rows: DataFrame, high: str, key: str) -> DataFrame:
    """The rows, each partition sorted by itself, with their places ``_at``; stored, so places stay."""
    runs = rows.sortWithinPartitions(F.desc_nulls_last(high), F.asc_nulls_last(key))
    return stored(runs.withColumn("_at", F.monotonically_increasing_id()), "runs")


def splitters(samples: DataFrame, high: str, key: str, ranges: int) -> list[tuple]:
    """At most ``ranges`` - 1 keys that part the samples, and so the rows, into about equal ranges."""
    n = samples.count()
    each = max(1, -(-n // ranges))
    if n <= SORTED_AT_ONCE:
        found = sorted(sort_key(r[high], r[key], r["_at"]) for r in samples.collect())
        return found[each::each]
    few = samples.coalesce(max(1, n // STEP**2))  # runs long enough that their samples are fewer
    ordered = ranked(few.withColumnRenamed("_at", "_sampled"), high, key)
    chosen = ordered.filter((F.col("rank") > 1) & ((F.col("rank") - 1) % each == 0)).select(high, key, "_sampled").collect()
    return sorted(sort_key(*r) for r in chosen)


def sort_key(high, key, at) -> tuple:
    """Descending by ``high``, then ascending by key, nulls last, then by place."""
    return high is None, 0 if high is None else -high, key is None, 0 if key is None else key, at


def ranked(rows: DataFrame, high: str, key: str, ranges: int | None = None) -> DataFrame:
    """Add ``rank``: 1, 2, 3... by ``high`` descending, then by ``key`` ascending, nulls last. Equal rows take neighbouring ranks."""
    spark = rows.sparkSession
    runs = sorted_runs(rows, high, key)
    if ranges is None:
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS))
    number = F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    bounds = splitters(runs.filter(number % STEP == 0).select(high, key, "_at"), high, key, ranges)

    def segment(batches):
        for batch in batches:
            keys = map(sort_key, *(batch.column(c).to_pylist() for c in (high, key, "_at")))
            yield batch.append_column("_range", pa.array([bisect_right(bounds, k) for k in keys], pa.int32()))

    parts = runs.mapInArrow(segment, T.StructType([*runs.schema.fields, T.StructField("_range", T.IntegerType())]))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    sizes = parts.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(F.desc_nulls_last(high), F.asc_nulls_last(key), "_at"))
    placed = parts.withColumn("_place", place).join(sizes, "_range")
    return placed.withColumn("rank", (F.col("_place") + F.col("_before")).cast("long")).drop("_range", "_place", "_before", "_at")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's key, n_words, n_features, weight, score and ``rank``, which is null for what is not drawn.

    Of the N documents of at least ``min_words`` words, the floor(``percent`` * N / 100) highest scores are drawn;
    ties go to the smaller key. Null and empty texts have no words, weight 0 and are not drawn; rows without a key
    come last in a tie; repeated rows are drawn each by itself. Other columns are left out.
    """
    if not 0 <= percent <= 100:
        raise ValueError("percent must lie between 0 and 100")
    gain = gains(bucket_counts(docs, longest, buckets, text), bucket_counts(target, longest, buckets, text))
    scored = weighted(docs, gain, longest, key, text).withColumn("score", F.col("weight") + noise(F.col(key), seed))
    scored = stored(scored, "scored")
    enough = F.col("n_words") >= min_words
    drawn = scored.filter(enough).count() * percent // 100
    order = ranked(scored.filter(enough), "score", key)
    order = order.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return order.unionByName(scored.filter(~enough).withColumn("rank", F.lit(None).cast("long")))
