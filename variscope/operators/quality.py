"""Data quality: column profiles, duplicates, patterns, dependencies, issues and scores.

Profiles work on a frequency table of (column, value): the cells of all columns are unpivoted and
counted with partial aggregation in one scan, and everything else is derived from the counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variscope.functions.quantiles import exact_quantiles
from variscope.functions.timeparse import FIRST_YEAR, LAST_YEAR, SLASH_PATTERN, parse_time_value
from variscope.functions.values import (
    BLANKS,
    NUMBER_PATTERN,
    all_of,
    cell,
    clamp,
    finite_number,
    is_missing,
    quoted,
    ratio,
)
from variscope.session import ensure_checkpoint_dir, shared_table
from variscope.sources.coerce import cell_counts, spelled, text_columns, typed_counts

#: Stored rows and counts are written and read a few times, and they are the most of a profile's disk.
COMPRESSION = "zstd"

# Thresholds of the report.
MISSING_WARNING, MISSING_CRITICAL = 0.05, 0.4
DUPLICATE_WARNING, DUPLICATE_CRITICAL = 0.005, 0.1
OUTLIER_WARNING = 0.02
TOP_VALUES, TOP_PATTERNS, PATTERN_COLUMNS, TOP_PAIRS = 10, 12, 8, 20
CORRELATION_MINIMUM, CORRELATION_ROWS = 0.8, 20
DEPENDENCY_MINIMUM, DEPENDENCY_ROWS, DEPENDENCY_VALUES = 0.98, 30, 60
# Name and value patterns.
IDENTIFIER_NAME = (
    r"(?i)(^id$|(^|_)(id|identifier|record.?id|transaction.?id|customer.?id|account.?id)($|_)|Id$)"
)
SENSITIVE_NAME = (
    r"(?i)(email|e-mail|phone|mobile|ssn|social.?security|address|postal|zip|dob|birth|first.?name"
    r"|last.?name|full.?name|card|account.?number|ip.?address)"
)
EMAIL_VALUE = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
PHONE_VALUE = r"(?:\+?\d[\s().-]*){9,}"
SSN_VALUE = r"^\d{3}-\d{2}-\d{4}$"
ISO_DATE = r"^\d{4}[-/]\d{1,2}([-/]\d{1,2}([T ].*)?)?$"
NAMED_TIME = r"(?i)date|day|week|month|quarter|period|fiscal|year"


@dataclass(frozen=True)
class QualityOptions:
    as_of: date
    required: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()
    freshness_days: int | None = None


def _date_in(text: Column) -> Column:
    """The text as a date under the profile's rule: a date mark and a day or month spelling."""
    iso = F.replace(text, F.lit("/"), F.lit("-")).try_cast("date")
    d = F.when(text.rlike(ISO_DATE), iso).when(
        text.rlike(SLASH_PATTERN), F.try_to_timestamp(text, F.lit("M/d/yyyy")).cast("date")
    )
    return F.when(F.year(d).between(FIRST_YEAR, LAST_YEAR), d)


class Profiler:
    """Frequency table of one DataFrame and the profile derived from it."""

    def __init__(self, df: DataFrame, options: QualityOptions, columns: Sequence[str] | None = None):
        self.df = df
        self.options = options
        self.columns = sorted(columns or df.columns)

    @cached_property
    def rows(self) -> DataFrame:
        """The profiled columns, stored once for the reports that read rows as well as counts: the joins and
        shuffles behind them run once."""
        names = list(dict.fromkeys([*self.columns, *(["_present_fields"] if "_present_fields" in self.df.columns else [])]))
        # Parquet has no column without a type; such cells are missing under any type.
        kept = {c: cell(self.df, c).cast("string") if isinstance(self.df.schema[c].dataType, T.NullType) else cell(self.df, c) for c in names}
        stored = shared_table(self.df.select(*[kept[c].alias(f"_{i}") for i, c in enumerate(names)]), "rows", COMPRESSION)
        return stored.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names)])

    @cached_property
    def _counts(self) -> DataFrame:
        """The stored part of ``frequencies``. What a number or a text makes plain is not stored beside it."""
        df = self.__dict__.get("rows", self.df)
        texts = set(text_columns(df))
        keys = ["column", "kind", "text", "number"]
        parts = []
        for of_texts in (True, False):
            names = [c for c in self.columns if (c in texts) == of_texts]
            if not names:
                continue
            typed = typed_counts(cell_counts(df, names))
            # Different texts may be one number; other sources are distinct already.
            parts.append(typed.groupBy(*keys).agg(F.sum("count").alias("count")) if of_texts else typed.select(*keys, "count"))
        distinct = reduce(DataFrame.unionByName, parts).withColumn("_text", F.when(F.col("kind") != "number", F.col("text")))
        bare = F.btrim("_text", F.lit(BLANKS))
        string = F.col("kind") == "string"
        distinct = distinct.withColumn("_bare", F.when(string, bare))
        parsed = F.when(F.col("_text").rlike(NUMBER_PATTERN), F.col("_text").try_cast("double"))
        shaped = distinct.select(
            "column", "kind", F.col("_text").alias("text"), "count",
            F.when(string, parsed).otherwise(F.col("number")).alias("value_number"), _date_in(F.col("_bare")).alias("value_date"),
        )
        return shared_table(shaped, "frequencies", COMPRESSION)

    @property
    def frequencies(self) -> DataFrame:
        """``column, kind, text, number, count`` and what each distinct value looks like (its number,
        date, edges and normal form); a missing cell has kind ``missing``.

        Every report reads these counts, some side by side, so they are stored once.
        """
        number, string = F.col("kind") == "number", F.col("kind") == "string"
        bare = F.btrim("text", F.lit(BLANKS))
        return self._counts.select(
            "column", "kind",
            F.when(number, spelled(F.col("value_number"))).otherwise(F.col("text")).alias("text"),
            F.when(number, F.col("value_number")).alias("number"),
            "count", "value_number", "value_date",
            F.when(string, F.col("text") != bare).alias("blank_edge"),
            F.when(string, F.lower(F.regexp_replace(bare, r"\s+", " "))).alias("norm"),
        )

    @property
    def values(self) -> DataFrame:
        """Distinct present values."""
        return self.frequencies.filter("kind <> 'missing'")

    @cached_property
    def quartiles(self) -> DataFrame:
        """Quartiles of each column's numbers, weighted by the counts."""
        q = exact_quantiles(
            self.values.filter("value_number IS NOT NULL"), "value_number", [0.25, 0.5, 0.75], ["column"], weight="count"
        )
        return q.select(
            "column", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")
        )

    @cached_property
    def profile(self) -> DataFrame:
        """The column profile, one row per column. It is checkpointed because several reports read
        it and its lineage is long compared with its size."""
        ensure_checkpoint_dir(self.df.sparkSession)
        return column_profile(self).checkpoint()

    @cached_property
    def summary(self) -> DataFrame:
        ensure_checkpoint_dir(self.df.sparkSession)
        _ = self.rows  # stored first, so that the counts of the profile are of the same rows
        return dataset_summary(self, self.profile).checkpoint()

    def release(self) -> None:
        """Forget the stored rows and counts; their files go when the application ends."""
        self.__dict__.pop("rows", None)
        self.__dict__.pop("_counts", None)


def outliers_iqr(p: Profiler) -> DataFrame:
    """Numeric statistics of each column: quartiles, spread, outliers beyond 1.5 and 3 IQR, skew."""
    v, n = F.col("value_number"), F.col("count")
    # One row per column of the table.
    joined = p.values.filter(v.isNotNull()).join(F.broadcast(p.quartiles), "column")
    iqr = F.col("q3") - F.col("q1")

    def outside(k: float) -> Column:
        beyond = (v < F.col("q1") - k * iqr) | (v > F.col("q3") + k * iqr)
        return F.sum(F.when((iqr > 0) & beyond, n).otherwise(0))

    folded = joined.groupBy("column", "q1", "median", "q3").agg(
        F.sum(n).alias("numeric_count"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        (F.sum(v * n) / F.sum(n)).alias("mean"),
        F.sum(F.when(v == 0, n).otherwise(0)).alias("zeros"),
        F.sum(F.when(v < 0, n).otherwise(0)).alias("negatives"),
        outside(1.5).alias("outlier_count"),
        outside(3.0).alias("extreme_outlier_count"),
    )
    spread = (
        joined.join(F.broadcast(folded.select("column", "mean")), "column")
        .groupBy("column")
        .agg(F.sqrt(F.sum((v - F.col("mean")) * (v - F.col("mean")) * n) / F.sum(n)).alias("standard_deviation"))
    )
    return folded.join(F.broadcast(spread), "column").withColumns(
        {
            "outlier_rate": F.col("outlier_count") / F.col("numeric_count"),
            "skew_indicator": F.coalesce(
                ratio(F.col("mean") - F.col("median"), F.col("standard_deviation")), F.lit(0.0)
            ),
        }
    )


def string_variants(p: Profiler) -> DataFrame:
    """Text statistics of each column: lengths, blank edges and rows whose value has another
    spelling that differs only by case or spacing."""
    texts = p.values.filter("kind = 'string'")
    by_norm = texts.groupBy("column", "norm").agg(
        F.count("*").alias("_spellings"),
        F.sum("count").alias("_rows"),
        F.sum(F.when(F.col("blank_edge"), F.col("count")).otherwise(0)).alias("_edges"),
        F.min(F.length("text")).alias("_min"),
        F.max(F.length("text")).alias("_max"),
        F.sum(F.length("text") * F.col("count")).alias("_chars"),
    )
    return by_norm.groupBy("column").agg(
        F.sum("_rows").alias("text_count"),
        F.min("_min").alias("min_length"),
        F.max("_max").alias("max_length"),
        (F.sum("_chars") / F.sum("_rows")).alias("average_length"),
        F.sum("_edges").alias("whitespace_count"),
        F.sum(F.when(F.col("_spellings") > 1, F.col("_rows")).otherwise(0)).alias("collision_rows"),
    )


def date_quality(p: Profiler) -> DataFrame:
    """Valid, invalid and future dates of each column that has any, and the age of the newest."""
    as_of = F.lit(p.options.as_of)
    d, n = F.col("value_date"), F.col("count")
    return (
        p.values.groupBy("column")
        .agg(
            F.sum(F.when(d.isNotNull(), n).otherwise(0)).alias("valid_dates"),
            F.sum(F.when(d.isNull(), n).otherwise(0)).alias("invalid_dates"),
            F.min(d).alias("min_date"),
            F.max(d).alias("max_date"),
            F.sum(F.when(d > F.date_add(as_of, 1), n).otherwise(0)).alias("future_dates"),
        )
        .filter("valid_dates > 0")
        .withColumn("days_since_latest", F.datediff(as_of, F.col("max_date")))
    )


def sensitive_scan(p: Profiler) -> DataFrame:
    """Reasons to treat a column as sensitive, from its name and all of its values."""
    t = F.col("text")
    flags = p.values.groupBy("column").agg(
        F.max(t.rlike(EMAIL_VALUE)).alias("_email"),
        F.max(t.rlike(PHONE_VALUE)).alias("_phone"),
        F.max(t.rlike(SSN_VALUE)).alias("_ssn"),
    )
    reasons = F.concat_ws(
        ",",
        F.when(F.col("column").rlike(SENSITIVE_NAME), F.lit("name")),
        F.when(F.col("_email"), F.lit("email")),
        F.when(F.col("_phone"), F.lit("phone")),
        F.when(F.col("_ssn"), F.lit("ssn")),
    )
    return flags.select("column", reasons.alias("sensitive_reasons"), (reasons != "").alias("potential_sensitive"))


def top_values(p: Profiler, k: int = TOP_VALUES) -> DataFrame:
    """The ``k`` most frequent values of each column and their share of the rows."""
    rows = p.frequencies.groupBy("column").agg(F.sum("count").alias("_rows"))
    order = W.partitionBy("column").orderBy(F.desc("count"), F.col("text"))
    return (
        p.values.groupBy("column", "text")
        .agg(F.sum("count").alias("count"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .join(F.broadcast(rows), "column")
        .select("column", F.col("text").alias("value"), "rank", "count", (F.col("count") / F.col("_rows")).alias("share"))
    )


def column_profile(p: Profiler) -> DataFrame:
    """One row per column: counts, types, kind, statistics, role and the 0-100 quality score."""
    n = F.col("count")
    present = F.col("kind") != "missing"
    base = p.frequencies.groupBy("column").agg(
        F.sum(n).alias("row_count"),
        F.sum(F.when(present, n).otherwise(0)).alias("non_null_count"),
        F.count_if(present).alias("distinct_count"),
        F.coalesce(F.max(F.when(present, n)), F.lit(0)).alias("_top"),
        *[
            F.sum(F.when(F.col("kind") == k, n).otherwise(0)).alias(f"{k}_cells")
            for k in ("number", "boolean", "string")
        ],
    )
    looks = p.values.groupBy("column").agg(
        F.sum(F.when(F.col("value_number").isNotNull(), n).otherwise(0)).alias("_numeric"),
        F.sum(F.when(F.col("value_date").isNotNull(), n).otherwise(0)).alias("_dates"),
    )
    one = F.lit(1)
    # Each side has one row per column of the table.
    joined = base
    for side in (looks, outliers_iqr(p), string_variants(p), date_quality(p), sensitive_scan(p)):
        joined = joined.join(F.broadcast(side), "column", "left")
    filled = joined.na.fill(
        0, ["_numeric", "_dates", "whitespace_count", "collision_rows", "outlier_count", "numeric_count"]
    ).na.fill({"sensitive_reasons": "", "potential_sensitive": False})
    some = F.greatest(F.col("non_null_count"), one)
    most = F.greatest("number_cells", "boolean_cells", "string_cells")
    step1 = filled.withColumns(
        {
            "null_count": F.col("row_count") - F.col("non_null_count"),
            "null_rate": (F.col("row_count") - F.col("non_null_count")) / F.greatest(F.col("row_count"), one),
            "uniqueness_rate": F.col("distinct_count") / some,
            "type_consistency": most / some,
            "dominant_type": F.when(F.col("non_null_count") == 0, "missing")
            .when(F.col("number_cells") == most, "number")
            .when(F.col("string_cells") == most, "string")
            .otherwise("boolean"),
            "high_cardinality": F.col("distinct_count") > F.greatest(F.lit(80.0), F.col("row_count") * 0.2),
            "constant": (F.col("distinct_count") <= 1) & (F.col("non_null_count") > 0),
            "top_share": F.col("_top") / F.greatest(F.col("row_count"), one),
            "has_numbers": F.col("_numeric") / some >= 0.8,
            "has_dates": (F.col("_dates") / some >= 0.5) & (F.col("_dates") > 0),
        }
    )
    kind = infer_kind(
        F.col("_numeric") / some,
        F.col("boolean_cells") / some,
        F.col("_dates") / some,
        F.col("distinct_count") / F.greatest(F.col("row_count"), one),
        F.col("non_null_count"),
    )
    step2 = step1.withColumns(
        {
            "inferred_kind": kind,
            "near_constant": ~F.col("constant") & (F.col("top_share") >= 0.98),
            "identifier_candidate": identifier_name(F.col("column"))
            | ((F.col("uniqueness_rate") >= 0.98) & F.col("high_cardinality")),
            "outlier_rate": F.when(F.col("has_numbers"), F.coalesce("outlier_rate", F.lit(0.0))),
        }
    )
    format_rate = (F.col("whitespace_count") + F.col("collision_rows")) / F.greatest(
        F.col("non_null_count") * 2, one
    )
    distribution = F.coalesce("outlier_rate", F.lit(0.0)) * 1.5 + F.when(F.col("constant"), 0.3).when(
        F.col("near_constant"), 0.12
    ).otherwise(0.0)
    score = clamp(
        100
        * (
            0.42 * (1 - F.col("null_rate"))
            + 0.28 * F.col("type_consistency")
            + 0.18 * (1 - F.least(F.lit(1.0), format_rate))
            + 0.12 * (1 - F.least(F.lit(1.0), distribution))
        )
    )
    return step2.withColumns({"analysis_role": analysis_role(), "quality_score": score}).drop(
        "_top", "_numeric", "_dates"
    )


def identifier_name(name: Column) -> Column:
    return name.rlike(IDENTIFIER_NAME)


def infer_kind(numeric: Column, boolean: Column, dated: Column, unique: Column, present: Column) -> Column:
    """Kind of a column from the shares of its present values."""
    return (
        F.when(present == 0, "categorical")
        .when(numeric >= 0.95, "numeric")
        .when(boolean >= 0.95, "boolean")
        .when(dated >= 0.9, "date")
        .when(unique >= 0.92, "identifier")
        .otherwise("categorical")
    )


def analysis_role() -> Column:
    """Role of a profiled column: identifier, measure, dimension or excluded."""
    measure = (
        (F.col("inferred_kind") == "numeric")
        & (F.col("type_consistency") >= 0.9)
        & (F.col("null_rate") < 0.5)
        & ~F.col("constant")
    )
    dimension = (
        F.col("inferred_kind").isin("categorical", "date", "boolean")
        & (F.col("distinct_count") > 1)
        & ~F.col("high_cardinality")
        & (F.col("null_rate") < 0.7)
    )
    return (
        F.when(F.col("identifier_candidate"), "identifier")
        .when(measure, "measure")
        .when(dimension, "dimension")
        .otherwise("excluded")
    )


def profile_fields(p: Profiler) -> DataFrame:
    """Kind, distinct and null counts under the field-picker rules (identifiers come first)."""
    n = F.col("count")
    base = p.frequencies.groupBy("column").agg(
        F.sum(n).alias("rows"),
        F.sum(F.when(F.col("kind") == "missing", n).otherwise(0)).alias("null_count"),
        F.count_if(F.col("kind") != "missing").alias("distinct_count"),
        F.sum(F.when(F.col("kind") == "boolean", n).otherwise(0)).alias("_booleans"),
    )
    looks = p.values.groupBy("column").agg(
        F.sum(F.when(F.col("value_number").isNotNull(), n).otherwise(0)).alias("_numeric"),
        F.sum(F.when(F.col("value_date").isNotNull(), n).otherwise(0)).alias("_dates"),
    )
    values = F.col("rows") - F.col("null_count")
    some = F.greatest(values, F.lit(1))
    unique = F.col("distinct_count") / some
    kind = (
        F.when(
            identifier_name(F.col("column"))
            | (
                (values > 20)
                & (unique >= 0.98)
                & (F.col("distinct_count") > F.greatest(F.lit(80.0), F.col("rows") * 0.2))
            ),
            "identifier",
        )
        .when((values > 0) & (F.col("_numeric") / some >= 0.95), "numeric")
        .when((values > 0) & (F.col("_booleans") / some >= 0.95), "boolean")
        .when((values > 0) & (F.col("_dates") / some >= 0.9), "date")
        .when((values > 20) & (unique >= 0.92), "identifier")
        .otherwise("categorical")
    )
    return (
        base.join(F.broadcast(looks), "column", "left")
        .na.fill(0, ["_numeric", "_dates"])
        .select("column", kind.alias("kind"), "distinct_count", "null_count")
    )


def detect_time_fields(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns that parse as time for at least 65 % of their values on two or more days, with a
    confidence and a suggested grain. Every row is read."""
    counted = cell_counts(df, list(columns or df.columns))
    raw = F.col("raw")
    parsed = (
        F.when(F.col("source") == "text", parse_time_value(counted, "raw"))
        .when(F.col("source") == "number", parse_time_value(counted, "number"))
        .when(
            F.col("source") == "time",
            F.struct(raw.try_cast("timestamp").alias("ts"), F.lit("day").alias("precision")),
        )
    )
    days = (
        counted.filter(F.coalesce(F.btrim(raw, F.lit(BLANKS)) != "", F.col("number").isNotNull()))
        .withColumn("p", parsed)
        .select(
            F.col("column").alias("field"),
            F.col("p.ts").cast("date").alias("day"),
            F.col("p.precision").alias("precision"),
            "count",
        )
    )
    n = F.col("count")
    grains = ("day", "week", "month", "quarter")
    folded = days.groupBy("field").agg(
        F.sum(n).alias("_present"),
        F.sum(F.when(F.col("day").isNotNull(), n).otherwise(0)).alias("_parsed"),
        F.count_distinct("day").alias("distinct_periods"),
        F.min("day").alias("min_date"),
        F.max("day").alias("max_date"),
        *[F.sum(F.when(F.col("precision") == g, n).otherwise(0)).alias(f"_{g}") for g in grains],
    )
    rate = F.col("_parsed") / F.col("_present")
    boost = F.when(F.col("field").rlike(NAMED_TIME), 0.12).otherwise(0.0)
    top = F.greatest(*[F.col(f"_{g}") for g in grains])
    by_name = (
        F.when(F.col("field").rlike(r"(?i)quarter|fiscal.?q|(^|_)qtr"), "quarter")
        .when(F.col("field").rlike(r"(?i)week|(^|_)wk"), "week")
        .when(F.col("field").rlike(r"(?i)month|period|fiscal.?m"), "month")
        .when(F.col("field").rlike(r"(?i)date|day|timestamp"), "day")
    )
    by_value = F.coalesce(*[F.when(F.col(f"_{g}") == top, F.lit(g)) for g in grains])
    return (
        folded.withColumn("parse_rate", rate)
        .filter("parse_rate >= 0.65 AND distinct_periods >= 2")
        .select(
            "field",
            "parse_rate",
            "distinct_periods",
            "min_date",
            "max_date",
            F.coalesce(by_name, by_value).alias("suggested_grain"),
            F.least(
                F.lit(1.0), rate * 0.82 + F.least(F.lit(0.12), F.col("distinct_periods") / 100) + boost
            ).alias("confidence"),
        )
    )


def parse_time_report(df: DataFrame, name: str) -> DataFrame:
    """Rows of one time column by the precision they parse to."""
    parsed = parse_time_value(df, name)
    precision = F.when(is_missing(df, name), "missing").otherwise(F.when(parsed["ts"].isNull(), "unparsed").otherwise(parsed["precision"]))
    return (
        df.select(precision.alias("precision"), parsed["ts"].alias("ts"))
        .groupBy("precision")
        .agg(F.count("*").alias("rows"), F.min("ts").cast("date").alias("min_date"), F.max("ts").cast("date").alias("max_date"))
    )


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier row; missing cells equal each other. Copies collapse in the
    partial aggregation, so many copies of one row cost one shuffled row per task.

    A row travels as 128 bits, two hashes with different seeds, however wide it is: among 10^12 different rows,
    two that are taken for copies have a chance of about one in 10^15. Hashes skip nulls, so what is missing is hashed too.
    """
    names = list(columns or df.columns)
    gone = F.array(*[is_missing(df, c) for c in names])
    keys = [F.when(~is_missing(df, c), cell(df, c)) for c in names]
    # Spark hashes no maps; they are compared as they are.
    maps = [k.alias(f"_m{i}") for i, (c, k) in enumerate(zip(names, keys)) if "map<" in df.schema[c].dataType.simpleString()]
    hashed = [k for c, k in zip(names, keys) if "map<" not in df.schema[c].dataType.simpleString()]
    rows = df.select(*[F.xxhash64(F.lit(seed), gone, *hashed).alias(f"_h{seed}") for seed in (0, 1)], *maps)
    counts = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n"))
    return counts.agg(
        F.sum("_n").alias("row_count"),
        F.sum(F.col("_n") - 1).alias("duplicate_rows"),
        (F.sum(F.col("_n") - 1) / F.sum("_n")).alias("duplicate_rate"),
    )


def missing_cells(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing cells and wholly empty rows. A ``_present_fields`` count, kept by the JSON reader,
    also tells the ragged rows."""
    names = [c for c in (columns or df.columns) if c != "_present_fields"]
    gaps = sum((is_missing(df, c).cast("bigint") for c in names), F.lit(0))
    ragged = (
        F.count_if(df["_present_fields"] < len(names)) if "_present_fields" in df.columns else F.lit(0).cast("bigint")
    )
    return df.agg(
        F.count("*").alias("row_count"),
        F.sum(gaps).alias("missing_cells"),
        F.count_if(all_of(is_missing(df, c) for c in names)).alias("empty_rows"),
        ragged.alias("ragged_rows"),
    ).withColumns(
        {
            "cell_count": F.col("row_count") * len(names),
            "missing_rate": F.col("missing_cells") / F.greatest(F.col("row_count") * len(names), F.lit(1)),
        }
    )


def missing_patterns(df: DataFrame, columns: Sequence[str] | None = None, k: int = TOP_PATTERNS) -> DataFrame:
    """The most frequent sets of columns that are missing together. Sets are told apart by all their
    columns; only the printed label stops after the first."""
    names = sorted(columns or df.columns)
    gone = F.filter(F.array(*[F.when(is_missing(df, c), F.lit(c)) for c in names]), lambda x: x.isNotNull())
    label = F.concat(
        F.array_join(F.slice("_gone", 1, PATTERN_COLUMNS), "|"),
        F.when(F.size("_gone") > PATTERN_COLUMNS, "|…").otherwise(""),
    )
    counts = (
        df.select(gone.alias("_gone"))
        .groupBy("_gone")
        .agg(F.count("*").alias("count"))
        .select("_gone", label.alias("columns"), "count", F.size("_gone").alias("_size"))
    )
    # Complete rows are one more pattern, so the patterns add up to the rows of the table.
    rows = counts.agg(F.sum("count")).scalar()
    return (
        counts.filter(F.col("_size") > 0)
        .orderBy(F.desc("count"), "columns", "_gone")
        .limit(k)
        .select("columns", "count", (F.col("count") / rows).alias("share"))
    )


def correlations(df: DataFrame, measures: Sequence[str], k: int | None = TOP_PAIRS) -> DataFrame:
    """Strong pairwise correlations of the measures, all pairs in one aggregation; ``k`` limits the report."""
    names = list(measures)
    numbers = df.select(*[finite_number(df, c).cast("double").alias(c) for c in names])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    both = lambda a, b: F.col(quoted(a)).isNotNull() & F.col(quoted(b)).isNotNull()
    folded = numbers.agg(
        *[F.corr(quoted(a), quoted(b)).alias(f"_c{i}") for i, (a, b) in enumerate(pairs)],
        *[F.count_if(both(a, b)).alias(f"_n{i}") for i, (a, b) in enumerate(pairs)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("left"),
                F.lit(b).alias("right"),
                F.col(f"_c{i}").alias("correlation"),
                F.col(f"_n{i}").alias("sample_size"),
            )
            for i, (a, b) in enumerate(pairs)
        ]
    )
    strong = (F.abs("correlation") >= CORRELATION_MINIMUM) & (F.col("sample_size") >= CORRELATION_ROWS)
    return (
        folded.select(F.inline(rows))
        .filter(strong & ~F.isnan("correlation"))
        .orderBy(F.abs("correlation").desc(), "left", "right")
        .limit(2**31 - 1 if k is None else k)
    )


def functional_dependencies(df: DataFrame, candidates: Sequence[str], k: int | None = TOP_PAIRS) -> DataFrame:
    """Column pairs where the first value fixes the second for at least 98 % of the rows.

    A group of the first column is single-valued when its smallest and largest second value agree,
    so each first column needs one grouped pass that carries every second column, and the rows are
    multiplied by the number of columns instead of the number of pairs.
    """
    names = list(candidates)
    # Second values travel as 64-bit hashes: numbers keep the hash aggregation that min and max of
    # text would lose. The hashes of the at most 60 values of a column are checked to be distinct.
    present = df.select(
        *[F.when(~is_missing(df, c), cell(df, c).cast("string")).alias(c) for c in names],
        *[F.when(~is_missing(df, c), F.xxhash64(cell(df, c).cast("string"))).alias(f"_h_{c}") for c in names],
    )
    hashes = [f"_h_{c}" for c in names]
    long = present.unpivot([quoted(h) for h in hashes], [quoted(c) for c in names], "determinant", "_value").filter(F.col("_value").isNotNull())
    groups = long.groupBy("determinant", "_value").agg(
        *[f(quoted(h)).alias(f"{p}{h}") for h in hashes for p, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]
    )
    stacked = groups.select(
        "determinant",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("dependent"),
                        F.col(quoted(f"n_h_{c}")).alias("n"),
                        F.when(F.col(quoted(f"lo_h_{c}")) == F.col(quoted(f"hi_h_{c}")), F.col(quoted(f"n_h_{c}"))).otherwise(0).alias("same"),
                        F.col(quoted(f"lo_h_{c}")).alias("hash"),
                    )
                    for c in names
                ]
            )
        ),
    )
    folded = stacked.groupBy("determinant", "dependent").agg(
        F.sum("n").alias("rows"), F.sum("same").alias("_same"), F.count("*").alias("_values")
    )
    own = stacked.filter("determinant = dependent")
    clash = F.raise_error(F.concat(F.lit("hash clash in column "), F.col("determinant")))
    sizes = (
        own.groupBy("determinant")
        .agg(F.count("*").alias("_values"), F.count_distinct("hash").alias("_hashes"))
        .filter(F.col("_values") <= DEPENDENCY_VALUES)
        .select(
            F.col("determinant").alias("name"),
            F.when(F.col("_values") == F.col("_hashes"), F.col("_values")).otherwise(clash.cast("bigint")).alias("distinct"),
        )
    )
    left = sizes.select(F.col("name").alias("determinant"), F.col("distinct").alias("_left"))
    right = sizes.select(F.col("name").alias("dependent"), F.col("distinct").alias("_right"))
    return (
        folded.filter("determinant <> dependent")
        .join(F.broadcast(left), "determinant")
        .join(F.broadcast(right), "dependent")
        .filter((F.col("_left") >= F.col("_right")) & (F.col("rows") >= DEPENDENCY_ROWS))
        .withColumn("confidence", F.col("_same") / F.col("rows"))
        .filter(F.col("confidence") >= DEPENDENCY_MINIMUM)
        .select("determinant", "dependent", "confidence", "rows")
        .orderBy(F.desc("confidence"), F.desc("rows"), "determinant", "dependent")
        .limit(2**31 - 1 if k is None else k)
    )


def key_check(profile: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether each configured key is complete and unique, read from the profile."""
    return profile.filter(F.col("column").isin(list(keys))).select(
        "column",
        "null_count",
        "uniqueness_rate",
        ((F.col("null_count") == 0) & (F.col("uniqueness_rate") >= 1)).alias("valid"),
    )


def _issue(condition: Column, dimension: str, severity: str | Column, title: str, affected: Column) -> Column:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(
        condition,
        F.struct(
            F.lit(dimension).alias("dimension"),
            severity.alias("severity"),
            F.lit(title).alias("title"),
            affected.cast("bigint").alias("affected_rows"),
        ),
    )


def column_issues(profile: DataFrame) -> DataFrame:
    """The rules on single columns: one row per column and broken rule."""
    c = F.col
    some = F.greatest(c("non_null_count"), F.lit(1))
    mixed = (c("type_consistency") < 0.95) & (c("non_null_count") > 0)
    none = F.lit(None)
    rules = F.array(
        _issue(c("null_rate") >= MISSING_CRITICAL, "completeness", "critical", "High missingness", c("null_count")),
        _issue(
            (c("null_rate") >= MISSING_WARNING) & (c("null_rate") < MISSING_CRITICAL),
            "completeness", "warning", "Missing values", c("null_count"),
        ),
        _issue(
            mixed, "validity", F.when(c("type_consistency") < 0.8, "critical").otherwise("warning"),
            "Mixed runtime types", F.round(c("non_null_count") * (1 - c("type_consistency"))),
        ),
        _issue(c("whitespace_count") > 0, "conformity", "warning", "Whitespace inconsistencies", c("whitespace_count")),
        _issue(c("collision_rows") > 0, "consistency", "warning", "Category variants", c("collision_rows")),
        _issue(
            c("outlier_rate") >= OUTLIER_WARNING, "distribution",
            F.when(c("extreme_outlier_count") > 0, "warning").otherwise("info"), "Potential numeric outliers", c("outlier_count"),
        ),
        _issue(
            c("has_dates") & (c("invalid_dates") > 0), "validity",
            F.when(c("invalid_dates") / some > 0.1, "critical").otherwise("warning"), "Invalid date values", c("invalid_dates"),
        ),
        _issue(c("has_dates") & (c("future_dates") > 0), "validity", "warning", "Future-dated records", c("future_dates")),
        _issue(c("constant"), "distribution", "info", "Constant column", none),
        _issue(c("near_constant"), "distribution", "info", "Near-constant column", none),
        _issue(c("identifier_candidate"), "readiness", "info", "Identifier-like column", none),
        _issue(c("potential_sensitive"), "privacy", "warning", "Potential sensitive data", none),
    )
    return profile.select("column", F.inline(F.filter(rules, lambda x: x.isNotNull())))


def dataset_summary(p: Profiler, profile: DataFrame) -> DataFrame:
    """One row of dataset totals: cells, duplicates and what the profile adds up to."""
    cells = missing_cells(p.rows, p.columns + (["_present_fields"] if "_present_fields" in p.df.columns else []))
    copies = duplicate_rows(p.rows, p.columns).select("duplicate_rows", "duplicate_rate")
    c = F.col
    sums = profile.agg(
        F.count("*").alias("column_count"),
        F.avg(c("type_consistency") * 100).alias("mean_consistency"),
        F.sum(c("whitespace_count") + c("collision_rows")).alias("format_cells"),
        F.sum(F.when(c("has_numbers"), c("outlier_count")).otherwise(0)).alias("outliers"),
        F.sum(F.when(c("has_numbers"), c("numeric_count")).otherwise(0)).alias("numeric_cells"),
        F.count_if(c("analysis_role") == "measure").alias("measures"),
        F.count_if(c("analysis_role") == "dimension").alias("dimensions"),
        F.count_if(c("potential_sensitive")).alias("sensitive_columns"),
        F.min(F.when(c("has_dates"), F.greatest(c("days_since_latest"), F.lit(0)))).alias("freshest_days"),
    )
    # Three one-row tables side by side, the other two as scalar subqueries.
    row = lambda d: d.select(F.struct("*")).scalar()
    return cells.withColumns({"_copies": row(copies), "_sums": row(sums)}).select(
        *cells.columns, "_copies.*", "_sums.*"
    )


def dataset_issues(summary: DataFrame, profile: DataFrame, options: QualityOptions, columns: Sequence[str]) -> DataFrame:
    """The rules on the dataset, its required columns, keys and freshness."""
    c = F.col
    rows = F.greatest(c("row_count"), F.lit(1))
    none = F.lit(None)
    rules = [
        _issue(c("row_count") == 0, "readiness", "critical", "No rows", none),
        _issue(c("column_count") == 0, "readiness", "critical", "No columns", none),
        _issue(
            (c("duplicate_rows") > 0) & (c("duplicate_rate") >= DUPLICATE_WARNING), "uniqueness",
            F.when(c("duplicate_rate") >= DUPLICATE_CRITICAL, "critical").otherwise("warning"), "Duplicate rows", c("duplicate_rows"),
        ),
        _issue(
            c("ragged_rows") > 0, "integrity", F.when(c("ragged_rows") / rows > 0.1, "critical").otherwise("warning"),
            "Ragged records", c("ragged_rows"),
        ),
        _issue(c("empty_rows") > 0, "completeness", "warning", "Empty records", c("empty_rows")),
        _issue(c("measures") == 0, "readiness", "critical", "No reliable numeric measure", none),
        _issue(c("dimensions") < 2, "readiness", "critical", "Insufficient dimensions", none),
    ]
    if options.freshness_days is not None:
        rules.append(
            _issue(
                c("freshest_days") > options.freshness_days, "timeliness",
                F.when(c("freshest_days") > options.freshness_days * 3, "critical").otherwise("warning"), "Freshness SLA missed", none,
            )
        )
    whole = summary.select(
        F.lit(None).cast("string").alias("column"),
        F.inline(F.filter(F.array(*rules), lambda x: x.isNotNull())),
    )
    absent = [(x, "schema", "Required column missing") for x in options.required if x not in columns]
    absent += [(x, "integrity", "Configured key missing") for x in options.keys if x not in columns]
    for name, dimension, title in absent:
        whole = whole.unionByName(
            summary.select(
                F.lit(name).alias("column"), F.lit(dimension).alias("dimension"), F.lit("critical").alias("severity"),
                F.lit(title).alias("title"), F.lit(None).cast("bigint").alias("affected_rows"),
            )
        )
    broken = key_check(profile, options.keys).filter("NOT valid").select(
        "column", F.lit("integrity").alias("dimension"), F.lit("critical").alias("severity"),
        F.lit("Key is not unique and complete").alias("title"), F.lit(None).cast("bigint").alias("affected_rows"),
    )
    return whole.unionByName(broken)


def quality_issues(p: Profiler) -> DataFrame:
    """All issues of columns and dataset, with a stable id."""
    summary = p.summary
    both = column_issues(p.profile).unionByName(dataset_issues(summary, p.profile, p.options, p.columns))
    return both.withColumn(
        "issue_id", F.concat_ws(":", "dimension", F.coalesce("column", F.lit("dataset")), "title")
    )


def quality_dimensions(p: Profiler) -> DataFrame:
    """The twelve scored dimensions and, as ``overall``, the mean of the measured ones."""
    summary = p.summary
    issues = quality_issues(p).agg(
        F.count_if((F.col("dimension") == "validity") & (F.col("severity") == "critical")).alias("_invalid"),
        F.count_if(F.col("severity") == "critical").alias("blockers"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    c = F.col
    one = F.lit(1)
    rows, cells = F.greatest(c("row_count"), one), F.greatest(c("cell_count"), one)
    sla = p.options.freshness_days
    timely = F.lit(None).cast("double")
    if sla is not None:
        timely = F.when(
            c("freshest_days").isNotNull(),
            clamp(100 * (1 - F.greatest(F.lit(0), c("freshest_days") - sla) / max(sla * 3, 1))),
        )
    unmeasured = F.lit(None).cast("double")
    scores = [
        ("completeness", clamp(100 * (1 - c("missing_rate")) - c("empty_rows") / rows * 20)),
        ("uniqueness", clamp(100 * (1 - c("duplicate_rate")))),
        ("validity", clamp(c("mean_consistency") - c("_invalid") * 8)),
        (
            "conformity",
            clamp(100 * (1 - F.least(F.lit(1.0), c("format_cells") / cells * 3)) - c("ragged_rows") / rows * 20),
        ),
        ("integrity", clamp(100 - c("duplicate_rate") * 100 - c("ragged_rows") / rows * 100)),
        (
            "distribution",
            clamp(100 * (1 - F.least(F.lit(1.0), c("outliers") / F.greatest(c("numeric_cells"), one) * 2))),
        ),
        ("timeliness", timely),
        ("accuracy", unmeasured),
        ("drift", unmeasured),
        ("lineage", unmeasured),
        ("privacy", F.when(c("sensitive_columns") > 0, 75.0).otherwise(100.0)),
        (
            "readiness",
            clamp(
                F.when(c("measures") > 0, 45).otherwise(0)
                + F.when(c("dimensions") >= 2, 45).otherwise(c("dimensions") * 20)
                + F.when(c("row_count") >= 20, 10.0).otherwise(c("row_count") / 2)
            ),
        ),
    ]
    listed = F.array(*[F.struct(F.lit(n).alias("dimension"), s.cast("double").alias("score")) for n, s in scores])
    counts = issues.select(F.struct("*")).scalar()
    wide = summary.withColumn("_issues", counts).select("*", "_issues.*").withColumn("_listed", listed)
    counted = F.filter("_listed", lambda s: s["score"].isNotNull() & (s["dimension"] != "privacy"))
    mean = F.aggregate(counted, F.lit(0.0), lambda acc, s: acc + s["score"]) / F.size(counted)
    overall = F.struct(F.lit("overall").alias("dimension"), clamp(mean).alias("score"))
    graded = wide.select(
        "blockers",
        "warnings",
        (
            (c("blockers") == 0) & (c("measures") > 0) & (c("dimensions") >= 2) & (c("row_count") > 0)
        ).alias("analysis_ready"),
        F.inline(F.array_append("_listed", overall)),
    )
    s = c("score")
    by_dimension = F.when(s.isNull(), "not-configured").when(s >= 90, "pass").when(s >= 70, "warning").otherwise("critical")
    privacy = F.when(s < 100, "warning").otherwise("pass")
    whole = F.when(s >= 95, "excellent").when(s >= 85, "good").when(s >= 70, "watch").otherwise("poor")
    status = (
        F.when(c("dimension") == "overall", whole).when(c("dimension") == "privacy", privacy).otherwise(by_dimension)
    )
    return graded.select("dimension", "score", status.alias("status"), "blockers", "warnings", "analysis_ready")
