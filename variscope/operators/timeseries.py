"""Period series: aggregation, rolling baselines, alerts, summaries, run rate, trend and health.

The fact is aggregated to periods first, with partial aggregation before the shuffle. Every window
afterwards runs over periods, partitioned by the series columns, so one job serves any number of
series and a series with most of the rows is no larger than another once it is aggregated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from variscope.functions import calendar as C
from variscope.functions.timeparse import time_of
from variscope.functions.values import (
    array_median,
    array_robust_scale,
    canonical_category,
    clamp,
    finite_number,
    impact_direction,
    multiplier,
    ratio,
    variance_pct,
)
from variscope.operators.cohort import Predicate, apply_predicates

# Fixed values of the series rules.
BASELINE_HISTORY, BASELINE_MINIMUM = 6, 3
ANOMALY_HISTORY, ANOMALY_MINIMUM = 12, 4
MATERIALITY = 0.03
RECENT_PERIODS = 12


@dataclass(frozen=True)
class SeriesSpec:
    actual: str
    time_field: str
    expected: str | None = None
    series: tuple[str, ...] = ()
    grain: str = "month"
    aggregation: str = "sum"
    polarity: str = "higher_is_better"
    fiscal_start: int = 1
    predicates: tuple[Predicate, ...] = ()
    materiality: float = MATERIALITY
    absolute_materiality: float = 0.0


def over_series(spec: SeriesSpec):
    return W.partitionBy(*spec.series)


def in_order(spec: SeriesSpec):
    return over_series(spec).orderBy("period_start")


def period_base(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """One row per series and period (a null period collects the unparsed rows): counts, sums over
    the valid rows and the first and last day seen, before any row is dropped."""
    df = apply_predicates(df, spec.predicates)
    actual = finite_number(df, spec.actual)
    expected = finite_number(df, spec.expected) if spec.expected else F.lit(0.0)
    ts = time_of(df, spec.time_field)
    rows = df.select(
        *[canonical_category(df, c).alias(c) for c in spec.series],
        ts.alias("_ts"),
        C.period_start(ts.cast("date"), spec.grain, spec.fiscal_start).alias("period_start"),
        actual.alias("_actual"),
        expected.alias("_expected"),
    ).withColumn(
        "_valid",
        F.col("_ts").isNotNull() & F.col("_actual").isNotNull() & F.col("_expected").isNotNull(),
    )
    keys = [*spec.series, "period_start"]
    sums = [
        F.count("*").alias("scoped_rows"),
        F.count("_ts").alias("parsed_rows"),
        F.count(F.when(F.col("_ts").isNotNull(), F.col("_actual"))).alias("actual_rows"),
        F.count_if("_valid").alias("row_count"),
        F.sum(F.when(F.col("_valid"), F.col("_actual"))).alias("_a"),
        F.sum(F.when(F.col("_valid"), F.col("_expected"))).alias("_e"),
        F.min("_ts").alias("min_ts"),
        F.max("_ts").alias("max_ts"),
    ]
    if spec.aggregation != "period_end":
        return rows.groupBy(*keys).agg(*sums).withColumn("valid_row_count", F.col("row_count"))
    # Balances: totals per timestamp, then the latest timestamp that has valid rows.
    stamped = rows.groupBy(*keys, "_ts").agg(*sums)
    last = F.max(
        F.when(F.col("row_count") > 0, F.struct("_ts", "_a", "_e", "row_count"))
    ).alias("_last")
    return (
        stamped.groupBy(*keys)
        .agg(
            *[F.sum(c).alias(c) for c in ("scoped_rows", "parsed_rows", "actual_rows")],
            last,
            F.sum("row_count").alias("row_count"),
            F.min("min_ts").alias("min_ts"),
            F.max("max_ts").alias("max_ts"),
        )
        .select(
            "*",
            F.col("_last._a").alias("_a"),
            F.col("_last._e").alias("_e"),
            F.coalesce(F.col("_last.row_count"), F.lit(0)).alias("valid_row_count"),
        )
        .drop("_last")
    )


def period_aggregate(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Periods with at least one valid row: actual, expected, counts and the latest day of the series."""
    base = period_base(df, spec).withColumn(
        "latest_day", F.max("max_ts").over(over_series(spec)).cast("date")
    )
    per = F.col("row_count") if spec.aggregation == "average" else F.lit(1)
    return base.filter("row_count > 0").select(
        *spec.series,
        "period_start",
        C.period_end(F.col("period_start"), spec.grain).alias("period_end"),
        C.period_label(F.col("period_start"), spec.grain, spec.fiscal_start).alias("label"),
        (F.col("_a").cast("double") / per).alias("actual"),
        (F.col("_e").cast("double") / per).alias("expected"),
        ((F.col("_a") - F.col("_e")).cast("double") / per).alias("_difference"),
        "row_count",
        "valid_row_count",
        "latest_day",
    )


def rolling_median(value: str, spec: SeriesSpec, history: int, minimum: int) -> Column:
    """Median of the previous ``history`` periods, null below ``minimum`` of them."""
    frame = in_order(spec).rowsBetween(-history, -1)
    return F.when(
        F.count(value).over(frame) >= minimum, F.percentile(value, F.lit(0.5)).over(frame)
    )


def rolling_median_baseline(points: DataFrame, spec: SeriesSpec) -> DataFrame:
    """``expected`` from the median of the previous six actuals, else of all of them."""
    overall = F.percentile("actual", F.lit(0.5)).over(over_series(spec))
    return points.withColumn(
        "expected",
        F.coalesce(rolling_median("actual", spec, BASELINE_HISTORY, BASELINE_MINIMUM), overall),
    ).withColumn("_difference", F.col("actual") - F.col("expected"))


def with_variance(points: DataFrame, spec: SeriesSpec) -> DataFrame:
    impact = F.col("_difference") * multiplier(spec.polarity)
    return points.withColumns(
        {
            "variance": F.col("_difference"),
            "business_impact": impact,
            "impact_direction": impact_direction(impact),
            "variance_pct": variance_pct(F.col("_difference"), F.col("expected")),
        }
    ).drop("_difference")


def rolling_anomaly_score(points: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Distance of the impact from the median of the previous twelve, in robust scales."""
    history = F.collect_list("business_impact").over(in_order(spec).rowsBetween(-ANOMALY_HISTORY, -1))
    scored = points.withColumn("_history", history).withColumn(
        "_scale", array_robust_scale(F.col("_history"))
    )
    enough = (F.size("_history") >= ANOMALY_MINIMUM) & (F.col("_scale") > 0)
    distance = F.abs(F.col("business_impact") - array_median(F.col("_history"))) / F.col("_scale")
    return scored.withColumn("anomaly_score", F.when(enough, distance).otherwise(F.lit(0.0))).drop(
        "_history", "_scale"
    )


def materiality_alert(points: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Threshold, ``material`` flag and the severity ladder."""
    size, impact = F.abs("business_impact"), F.col("business_impact")
    threshold = F.greatest(
        F.lit(float(spec.absolute_materiality)), F.abs("expected") * F.lit(float(spec.materiality))
    )
    material = (size >= threshold) & (threshold > 0)
    score = F.col("anomaly_score")
    severity = (
        F.when((impact < 0) & ((size >= threshold * 2) | (score >= 3)), "critical")
        .when((impact < 0) & (material | (score >= 2)), "watch")
        .when((impact > 0) & material, "favorable")
        .otherwise("normal")
    )
    return points.withColumns(
        {"materiality_threshold": threshold, "material": material, "alert_severity": severity}
    )


def prior_period_change(points: DataFrame, spec: SeriesSpec) -> DataFrame:
    before = F.lag("business_impact").over(in_order(spec))
    return points.withColumn("prior_period_impact_change", F.col("business_impact") - before)


def prior_year_join(points: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Change against the period one year earlier: an equi-join on series and shifted period."""
    earlier = points.select(
        *spec.series,
        F.col("period_start").alias("_prior_start"),
        F.col("business_impact").alias("_prior_impact"),
    )
    shifted = C.period_start(
        C.prior_year(F.col("period_start")), spec.grain, spec.fiscal_start
    )
    return (
        points.withColumn("_prior_start", shifted)
        .join(earlier, [*spec.series, "_prior_start"], "left")
        .withColumn("prior_year_impact_change", F.col("business_impact") - F.col("_prior_impact"))
        .drop("_prior_start", "_prior_impact")
    )


def finance_points(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """All points of all series with baseline, impact, anomaly score, alert and changes."""
    points = period_aggregate(df, spec)
    if spec.expected is None:
        points = rolling_median_baseline(points, spec)
    points = rolling_anomaly_score(with_variance(points, spec), spec)
    points = prior_period_change(materiality_alert(points, spec), spec)
    return prior_year_join(points, spec)


def visible_points(points: DataFrame, window: str, fiscal_start: int = 1) -> DataFrame:
    """Only the points of a named window; history for baselines has been used before."""
    cutoff = C.window_cutoff(F.col("latest_day"), window, fiscal_start)
    return points if cutoff is None else points.filter(F.col("period_start") >= cutoff)


def reverse_rank(spec: SeriesSpec) -> Column:
    return F.row_number().over(over_series(spec).orderBy(F.desc("period_start")))


def alert_list(points: DataFrame, k: int = 6) -> DataFrame:
    """The ``k`` alerts to show first: by severity, the newest first."""
    rank = (
        F.when(F.col("alert_severity") == "critical", 0)
        .when(F.col("alert_severity") == "watch", 1)
        .otherwise(2)
    )
    series = [c for c in points.columns if c == "series"]
    return (
        points.filter("alert_severity <> 'normal'")
        .orderBy(rank, F.desc("period_start"), *series)
        .limit(k)
    )


def material_periods(points: DataFrame, spec: SeriesSpec, k: int = 12) -> DataFrame:
    """The last ``k`` periods of each series that are material or alerting."""
    notable = points.filter("material OR alert_severity IN ('critical', 'watch')")
    return notable.withColumn("recency", reverse_rank(spec)).filter(F.col("recency") <= k)


def period_summary(points: DataFrame, spec: SeriesSpec) -> DataFrame:
    """MTD, QTD, YTD and trailing totals of each series in one aggregation."""
    latest, start = F.col("latest_day"), F.col("period_start")
    trailing = C.TRAILING_PERIODS[spec.grain]
    labels = F.filter(
        F.array(
            F.when(start >= C.month_start(latest), F.lit("MTD")),
            F.when(start >= C.fiscal_quarter_start(latest, spec.fiscal_start), F.lit("QTD")),
            F.when(start >= C.fiscal_year_start(latest, spec.fiscal_start), F.lit("YTD")),
            F.when(F.col("_recency") <= trailing, F.lit("TRAILING")),
        ),
        lambda x: x.isNotNull(),
    )
    tagged = points.withColumn("_recency", reverse_rank(spec)).withColumn("window", F.explode(labels))

    def fold(c: str) -> Column:
        if spec.aggregation == "sum":
            return F.sum(c)
        if spec.aggregation == "average":
            return ratio(
                F.sum(F.col(c) * F.col("valid_row_count")), F.sum("valid_row_count").cast("double")
            )
        return F.max_by(c, "period_start")

    totals = tagged.groupBy(*spec.series, "window").agg(
        F.min("period_start").alias("start"),
        F.max("period_end").alias("end"),
        fold("actual").alias("actual"),
        fold("expected").alias("expected"),
        F.count("*").alias("period_count"),
        F.max("latest_day").alias("latest_day"),
    )
    variance = F.col("actual") - F.col("expected")
    impact = variance * multiplier(spec.polarity)
    return totals.withColumns(
        {
            "variance": variance,
            "business_impact": impact,
            "impact_direction": impact_direction(impact),
            "variance_pct": variance_pct(variance, F.col("expected")),
            "pace": ratio(F.col("actual"), F.col("expected")),
        }
    )


def run_rate(points: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Month-end projection from the elapsed days: only for daily sums in an unfinished month."""
    latest = F.col("latest_day")
    if spec.grain != "day" or spec.aggregation != "sum":
        raise ValueError("a run rate needs a daily sum series")
    mtd = period_summary(points, spec).filter("window = 'MTD'")
    days = mtd.withColumns(
        {"elapsed_days": F.dayofmonth(latest), "total_days": F.dayofmonth(F.last_day(latest))}
    ).filter("elapsed_days < total_days")
    factor = F.col("total_days") / F.greatest(F.col("elapsed_days"), F.lit(1))
    impact = (F.col("actual") - F.col("expected")) * factor * multiplier(spec.polarity)
    return days.select(
        *spec.series,
        F.col("latest_day").alias("as_of"),
        "elapsed_days",
        "total_days",
        (F.col("actual") * factor).alias("projected_actual"),
        (F.col("expected") * factor).alias("projected_expected"),
        impact.alias("projected_business_impact"),
        impact_direction(impact).alias("impact_direction"),
        F.when(F.col("elapsed_days") >= 10, "medium").otherwise("low").alias("confidence"),
    )


def recent_signals(points: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Forecast bias, volatility and drift over the last twelve points of each series."""
    rate = F.when(F.col("expected") == 0, F.lit(0.0)).otherwise(
        F.col("business_impact") / F.abs("expected")
    )
    recent = (
        points.withColumn("_recency", reverse_rank(spec))
        .filter(F.col("_recency") <= RECENT_PERIODS)
        .withColumn("_rate", rate)
    )
    folded = recent.groupBy(*spec.series).agg(
        F.count("*").alias("recent_periods"),
        ratio(F.sum("variance"), F.sum(F.abs("expected"))).alias("forecast_bias"),
        F.stddev_pop("_rate").alias("_std"),
        # At most twelve values, newest first.
        F.array_sort(F.collect_list(F.struct("_recency", "_rate"))).alias("_rates"),
    )
    rates = F.transform("_rates", lambda x: x["_rate"])
    half = F.floor(F.col("recent_periods") / 2).cast("int")
    newer = F.slice(F.col("_all"), F.lit(1), F.col("recent_periods").cast("int") - half)
    older = F.slice(F.col("_all"), F.col("recent_periods").cast("int") - half + 1, F.greatest(half, F.lit(0)))
    gap = F.abs(
        F.aggregate(newer, F.lit(0.0), lambda s, x: s + x) / F.size(newer)
        - F.aggregate(older, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(older), F.lit(0))
    )
    return (
        folded.withColumn("_all", rates)
        .withColumn("_scale", array_robust_scale(F.col("_all")))
        .select(
            *spec.series,
            "recent_periods",
            "forecast_bias",
            F.when(F.col("recent_periods") >= 2, F.col("_std")).alias("volatility"),
            F.when((half > 0) & (F.col("_scale") > 0), gap / F.col("_scale"))
            .otherwise(F.lit(0.0))
            .alias("drift_score"),
        )
    )


def trend(points: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Mean impact of the last three periods against the three before them."""
    r = F.col("_recency")
    folded = (
        points.withColumn("_recency", reverse_rank(spec))
        .filter(r <= 6)
        .groupBy(*spec.series)
        .agg(
            F.count("*").alias("_n"),
            F.avg(F.when(r <= 3, F.col("business_impact"))).alias("_recent"),
            F.avg(F.when(r > 3, F.col("business_impact"))).alias("_prior"),
            F.avg(F.abs("expected")).alias("_expected"),
        )
    )
    enough = F.col("_n") >= 6
    change = F.col("_recent") - F.col("_prior")
    direction = (
        F.when(~enough, "insufficient")
        .when(F.abs(change) < F.greatest(F.lit(1.0), F.col("_expected") * 0.01), "stable")
        .when(change > 0, "improving")
        .otherwise("worsening")
    )
    zero = F.lit(0.0)
    return folded.select(
        *spec.series,
        direction.alias("direction"),
        F.when(enough, F.col("_recent")).otherwise(zero).alias("recent_average_impact"),
        F.when(enough, F.col("_prior")).otherwise(zero).alias("prior_average_impact"),
        F.when(enough, change).otherwise(zero).alias("change"),
    )


def time_coverage(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Scoped, parsed and valid rows of each series, and the days they span."""
    folded = period_base(df, spec).groupBy(*spec.series).agg(
        F.sum("scoped_rows").alias("scoped_rows"),
        F.sum("parsed_rows").alias("parsed_rows"),
        F.sum("actual_rows").alias("_actual_rows"),
        F.sum("row_count").alias("valid_measure_rows"),
        F.count_if((F.col("row_count") > 0)).alias("period_count"),
        F.min("min_ts").cast("date").alias("min_date"),
        F.max("max_ts").cast("date").alias("max_date"),
    )
    return folded.withColumns(
        {
            "unparsed_rows": F.col("scoped_rows") - F.col("parsed_rows"),
            "excluded_measure_rows": F.col("parsed_rows") - F.col("valid_measure_rows"),
            "parse_rate": F.col("parsed_rows") / F.greatest(F.col("scoped_rows"), F.lit(1)),
            "valid_measure_rate": F.col("valid_measure_rows")
            / F.greatest(F.col("parsed_rows"), F.lit(1)),
            "expected_coverage": F.col("valid_measure_rows")
            / F.greatest(F.col("_actual_rows"), F.lit(1)),
        }
    ).drop("_actual_rows")


def model_health(coverage: DataFrame, signals: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Penalty score of each series from its depth, coverage and drift."""
    joined = (
        coverage.join(signals, list(spec.series), "left") if spec.series else _one_row(coverage, signals)
    )
    drift = F.coalesce(F.col("drift_score"), F.lit(0.0))
    n = F.col("period_count")
    penalties = [
        (n < 4, 55, "few_periods"),
        ((n >= 4) & (n < 8), 25, "short_history"),
        (F.col("parse_rate") < 0.9, 20, "unparsed_time"),
        (F.col("valid_measure_rate") < 0.95, 18, "invalid_measures"),
        (F.lit(spec.expected is not None) & (F.col("expected_coverage") < 0.95), 18, "missing_plan"),
        (drift >= 3, 10, "drift"),
    ]
    lost = sum((F.when(c, p).otherwise(0) for c, p, _ in penalties), F.lit(0))
    ready = n >= C.SEASONALITY_PERIODS[spec.grain]
    score = clamp((100 - lost).cast("double"))
    reasons = F.concat_ws(
        ",", *[F.when(c, F.lit(name)) for c, _, name in penalties], F.when(~ready, F.lit("seasonality"))
    )
    return joined.select(
        *spec.series,
        F.when(n < 4, "insufficient").when(score >= 80, "healthy").otherwise("watch").alias("status"),
        score.alias("score"),
        reasons.alias("reasons"),
        "period_count",
        "parse_rate",
        "valid_measure_rate",
        F.when(F.lit(spec.expected is not None), F.col("expected_coverage"))
        .otherwise(F.lit(1.0))
        .alias("expected_coverage"),
        ready.alias("seasonality_ready"),
        drift.alias("drift_score"),
    )


def _one_row(coverage: DataFrame, signals: DataFrame) -> DataFrame:
    """A series-less summary has one row on each side, keyed by a constant."""
    return (
        coverage.withColumn("_k", F.lit(1)).join(signals.withColumn("_k", F.lit(1)), "_k", "left").drop("_k")
    )
