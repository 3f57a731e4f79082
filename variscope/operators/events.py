"""Event studies: pre/post and difference-in-differences effects of dated events on cohorts."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from variscope.functions.quantiles import median_value
from variscope.functions.timeparse import date_of
from variscope.functions.values import (
    all_of,
    any_of,
    array_robust_scale,
    canonical_category,
    category_equals,
    finite_number,
    impact_direction,
    multiplier,
)
from variscope.operators.cohort import Predicate, apply_predicates

# Fixed values of the study rules.
MINIMUM_WINDOW_DAYS = 7
MINIMUM_PERIODS = 5
SUPPORTED_EFFECT, CONTRADICTED_EFFECT, HIGH_EFFECT = 1.0, 0.75, 1.5
PARALLEL_MINIMUM, PARALLEL_HIGH = 0.5, 0.75
#: Cohorts a bigint of the membership mask can hold.
MASK_BITS = 62


@dataclass(frozen=True)
class CohortEvent:
    """A dated event on the rows that satisfy one predicate set, against those of another one.

    The cohorts may overlap, and an empty set is every row. ``control`` None means a pre/post comparison.
    """

    event_id: str
    day: date
    affected: tuple[Predicate, ...]
    control: tuple[Predicate, ...] | None = None
    expected_direction: str | None = None
    pre_days: int = 30
    post_days: int = 30

    @property
    def first_day(self) -> date:
        return self.day - timedelta(days=max(MINIMUM_WINDOW_DAYS, self.pre_days))

    @property
    def last_day(self) -> date:
        return self.day + timedelta(days=max(MINIMUM_WINDOW_DAYS, self.post_days))


def cohort_name(predicates: Sequence[Predicate]) -> str:
    """One spelling of a predicate set, whatever its order."""
    return json.dumps(sorted(dict.fromkeys(map(tuple, predicates))), ensure_ascii=False)


def membership(df: DataFrame, cohorts: Sequence[Sequence[Predicate]]) -> list[Column]:
    """Which cohorts a row belongs to, a bit each; a column for every ``MASK_BITS`` of them."""
    words = []
    for start in range(0, len(cohorts), MASK_BITS):
        word = F.lit(0).cast("bigint")
        for i, predicates in enumerate(cohorts[start : start + MASK_BITS]):
            inside = all_of(category_equals(df, d, v) for d, v in sorted(predicates))
            word = word + F.when(inside, F.lit(1 << i)).otherwise(F.lit(0))
        words.append(word)
    return words


def _member(cohort: int) -> Column:
    """Whether a row of masks ``_m0``, ``_m1``... lies in a cohort."""
    return F.getbit(F.col(f"_m{cohort // MASK_BITS}"), F.lit(cohort % MASK_BITS)) == 1


def cohort_masks(
    df: DataFrame,
    time_field: str,
    actual: str,
    expected: str | None,
    cohorts: Sequence[Sequence[Predicate]],
    first_day: date,
    last_day: date,
) -> DataFrame:
    """Rows, actual and expected of every day and combination of cohorts, from one scan of the days.

    However many cohorts there are and however they overlap, a row is read and summed once. Rows of no
    cohort drop out. Without a comparison every row expects the median of the whole table.
    """
    a = finite_number(df, actual)
    e = F.lit(median_value(df, a) or 0.0) if expected is None else finite_number(df, expected)
    day = date_of(df, time_field)
    names = [f"_m{i}" for i in range(-(-len(cohorts) // MASK_BITS))]
    rows = (
        df.filter(day.between(F.lit(first_day), F.lit(last_day)))
        .select(day.alias("day"), a.alias("_a"), e.alias("_e"), *[m.alias(n) for m, n in zip(membership(df, cohorts), names, strict=True)])
        .dropna(subset=["_a", "_e"])
        .filter(any_of(F.col(n) != 0 for n in names))
    )
    return rows.groupBy("day", *names).agg(
        F.count("*").alias("rows"),
        F.sum("_a").alias("actual"),
        (F.count("*") * F.max("_e") if expected is None else F.sum("_e")).alias("expected"),
    )


def cohort_days(masks: DataFrame, cohorts: Sequence[Sequence[Predicate]]) -> DataFrame:
    """The daily sums of each cohort by its name, read off the masks that hold it."""
    held = F.array(*[F.when(_member(i), F.lit(cohort_name(c))) for i, c in enumerate(cohorts)])
    return (
        masks.select("day", "actual", "expected", F.explode(F.filter(held, lambda c: c.isNotNull())).alias("cohort"))
        .groupBy("cohort", "day")
        .agg(F.sum("actual").cast("double").alias("actual"), F.sum("expected").cast("double").alias("expected"))
        .withColumn("residual", F.col("actual") - F.col("expected"))
    )


def cohort_event_study(
    df: DataFrame,
    time_field: str,
    actual: str,
    expected: str | None,
    events: Sequence[CohortEvent],
    polarity: str = "higher_is_better",
) -> DataFrame:
    """``event_study`` for events on predicate sets, and ``shared_rows``: the rows of the event's window
    that both of its cohorts hold. All events are one scan; each has windows of its own."""
    spark = df.sparkSession
    if len({e.event_id for e in events}) < len(events):
        raise ValueError("two events have one id")
    cohorts = list({cohort_name(c): tuple(c) for e in events for c in (e.affected, e.control) if c is not None}.values())
    number = {cohort_name(c): i for i, c in enumerate(cohorts)}
    listed = spark.createDataFrame(
        [
            (e.event_id, e.day, cohort_name(e.affected), None if e.control is None else cohort_name(e.control), e.expected_direction, e.pre_days, e.post_days)
            for e in events
        ],
        "event_id string, event_day date, affected string, control string, expected_direction string, pre_days int, post_days int",
    )
    none = date(1970, 1, 1)
    first, last = min((e.first_day for e in events), default=none), max((e.last_day for e in events), default=none)
    masks = cohort_masks(df, time_field, actual, expected, cohorts or [()], first, last)
    studied = event_study(cohort_days(masks, cohorts or [()]), listed, "cohort", polarity)
    both = F.array(
        *[
            F.when(
                _member(number[cohort_name(e.affected)]) & _member(number[cohort_name(e.control)]) & F.col("day").between(F.lit(e.first_day), F.lit(e.last_day)),
                F.lit(e.event_id),
            )
            for e in events
            if e.control is not None
        ]
    ).cast("array<string>")
    shared = masks.select("rows", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("event_id")).groupBy("event_id").agg(F.sum("rows").alias("_shared"))
    return studied.join(shared, "event_id", "left").withColumn("shared_rows", F.when(F.col("control").isNotNull(), F.coalesce("_shared", F.lit(0)))).drop("_shared")


def daily_cohort_aggregate(
    df: DataFrame, time_field: str, actual: str, expected: str | None, cohort: Sequence[str]
) -> DataFrame:
    """Sums per cohort and day; without a comparison every row expects the median of the table."""
    day = date_of(df, time_field)
    a = finite_number(df, actual)
    if expected is None:
        e = F.lit(median_value(df, a) or 0.0)
    else:
        e = finite_number(df, expected)
    rows = df.select(
        *[canonical_category(df, c).alias(c) for c in cohort],
        day.alias("day"),
        a.alias("_a"),
        e.alias("_e"),
    ).dropna(subset=["day", "_a", "_e"])
    if expected is None:
        # The same literal for every row: the count is exact, a sum of doubles need not be.
        total = F.count("*") * F.max("_e")
    else:
        total = F.sum("_e").cast("double")
    return (
        rows.groupBy(*cohort, "day")
        .agg(F.sum("_a").cast("double").alias("actual"), total.alias("expected"))
        .withColumn("residual", F.col("actual") - F.col("expected"))
    )


def affected_vs_control(
    df: DataFrame, affected: Sequence[Predicate], control: Sequence[Predicate]
) -> DataFrame:
    """Both cohorts of one table, tagged by ``side``; a row may belong to both."""
    return (
        apply_predicates(df, affected)
        .withColumn("side", F.lit("affected"))
        .unionByName(apply_predicates(df, control).withColumn("side", F.lit("control")))
    )


def event_window_split(
    daily: DataFrame, event_day: Column, pre_days: int = 30, post_days: int = 30
) -> DataFrame:
    """Tag each day ``pre`` or ``post``; days outside both windows drop out."""
    pre_days, post_days = max(MINIMUM_WINDOW_DAYS, pre_days), max(MINIMUM_WINDOW_DAYS, post_days)
    day = F.col("day")
    phase = F.when((day >= F.date_sub(event_day, pre_days)) & (day < event_day), "pre").when(
        (day >= event_day) & (day <= F.date_add(event_day, post_days)), "post"
    )
    return daily.withColumn("phase", phase).filter(F.col("phase").isNotNull())


def trend_slope(df: DataFrame, value: str, order: str, by: Sequence[str]) -> DataFrame:
    """Least-squares slope of a value over its position in the series."""
    index = (F.row_number().over(W.partitionBy(*by).orderBy(order)) - 1).cast("double")
    return (
        df.withColumn("_i", index)
        .groupBy(*by)
        .agg(F.coalesce(F.regr_slope(value, "_i"), F.lit(0.0)).alias("slope"))
    )


def event_study(
    daily: DataFrame,
    events: DataFrame,
    cohort: str,
    polarity: str = "higher_is_better",
    pre_days: int = 30,
    post_days: int = 30,
) -> DataFrame:
    """One row per event: effect, standardised effect, parallel trend, status and confidence.

    ``daily`` holds one row per cohort value and day. ``events`` has ``event_id``, ``event_day``,
    ``affected`` and ``control`` (a cohort value or null) and ``expected_direction`` (or null), and may
    have windows of its own in ``pre_days`` and ``post_days``. Each event lists the days of its windows
    and reads them by (cohort, day), so any number of events may share a cohort. ``affected_summary``
    and ``control_summary`` hold the periods, averages and trend of a side, ``diagnostics`` what
    weakens the study.
    """
    windows = {"pre_days": pre_days, "post_days": post_days}
    windows = {k: F.greatest(F.lit(MINIMUM_WINDOW_DAYS), F.coalesce(F.col(k), F.lit(v)) if k in events.columns else F.lit(v)) for k, v in windows.items()}
    sides = events.select(
        "event_id",
        "event_day",
        *[c.alias(k) for k, c in windows.items()],
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit("affected").alias("side"), F.col("affected").alias("_cohort")),
                    F.struct(F.lit("control").alias("side"), F.col("control").alias("_cohort")),
                ),
                lambda s: s["_cohort"].isNotNull(),
            )
        ).alias("s"),
    ).select("event_id", "event_day", "pre_days", "post_days", "s.*")
    window = F.sequence(F.date_sub("event_day", F.col("pre_days")), F.date_add("event_day", F.col("post_days")))
    wanted_days = sides.withColumn("day", F.explode(window)).withColumn(
        "phase", F.when(F.col("day") < F.col("event_day"), "pre").otherwise("post")
    )
    days = wanted_days.join(daily.withColumnRenamed(cohort, "_cohort"), ["_cohort", "day"])
    ordinal = F.row_number().over(W.partitionBy("event_id", "side", "phase").orderBy("day")) - 1
    days = days.withColumn("_i", ordinal.cast("double"))

    def when(side: str, phase: str, c: str = "residual") -> Column:
        return F.when((F.col("side") == side) & (F.col("phase") == phase), F.col(c))

    folded = days.groupBy("event_id").agg(
        *[
            f(when(s, p)).alias(f"_{name}_{s}_{p}")
            for s in ("affected", "control")
            for p in ("pre", "post")
            for name, f in (("n", F.count), ("mean", F.avg))
        ],
        *[
            F.avg(when(s, p, c)).alias(f"_{c}_{s}_{p}")
            for s in ("affected", "control")
            for p in ("pre", "post")
            for c in ("actual", "expected")
        ],
        *[
            F.regr_slope(when(s, "pre"), when(s, "pre", "_i")).alias(f"_slope_{s}")
            for s in ("affected", "control")
        ],
        # At most the pre-event days of the two cohorts.
        F.collect_list(F.when(F.col("phase") == "pre", F.col("residual"))).alias("_before"),
    )
    zero = F.lit(0.0)
    joined = events.join(folded, "event_id", "left")
    has_control = F.col("control").isNotNull()

    def change(side: str) -> Column:
        return F.coalesce(F.col(f"_mean_{side}_post"), zero) - F.coalesce(F.col(f"_mean_{side}_pre"), zero)

    def enough(side: str) -> Column:
        return (F.coalesce(F.col(f"_n_{side}_pre"), F.lit(0)) >= MINIMUM_PERIODS) & (
            F.coalesce(F.col(f"_n_{side}_post"), F.lit(0)) >= MINIMUM_PERIODS
        )

    slope_gap = F.abs(F.coalesce("_slope_affected", zero) - F.coalesce("_slope_control", zero))
    measured = joined.withColumns(
        {
            "affected_change": change("affected"),
            "control_change": F.when(has_control, change("control")),
            "_scale": F.coalesce(array_robust_scale(F.col("_before")), zero),
        }
    ).withColumns(
        {
            "raw_effect": F.col("affected_change") - F.coalesce(F.col("control_change"), zero),
            "parallel_trend_score": F.when(
                has_control, F.greatest(zero, 1 - slope_gap / F.greatest(F.col("_scale"), F.lit(1.0)))
            ),
            "_enough": enough("affected") & (~has_control | enough("control")),
        }
    ).withColumns(
        {
            "business_impact_effect": F.col("raw_effect") * multiplier(polarity),
            "standardized_effect": F.when(
                F.col("_scale") > 0, F.abs("raw_effect") / F.col("_scale")
            ).otherwise(zero),
        }
    )
    effect, parallel = F.col("standardized_effect"), F.col("parallel_trend_score")
    direction = impact_direction(F.col("business_impact_effect"))
    wanted = F.coalesce(F.col("expected_direction"), F.lit("unknown"))
    status = (
        F.when(~F.col("_enough"), "insufficient")
        .when((wanted != "unknown") & (wanted != direction) & (effect >= CONTRADICTED_EFFECT), "contradicted")
        .when((effect >= SUPPORTED_EFFECT) & (~has_control | (parallel >= PARALLEL_MINIMUM)), "supported")
        .otherwise("weak")
    )
    confidence = (
        F.when(
            (F.col("status") == "supported") & has_control & (parallel >= PARALLEL_HIGH) & (effect >= HIGH_EFFECT),
            "high",
        )
        .when((F.col("status") == "insufficient") | (parallel < PARALLEL_MINIMUM), "low")
        .otherwise("medium")
    )

    def summary(side: str) -> Column:
        """Averages of a side without days are zero, as in the effect."""
        parts = [F.coalesce(F.col(f"_n_{side}_{p}"), F.lit(0)).alias(f"{p}_periods") for p in ("pre", "post")]
        for name, c in (("actual", "_actual"), ("expected", "_expected"), ("residual", "_mean")):
            parts += [F.coalesce(F.col(f"{c}_{side}_{p}"), zero).alias(f"{p}_{name}") for p in ("pre", "post")]
        return F.struct(*parts, change(side).alias("residual_change"), F.coalesce(F.col(f"_slope_{side}"), zero).alias("pre_trend_slope"))

    findings = F.array(
        F.when(~has_control, F.lit("no_control")),
        F.when(parallel < PARALLEL_MINIMUM, F.lit("pre_trends_differ")),
        F.when(~F.col("_enough"), F.lit("too_few_periods")),
    )
    return measured.withColumn("status", status).select(
        "event_id",
        "event_day",
        "affected",
        "control",
        F.when(has_control, "difference_in_differences").otherwise("pre_post").alias("method"),
        F.coalesce("_n_affected_pre", F.lit(0)).alias("pre_periods"),
        F.coalesce("_n_affected_post", F.lit(0)).alias("post_periods"),
        "affected_change",
        "control_change",
        "raw_effect",
        "business_impact_effect",
        direction.alias("impact_direction"),
        "standardized_effect",
        "parallel_trend_score",
        "status",
        confidence.alias("confidence"),
        summary("affected").alias("affected_summary"),
        F.when(has_control, summary("control")).alias("control_summary"),
        F.filter(findings, lambda x: x.isNotNull()).alias("diagnostics"),
    )
