"""Cohorts: predicates, time windows, period-end selection and search."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variscope.functions.calendar import window_cutoff
from variscope.functions.timeparse import date_of, time_of
from variscope.functions.values import all_of, category_equals, plain_text

Predicate = tuple[str, str]


@dataclass(frozen=True)
class CohortSpec:
    """What to investigate: measures, dimensions, cohort and the rules of the metric."""

    dimensions: tuple[str, ...]
    actual: str
    expected: str | None = None
    predicates: tuple[Predicate, ...] = ()
    polarity: str = "higher_is_better"
    aggregation: str = "sum"
    time_field: str | None = None

    @property
    def open_dimensions(self) -> list[str]:
        fixed = {d for d, _ in self.predicates}
        return [d for d in self.dimensions if d not in fixed]

    @property
    def basis(self) -> str:
        return {
            "sum": "total",
            "average": "support_weighted_average",
            "period_end": "latest_period_total",
        }[self.aggregation]


def drill(spec: CohortSpec, following: Sequence[Predicate]) -> CohortSpec:
    """The child cohort: a predicate on the same dimension is replaced, others are appended."""
    replaced = {d for d, _ in following}
    kept = tuple(p for p in spec.predicates if p[0] not in replaced)
    return replace(spec, predicates=kept + tuple(following))


def apply_predicates(df: DataFrame, predicates: Sequence[Predicate]) -> DataFrame:
    """Rows that satisfy every ``(dimension, value)`` equality; order does not matter."""
    if not predicates:
        return df
    return df.filter(all_of(category_equals(df, d, v) for d, v in sorted(predicates)))


def latest_day(df: DataFrame, time_field: str) -> date | None:
    """The latest parsed day, one aggregate over one column."""
    return df.agg(F.max(date_of(df, time_field)).alias("d")).first()["d"]


def time_window_filter(df: DataFrame, time_field: str, window: str, fiscal_start: int = 1) -> DataFrame:
    """Rows inside a named window that ends at the latest parsed day.

    Unparsed rows drop out, unless nothing parses (then every row stays). The cutoff is a literal,
    so on a date column it reaches the parquet filters and partition pruning.
    """
    if window == "all":
        return df
    latest = latest_day(df, time_field)
    if latest is None:
        return df
    return df.filter(date_of(df, time_field) >= window_cutoff(F.lit(latest), window, fiscal_start))


def period_end_rows(df: DataFrame, time_field: str | None) -> DataFrame:
    """Rows at the latest timestamp, plus ``fallback`` and ``population_date``."""
    latest = None
    if time_field is not None:
        latest = df.agg(F.max(time_of(df, time_field)).alias("t")).first()["t"]
    if latest is None:
        return df.withColumns(
            {"fallback": F.lit(True), "population_date": F.lit(None).cast("date")}
        )
    return df.filter(time_of(df, time_field) == F.lit(latest)).withColumns(
        {"fallback": F.lit(False), "population_date": F.lit(latest).cast("date")}
    )


def scope_filter(
    df: DataFrame,
    scope: str,
    measure: str,
    time_field: str,
    fiscal_year_field: str,
    allowed: Sequence[str] = (),
    where: Predicate | None = None,
) -> DataFrame:
    """Payments scope: the measure is present, within ``24m`` or ``current_fy`` of the latest row,
    and at most one equality on an allowed field (others are ignored)."""
    conditions: list[Column] = [F.col(measure).isNotNull()]
    if scope in ("24m", "current_fy"):
        top = df.agg(
            F.max(date_of(df, time_field)).alias("d"),
            F.max_by(fiscal_year_field, date_of(df, time_field)).alias("fy"),
        ).first()
        if scope == "24m" and top["d"] is not None:
            conditions.append(date_of(df, time_field) >= window_cutoff(F.lit(top["d"]), "24m"))
        if scope == "current_fy" and top["fy"] is not None:
            conditions.append(F.col(fiscal_year_field) == F.lit(top["fy"]))
    if where is not None and where[0] in allowed:
        conditions.append(F.col(where[0]) == where[1])
    return df.filter(all_of(conditions))


def hierarchy_path_filter(df: DataFrame, path: Sequence[Predicate], levels: Sequence[str]) -> DataFrame:
    """Equalities of a drill path, for the fields that belong to the hierarchy."""
    steps = [F.col(f) == v for f, v in path if f in levels]
    return df.filter(all_of(steps)) if steps else df


def search_preview(df: DataFrame, query: str, order_by: Sequence[str], columns: int = 14, rows: int = 100) -> DataFrame:
    """First ``rows`` rows, in a stated order, with the query text in any column; the first ``columns`` are shown."""
    shown = df.columns[:columns]
    text = F.concat_ws("\x1f", *[plain_text(df, c) for c in df.columns])
    return (
        df.filter(F.lower(text).contains(query.strip().lower()))
        .select(*shown)
        .orderBy(*order_by)
        .limit(rows)
    )
