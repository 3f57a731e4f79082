"""A loaded dataset: its quality gate, defaults and the analyses that follow from them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from variscope.operators import quality as Q
from variscope.operators import semantics as M
from variscope.operators import timeseries as S
from variscope.operators.cohort import CohortSpec, Predicate, time_window_filter
from variscope.plans.investigation import Investigation


class Dataset:
    """Quality report, time fields, metric defaults and analyses of one table.

    What is read to the driver is schema-sized: one profile row per column, one defaults row.
    """

    def __init__(self, df: DataFrame, as_of: date, row_idx: str | None = None, freshness_days: int | None = None):
        self.df = df
        self.row_idx = row_idx
        columns = [c for c in df.columns if c not in (row_idx, "_present_fields")]
        self.profiler = Q.Profiler(df, Q.QualityOptions(as_of, freshness_days=freshness_days), columns)

    @cached_property
    def columns(self) -> list[Row]:
        """Name, role and distinct count of every column, in name order."""
        return self.profiler.profile.select("column", "analysis_role", "distinct_count").orderBy("column").collect()

    def _with_role(self, role: str) -> list[Row]:
        return [c for c in self.columns if c["analysis_role"] == role]

    @property
    def measures(self) -> list[str]:
        return [c["column"] for c in self._with_role("measure")]

    @cached_property
    def time_fields(self) -> DataFrame:
        """Columns that read as time, the most certain first."""
        return Q.detect_time_fields(self.df, self.profiler.columns).orderBy(
            F.desc("confidence"), F.desc("distinct_periods"), "field"
        )

    @cached_property
    def time_names(self) -> list[str]:
        return [r["field"] for r in self.time_fields.select("field").collect()]

    @property
    def dimensions(self) -> list[str]:
        """Dimensions that may explain a variance: time fields describe it and are left out."""
        return [c["column"] for c in self._with_role("dimension") if c["column"] not in self.time_names]

    @cached_property
    def defaults(self) -> Row:
        """Measures, polarity, aggregation and fiscal start to begin with, for the first metric."""
        rows = self.df
        if "metric_id" not in rows.columns:
            rows = rows.withColumn("metric_id", F.lit("metric"))
        idx = self.row_idx or "_idx"
        if self.row_idx is None:
            # Without a row number the metadata of a metric should be constant; any row serves.
            rows = rows.withColumn(idx, F.lit(0))
        return M.infer_defaults(rows, self.measures, idx).orderBy("metric_id").first()

    def issues(self) -> DataFrame:
        return Q.quality_issues(self.profiler)

    def scores(self) -> DataFrame:
        return Q.quality_dimensions(self.profiler)

    def correlations(self, measures: Sequence[str] | None = None, k: int | None = None) -> DataFrame | None:
        """Strong correlations of the given measures, or of all; ``k`` limits the report."""
        names = self.measures if measures is None else list(measures)
        return Q.correlations(self.df, names, k) if len(names) > 1 else None

    def dependencies(self, columns: Sequence[str] | None = None, k: int | None = None) -> DataFrame | None:
        """Dependencies among the given columns, or among all dimensions of few values."""
        few = [c["column"] for c in self._with_role("dimension") if c["distinct_count"] <= Q.DEPENDENCY_VALUES]
        few = few if columns is None else list(columns)
        return Q.functional_dependencies(self.df, few, k) if len(few) > 1 else None

    def missing_patterns(self) -> DataFrame:
        return Q.missing_patterns(self.df, self.profiler.columns)

    def investigate(
        self, time_field: str | None = None, window: str = "all", predicates: Sequence[Predicate] = (), **changes
    ) -> Investigation:
        """The investigation of a cohort inside a time window, with the defaults of the metric."""
        d = self.defaults
        settings = {
            "actual": d["actual_key"],
            "expected": d["expected_key"] or None,
            "polarity": d["metric_polarity"],
            "aggregation": d["aggregation"],
            **changes,
        }
        spec = CohortSpec(tuple(self.dimensions), predicates=tuple(predicates), time_field=time_field, **settings)
        rows = self.df
        if time_field is not None:
            rows = time_window_filter(rows, time_field, window, d["fiscal_year_start_month"])
        return Investigation(rows, spec)

    def series(
        self, time_field: str, grain: str = "month", window: str = "all", predicates: Sequence[Predicate] = (), **changes
    ) -> tuple[DataFrame, S.SeriesSpec]:
        """Points of the cohort and their specification. Baselines and anomaly scores use the whole
        history; the window only chooses the points shown."""
        d = self.defaults
        settings = {
            "actual": d["actual_key"],
            "expected": d["expected_key"] or None,
            "polarity": d["metric_polarity"],
            "aggregation": d["aggregation"],
            "fiscal_start": d["fiscal_year_start_month"],
            **changes,
        }
        spec = S.SeriesSpec(time_field=time_field, grain=grain, predicates=tuple(predicates), **settings)
        points = S.finance_points(self.df, spec)
        return S.visible_points(points, window, spec.fiscal_start), spec
