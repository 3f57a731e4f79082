"""Variance of a cohort and how far each dimension, category and combination explains it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variscope.functions.quantiles import median_value, rank_within, robust_scale
from variscope.functions.timeparse import time_of
from variscope.functions.values import (
    canonical_category,
    clamp,
    finite_number,
    impact_direction,
    multiplier,
    quoted,
    ratio,
    variance_pct,
)
from variscope.operators.cohort import CohortSpec, apply_predicates
from variscope.session import shared_table

# Fixed values of the driver score.
MINIMUM_ROWS = 20
MINIMUM_SUPPORT = 0.015
SCORE_WEIGHTS = {"impact": 0.5, "surprise": 0.22, "concentration": 0.18, "support_quality": 0.1}
FREE_CATEGORIES, CATEGORY_HALF_LIFE = 12, 35
CANDIDATE_DIMENSIONS, CANDIDATES_PER_DIMENSION = 8, 2
TOP_INTERACTIONS = 12


class Population:
    """The rows of one cohort that carry valid measures, and the one-row statistics of the cohort.

    The statistics are single numbers, read once and used as literals in the later plans. The
    measured rows are scanned by every step (scale, contributions, combinations), so they are stored
    by columns below the shared folder: the joins behind the fact run once, and a step reads only the
    columns it needs, however many rows there are.
    """

    def __init__(self, df: DataFrame, spec: CohortSpec, within: Population | None = None):
        """``within`` is a population this one narrows: its stored rows are filtered further, so
        a drill-down does not run the joins behind the fact again."""
        self.within = within
        self.spec = spec
        self.names = (spec.actual, spec.expected)
        if within is None:
            self.filtered = apply_predicates(df, spec.predicates)
        else:
            added = [p for p in spec.predicates if p not in within.spec.predicates]
            self.filtered = apply_predicates(within.measured, added)
            self.names = ("actual", "expected" if spec.expected else None)

    def holds(self, child: CohortSpec) -> bool:
        """Whether a child cohort lies within these rows: predicates were only added, on dimensions the
        rows still carry. A period-end cohort has its own latest date and starts from the source."""
        added = {d for d, _ in set(child.predicates) - set(self.spec.predicates)}
        only_added = set(self.spec.predicates) <= set(child.predicates)
        return self.spec.aggregation != "period_end" and only_added and added <= set(self.spec.open_dimensions)

    @cached_property
    def period_end(self):
        """The latest timestamp when the metric is a period-end balance, else None."""
        spec = self.spec
        if spec.aggregation != "period_end" or spec.time_field is None:
            return None
        t = time_of(self.filtered, spec.time_field)
        return self.filtered.agg(F.max(t).alias("t")).first()["t"]

    @property
    def fallback(self) -> bool:
        return self.spec.aggregation == "period_end" and self.period_end is None

    @property
    def rows(self) -> DataFrame:
        """Cohort rows: categories, ``actual`` and, if compared, ``expected``; unusable measures are null."""
        spec, source = self.spec, self.filtered
        if self.period_end is not None:
            source = source.filter(time_of(source, spec.time_field) == F.lit(self.period_end))
        actual, expected = self.names
        measures = [finite_number(source, actual).alias("actual")]
        if expected is not None:
            measures.append(finite_number(source, expected).alias("expected"))
        dims = [canonical_category(source, d).alias(d) for d in spec.open_dimensions]
        return source.select(*dims, *measures)

    def valid(self, rows: DataFrame) -> DataFrame:
        """The rows that count, with ``expected`` and ``residual``."""
        if self.baseline is not None:
            rows = rows.withColumn("expected", self.baseline)
        return rows.dropna(subset=["actual", "expected"]).withColumn(
            "residual", F.col("actual") - F.col("expected")
        )

    @cached_property
    def measured(self) -> DataFrame:
        # The rows of a population within another one are a filter of stored rows.
        return self.rows if self.within is not None else shared_table(self.rows, "measured")

    def release(self) -> None:
        """Forget the stored rows; their files go when the application ends."""
        self.__dict__.pop("measured", None)

    @cached_property
    def row_count(self) -> int:
        """Rows of the cohort; only a period-end population is smaller than its cohort."""
        return (self.measured if self.period_end is None else self.filtered).count()

    @cached_property
    def baseline(self) -> Column | None:
        """The median of the actuals when the cohort has no comparison column. For a decimal measure
        it stays decimal (two more digits hold the mean of two values), so sums remain exact."""
        if self.spec.expected is not None:
            return None
        value = median_value(self.measured, "actual") or 0.0
        dtype = self.measured.schema["actual"].dataType
        if isinstance(dtype, T.DecimalType):
            return F.lit(value).cast(T.DecimalType(dtype.precision, dtype.scale + 2))
        return F.lit(value)

    @cached_property
    def prepared(self) -> DataFrame:
        return self.valid(self.measured)

    @cached_property
    def scale(self) -> float:
        return robust_scale(self.prepared, "residual").scale

    @cached_property
    def stats(self) -> Row:
        """One row of totals, the denominators of every later step."""
        return self.prepared.agg(
            F.count("*").alias("n"),
            F.sum("actual").cast("double").alias("actual"),
            F.sum("expected").cast("double").alias("expected"),
            F.sum("residual").cast("double").alias("residual"),
            F.sum(F.abs("residual")).cast("double").alias("abs_residual"),
        ).first()

    @property
    def minimum_support(self) -> float:
        return max(float(MINIMUM_ROWS), self.stats["n"] * MINIMUM_SUPPORT)


def scope_totals(pop: Population) -> DataFrame:
    """One row: totals, variance, impact, coverage and the anomaly score of the cohort."""
    spec = pop.spec
    fold = F.avg if spec.aggregation == "average" else F.sum

    def total(c: Column) -> Column:
        # Exact decimals are averaged as doubles, sums are cast once they are complete.
        c = c.cast("double") if spec.aggregation == "average" else c
        return F.coalesce(fold(c).cast("double"), F.lit(0.0))

    totals = pop.prepared.agg(
        F.count("*").alias("valid_row_count"),
        total(F.col("actual")).alias("actual"),
        total(F.col("expected")).alias("expected"),
        total(F.col("residual")).alias("variance"),
        F.coalesce(F.avg(F.col("residual").cast("double")), F.lit(0.0)).alias("_mean_residual"),
    ).withColumn("row_count", F.lit(pop.row_count).cast("bigint"))
    scale = F.lit(float(pop.scale))
    return totals.select(
        "row_count",
        "valid_row_count",
        (F.col("row_count") - F.col("valid_row_count")).alias("excluded_measure_rows"),
        "actual",
        "expected",
        "variance",
        (F.col("variance") * multiplier(spec.polarity)).alias("business_impact"),
        impact_direction(F.col("variance") * multiplier(spec.polarity)).alias("impact_direction"),
        variance_pct(F.col("variance"), F.col("expected")).alias("variance_pct"),
        F.when(
            F.col("valid_row_count") > 0,
            F.abs("_mean_residual") / F.greatest(scale, F.lit(1e-9)),
        )
        .otherwise(F.lit(0.0))
        .alias("anomaly_score"),
        scale.alias("residual_scale"),
        F.lit("target" if spec.expected else "robust-median").alias("baseline_method"),
        F.lit(spec.basis).alias("attribution_basis"),
        F.lit(not pop.fallback).alias("attribution_reconciles"),
        F.lit(pop.period_end).cast("date").alias("population_date"),
    )


def scope_warnings(totals: DataFrame, spec: CohortSpec) -> DataFrame:
    """The warning codes that hold for a scope, one row each."""
    rules = [
        ("no_comparison_measure", F.lit(spec.expected is None)),
        ("lower_is_better", F.lit(spec.polarity == "lower_is_better")),
        ("support_weighted_average", F.lit(spec.aggregation == "average")),
        ("period_end_fallback", ~F.col("attribution_reconciles")),
        ("period_end_population", F.col("population_date").isNotNull()),
        ("rows_excluded", F.col("excluded_measure_rows") > 0),
        ("no_valid_rows", F.col("valid_row_count") == 0),
        ("zero_comparison", (F.col("expected") == 0) & (F.col("valid_row_count") > 0)),
    ]
    codes = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())
    return totals.select(F.explode(codes).alias("warning"))


def group_dimension(pop: Population, dimensions: Sequence[str] | None = None) -> DataFrame:
    """Contribution of every category of every open dimension, from one scan.

    Rows are unpivoted and pre-aggregated in the same stage, so what is shuffled is one row per
    (dimension, category) and task, never the fact.
    """
    spec = pop.spec
    dims = list(dimensions or spec.open_dimensions)
    n = max(pop.stats["n"], 1)
    groups = (
        pop.prepared.select("actual", "expected", *[quoted(d) for d in dims])
        .unpivot(["actual", "expected"], [quoted(d) for d in dims], "dimension", "value")
        .groupBy("dimension", "value")
        .agg(
            F.count("*").alias("count"),
            F.sum("actual").alias("_a"),
            F.sum("expected").alias("_e"),
        )
    )
    # One row a category, stored: parts of a plan that run side by side would each fill a cache for themselves.
    groups = shared_table(groups, "categories")
    average = spec.aggregation == "average"
    per = F.col("count") if average else F.lit(1)
    residual = (F.col("_a") - F.col("_e")).cast("double")
    support = F.col("count") / F.lit(n)
    m = multiplier(spec.polarity)
    shaped = groups.select(
        "dimension",
        "value",
        "count",
        support.alias("support"),
        (F.col("_a").cast("double") / per).alias("actual"),
        (F.col("_e").cast("double") / per).alias("expected"),
        (residual / per).alias("variance"),
        (residual / per * (support if average else F.lit(1.0)) * m).alias("business_impact"),
        (residual / F.col("count")).alias("variance_per_row"),
        (residual / F.col("count") * m).alias("business_impact_per_row"),
        (F.abs(residual / F.col("count")) / F.greatest(F.lit(float(pop.scale)), F.lit(1e-9))).alias(
            "standardized_residual"
        ),
    ).withColumn(
        "surprise",
        F.least(F.lit(1.0), F.col("standardized_residual") / 3)
        * F.least(F.lit(1.0), F.sqrt(F.col("support") / 0.05)),
    )
    # One row per dimension: bounded by the number of dimensions in the spec.
    gross = shaped.groupBy("dimension").agg(F.sum(F.abs("business_impact")).alias("_gross"))
    return (
        shaped.join(F.broadcast(gross), "dimension")
        .withColumn(
            "share_of_abs_variance",
            F.abs("business_impact")
            / F.when(F.col("_gross") == 0, F.lit(1.0)).otherwise(F.col("_gross")),
        )
        .withColumn("impact_direction", impact_direction(F.col("business_impact")))
        .withColumn("attribution_basis", F.lit(spec.basis))
        .drop("_gross")
    )


def _leading(contributions: DataFrame, k: int, condition: Column | None = None) -> DataFrame:
    """The first ``k`` categories of each dimension by |impact|. The rank filter is pushed below
    the shuffle as a group limit, so each task ships at most ``k`` rows per dimension."""
    rows = contributions if condition is None else contributions.filter(condition)
    order = W.partitionBy("dimension").orderBy(F.abs("business_impact").desc(), F.col("value"))
    return rows.withColumn("category_rank", F.row_number().over(order)).filter(
        F.col("category_rank") <= k
    )


def score_dimensions(contributions: DataFrame, pop: Population) -> DataFrame:
    """One row per dimension with more than one category: the 0-100 driver score and its parts."""
    stats, average = pop.stats, pop.spec.aggregation == "average"
    row_gross = stats["abs_residual"] or 0.0
    if average:
        row_gross = row_gross / max(stats["n"], 1)
    supported = F.col("count") >= pop.minimum_support
    size = F.abs("business_impact")
    parts = contributions.groupBy("dimension").agg(
        F.count("*").alias("distinct_count"),
        F.sum(size).alias("_grouped"),
        F.sum(F.col("surprise") * F.col("share_of_abs_variance")).alias("surprise"),
        F.coalesce(F.sum(F.when(supported, size)), F.lit(0.0)).alias("_supported"),
    )
    concentration = (
        _leading(contributions, 3)
        .groupBy("dimension")
        .agg(F.sum("share_of_abs_variance").alias("concentration"))
    )
    top = top_category(contributions, pop.minimum_support).select(
        "dimension",
        F.col("value").alias("top_category"),
        F.col("business_impact").alias("top_category_impact"),
    )
    scored = (
        parts.join(F.broadcast(concentration), "dimension")
        .join(F.broadcast(top), "dimension")
        .filter("distinct_count > 1")
        .withColumn("impact", F.least(F.lit(1.0), F.col("_grouped") / F.lit(row_gross or 1.0)))
        .withColumn(
            "support_quality", F.coalesce(ratio(F.col("_supported"), F.col("_grouped")), F.lit(0.0))
        )
        .withColumn(
            "cardinality_penalty",
            1 / (1 + F.greatest(F.lit(0), F.col("distinct_count") - FREE_CATEGORIES) / CATEGORY_HALF_LIFE),
        )
    )
    weighted = sum((F.col(c) * w for c, w in SCORE_WEIGHTS.items()), F.lit(0.0))
    return scored.select(
        "dimension",
        clamp(100 * weighted * F.col("cardinality_penalty")).alias("score"),
        "impact",
        "surprise",
        "concentration",
        "support_quality",
        "cardinality_penalty",
        "distinct_count",
        "top_category",
        "top_category_impact",
    )


def top_dimensions(scores: DataFrame, k: int | None = None) -> DataFrame:
    """Dimensions by score, the name breaking ties."""
    ordered = scores.orderBy(F.desc("score"), "dimension")
    return ordered if k is None else ordered.limit(k)


def top_category(contributions: DataFrame, minimum_support: float) -> DataFrame:
    """Per dimension the leading category with enough rows, else the leading one."""
    rank = F.struct(
        (F.col("count") >= minimum_support).alias("supported"),
        F.abs("business_impact").alias("size"),
    )
    first = W.partitionBy("dimension").orderBy(rank.desc(), F.col("value"))
    return (
        contributions.withColumn("_rank", F.row_number().over(first)).filter("_rank <= 1").drop("_rank")
    )


def top_contributions(contributions: DataFrame, k: int) -> DataFrame:
    """The ``k`` largest movements over all dimensions."""
    return contributions.orderBy(
        F.abs("business_impact").desc(), "dimension", "value"
    ).limit(k)


def category_ranks(contributions: DataFrame) -> DataFrame:
    """Every category with its rank by |impact| inside its dimension and the share its three
    leading categories hold. A dimension may have any number of categories, so they are dealt to ranges
    of their order, those of equal impact by value, and no task sorts a whole dimension."""
    ranked = rank_within(
        contributions, ["dimension"], F.abs("business_impact"), ["value"], "category_rank"
    )
    top3 = (
        _leading(contributions, 3)
        .groupBy("dimension")
        .agg(F.sum("share_of_abs_variance").alias("concentration_top3"))
    )
    return ranked.join(F.broadcast(top3), "dimension")


def parent_comparison(parent: DataFrame, child: DataFrame) -> DataFrame:
    """How the ranks and scores of the dimensions move from a parent cohort to a child cohort."""

    def ranked(scores: DataFrame, side: str) -> DataFrame:
        # One row per dimension of the specification.
        order = W.orderBy(F.desc("score"), F.col("dimension"))
        return scores.select(
            "dimension",
            F.col("score").alias(f"{side}_score"),
            F.row_number().over(order).alias(f"{side}_rank"),
        )

    return (
        ranked(parent, "parent")
        .join(ranked(child, "child"), "dimension", "left")
        .withColumn("rank_gain", F.col("parent_rank") - F.col("child_rank"))
        .withColumn("score_change", F.col("child_score") - F.col("parent_score"))
    )


def interaction_candidates(contributions: DataFrame, best: Sequence[str]) -> DataFrame:
    """At most 16 rows: two well-supported categories of each of the (at most eight) best dimensions."""
    best = list(best)[:CANDIDATE_DIMENSIONS]
    enough = (F.col("support") >= MINIMUM_SUPPORT) & (F.col("count") >= MINIMUM_ROWS)
    leading = _leading(contributions, CANDIDATES_PER_DIMENSION, enough & F.col("dimension").isin(best))
    rank = F.array_position(F.array(*[F.lit(d) for d in best]), F.col("dimension"))
    return leading.select("dimension", "value", rank.alias("dimension_rank"), "category_rank")


def find_interactions(
    pop: Population, candidates: Sequence[Row], k: int = TOP_INTERACTIONS
) -> DataFrame:
    """The strongest two- and three-way combinations of the candidate categories.

    Each row is reduced to a bit mask of the candidates it matches and rows are aggregated by mask
    in one scan. A mask sets at most one bit per dimension, so there are at most 3^8 masks however
    large the fact is, and every combination is a subset of some mask.
    """
    spec, stats = pop.spec, pop.stats
    ordered = sorted(candidates, key=lambda r: (r["dimension_rank"], r["category_rank"]))
    bits = F.lit(0).cast("bigint")
    for i, c in enumerate(ordered):
        bits = bits + F.when(F.col(quoted(c["dimension"])) == c["value"], 1 << i).otherwise(0)
    masks = (
        pop.prepared.select(bits.alias("mask"), "actual", "expected")
        .groupBy("mask")
        .agg(F.count("*").alias("count"), F.sum("actual").alias("_a"), F.sum("expected").alias("_e"))
    )
    slots = F.filter(
        F.array(*[F.lit(i) for i in range(len(ordered))]) if ordered else F.array().cast("array<int>"),
        lambda i: F.getbit("mask", i) == 1,
    )
    pairs = F.flatten(
        F.transform("_on", lambda i: F.transform(F.filter("_on", lambda j: j > i), lambda j: F.array(i, j)))
    )
    triples = F.flatten(
        F.transform(
            "_pairs",
            lambda p: F.transform(
                F.filter("_on", lambda x: x > F.element_at(p, 2)), lambda x: F.array_append(p, x)
            ),
        )
    )
    combos = (
        masks.withColumn("_on", slots)
        .withColumn("_pairs", pairs)
        .withColumn("combo", F.explode(F.concat("_pairs", triples)))
        .groupBy("combo")
        .agg(F.sum("count").alias("count"), F.sum("_a").alias("_a"), F.sum("_e").alias("_e"))
        .filter(F.col("count") >= pop.minimum_support)
    )
    n = max(stats["n"], 1)
    mean_abs = ((stats["abs_residual"] or 0.0) / n) or 1.0
    average = spec.aggregation == "average"
    per = F.col("count") if average else F.lit(1)
    residual = (F.col("_a") - F.col("_e")).cast("double")
    support = F.col("count") / F.lit(n)
    impact = residual / per * (support if average else F.lit(1.0)) * multiplier(spec.polarity)
    lift = F.abs(residual / F.col("count")) / F.lit(mean_abs)
    names = F.array(*[F.lit(f"{c['dimension']}={c['value']}") for c in ordered]) if ordered else F.array()
    return (
        combos.select(
            F.array_join(
                F.array_sort(F.transform("combo", lambda i: F.element_at(names, i + 1))), "|"
            ).alias("segment"),
            F.size("combo").alias("ways"),
            "count",
            support.alias("support"),
            (F.col("_a").cast("double") / per).alias("actual"),
            (F.col("_e").cast("double") / per).alias("expected"),
            (residual / per).alias("variance"),
            impact.alias("business_impact"),
            impact_direction(impact).alias("impact_direction"),
            (residual / F.col("count")).alias("variance_per_row"),
            lift.alias("lift"),
            (F.abs(impact) * F.sqrt(support) * F.log1p(lift)).alias("score"),
        )
        .orderBy(F.desc("score"), "segment")
        .limit(k)
    )


def cohort_compare(pop: Population, dimension: str, first: str, second: str) -> DataFrame:
    """Two categories under the same base cohort, side by side, from one pass."""
    spec = pop.spec
    fold = F.avg if spec.aggregation == "average" else F.sum
    both = (
        pop.valid(pop.rows).filter(F.col(quoted(dimension)).isin(first, second))
        .groupBy(F.col(quoted(dimension)).alias("value"))
        .agg(
            F.count("*").alias("count"),
            fold("actual").cast("double").alias("actual"),
            fold("expected").cast("double").alias("expected"),
            (fold("residual").cast("double") * multiplier(spec.polarity)).alias("business_impact"),
        )
    )
    # Two rows at most: a window over them cannot grow.
    best = W.orderBy(F.desc("business_impact"), (F.col("value") != first).cast("int"))
    return both.withColumn("better", F.row_number().over(best) == 1)
