"""The payments workload: source summary, monthly benchmark, top categories, category matrix and
drill-down levels. Each is one or two grouped scans whatever the number of dimensions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from variscope.functions.values import clamp, quoted, ratio, variance_pct
from variscope.operators.cohort import Predicate, hierarchy_path_filter
from variscope.operators.timeseries import (
    SeriesSpec,
    materiality_alert,
    rolling_anomaly_score,
    rolling_median_baseline,
    trend,
    with_variance,
)
from variscope.session import shared_table

# Fixed values of the workload.
OTHER = "Other categories"
TOP_CATEGORIES, TOP_CHILDREN, TOP_CHILDREN_FLAT = 8, 7, 9
OTHER_THRESHOLD = 0.005
SHARE_HISTORY, SHARE_MINIMUM = 6, 3
LARGE_SOURCE_ROWS = 1_000_000

BENCHMARK = SeriesSpec("actual", "period_start", polarity="lower_is_better")


@dataclass(frozen=True)
class PaymentFields:
    amount: str = "dollar_amount"
    date: str = "transaction_date"
    fiscal_year: str = "fiscal_year"
    fiscal_month: str = "fiscal_month_number"


FIELDS = PaymentFields()


def scan_payments(df: DataFrame, where: Column, by: str, k: int, fields: PaymentFields = FIELDS) -> DataFrame:
    """A scoped aggregate: filter, group, order by total and keep the first ``k``."""
    return (
        df.filter(where)
        .groupBy(by)
        .agg(F.sum(fields.amount).cast("double").alias("amount"), F.count("*").alias("transactions"))
        .orderBy(F.desc("amount"), by)
        .limit(k)
    )


def source_summary(df: DataFrame, fields: PaymentFields = FIELDS) -> DataFrame:
    """One row: rows with an amount, total, first and last date and the latest fiscal year."""
    return df.agg(
        F.count(fields.amount).alias("row_count"),
        F.sum(fields.amount).cast("double").alias("total_amount"),
        F.min(fields.date).alias("min_date"),
        F.max(fields.date).alias("max_date"),
        F.max_by(fields.fiscal_year, fields.date).alias("max_fiscal_year"),
    )


def source_health(
    df: DataFrame, dimensions: Sequence[str], lead: str, minimum_rows: int = LARGE_SOURCE_ROWS,
    fields: PaymentFields = FIELDS,
) -> DataFrame:
    """Assertions on a source as rows ``(check, passed, value)``."""
    missing = [d for d in dimensions if d not in df.columns]
    period = F.col(fields.fiscal_year).isNotNull() & F.col(fields.fiscal_month).isNotNull() & F.col(
        fields.date
    ).isNotNull() & F.col(fields.amount).isNotNull()
    totals = df.agg(
        F.count(fields.amount).cast("double").alias("rows"),
        F.count(fields.date).cast("double").alias("dated"),
        F.count_if(period).cast("double").alias("monthly"),
        F.count(F.when(F.col(fields.amount).isNotNull(), F.col(lead))).cast("double").alias("led"),
        F.sum(F.when(period, F.col(fields.amount))).cast("double").alias("total"),
    )
    checks = [
        ("minimum_rows", F.col("rows") >= minimum_rows, F.col("rows")),
        ("required_columns", F.lit(not missing), F.lit(float(len(missing)))),
        ("latest_row", F.col("dated") > 0, F.col("dated")),
        ("monthly_aggregate", F.col("monthly") > 0, F.col("monthly")),
        ("leading_dimension", F.col("led") > 0, F.col("led")),
        ("finite_total", F.col("total").isNotNull() & ~F.isnan("total"), F.col("total")),
    ]
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("check"), F.coalesce(p, F.lit(False)).alias("passed"), v.alias("value"))
            for n, p, v in checks
        ]
    )
    return totals.select(F.inline(rows))


def _dated(df: DataFrame, fields: PaymentFields) -> DataFrame:
    return df.filter(
        F.col(fields.amount).isNotNull()
        & F.col(fields.fiscal_year).isNotNull()
        & F.col(fields.fiscal_month).isNotNull()
        & F.col(fields.date).isNotNull()
    )


def _key(fields: PaymentFields) -> Column:
    return F.concat(
        F.col(fields.fiscal_year).cast("string"),
        F.lit("-"),
        F.lpad(F.col(fields.fiscal_month).cast("string"), 2, "0"),
    )


def monthly_totals(df: DataFrame, fields: PaymentFields = FIELDS) -> DataFrame:
    """Total, count and date span of each fiscal month."""
    return (
        _dated(df, fields)
        .groupBy(fields.fiscal_year, fields.fiscal_month)
        .agg(
            F.min(fields.date).cast("date").alias("period_start"),
            F.max(fields.date).cast("date").alias("period_end"),
            F.sum(fields.amount).cast("double").alias("amount"),
            F.count("*").alias("transactions"),
        )
        .withColumn("key", _key(fields))
    )


def partial_period_proration(points: DataFrame, latest: Column) -> DataFrame:
    """Scale the expectation of the latest calendar month to its elapsed days."""
    days = F.dayofmonth(F.last_day("period_start"))
    partial = (F.trunc("period_start", "month") == F.trunc(latest, "month")) & (
        F.dayofmonth(latest) < days
    )
    return points.withColumns(
        {
            "expected": F.when(
                partial, F.col("expected") * (F.dayofmonth(latest) / days)
            ).otherwise(F.col("expected")),
            "partial_period": partial,
        }
    )


def monthly_benchmark(monthly: DataFrame) -> DataFrame:
    """Spend months against a six-month rolling median. Runs over months, not over payments."""
    spec = BENCHMARK
    latest = F.max("period_end").over(W.partitionBy())
    months = (
        monthly.filter("amount <> 0")
        .withColumn("latest_day", latest)
        .withColumnRenamed("amount", "actual")
    )
    points = partial_period_proration(rolling_median_baseline(months, spec), F.col("latest_day"))
    points = points.withColumn("_difference", F.col("actual") - F.col("expected"))
    return materiality_alert(rolling_anomaly_score(with_variance(points, spec), spec), spec)


def benchmark_trend(benchmark: DataFrame) -> DataFrame:
    return trend(benchmark, BENCHMARK)


def trailing_12(benchmark: DataFrame) -> DataFrame:
    """Totals of the last twelve months, the current month and the most unfavorable month."""
    recency = F.row_number().over(W.orderBy(F.desc("period_start")))
    ranked = benchmark.withColumn("_recency", recency)
    recent = lambda c: F.sum(F.when(F.col("_recency") <= 12, F.col(c)))
    unfavorable = F.when(F.col("business_impact") < 0, F.struct("business_impact", "key"))
    return ranked.agg(
        recent("actual").alias("trailing_actual"),
        recent("business_impact").alias("trailing_impact"),
        F.max(F.when(F.col("_recency") == 1, F.col("key"))).alias("current_month"),
        F.max(F.when(F.col("_recency") == 1, F.col("business_impact"))).alias("current_impact"),
        F.min(unfavorable)["key"].alias("worst_month"),
        F.min(unfavorable)["business_impact"].alias("worst_impact"),
    )


def analysis_health(df: DataFrame, dimensions: Sequence[str], fields: PaymentFields = FIELDS) -> DataFrame:
    """0-100: months of history, scannable dimensions and source size."""
    usable = sum(d in df.columns for d in dimensions) / max(len(dimensions), 1)
    months = monthly_totals(df, fields).filter("amount <> 0")
    folded = months.agg(F.count("*").alias("months"), F.sum("transactions").alias("rows"))
    return folded.select(
        "months",
        "rows",
        clamp(
            45
            + F.least(F.lit(25), F.col("months"))
            + F.lit(20.0 * usable)
            + F.when(F.col("rows") >= LARGE_SOURCE_ROWS, 10).otherwise(5)
        ).alias("analysis_health"),
    )


def top_n_per_dimension(
    df: DataFrame, dimensions: Sequence[str], k: int = TOP_CATEGORIES, fields: PaymentFields = FIELDS
) -> DataFrame:
    """The ``k`` largest categories of every dimension, from one scan for all dimensions.

    The rank filter becomes a group limit below the shuffle, so a dimension with any number of
    categories sends at most ``k`` of them per task.
    """
    dated = F.when(
        F.col(fields.fiscal_year).isNotNull()
        & F.col(fields.fiscal_month).isNotNull()
        & F.col(fields.date).isNotNull(),
        F.col(fields.amount),
    )
    sums = (
        df.filter(F.col(fields.amount).isNotNull())
        .select(F.col(fields.amount).alias("_amount"), dated.alias("_dated"), *dimensions)
        .unpivot(["_amount", "_dated"], list(dimensions), "dimension", "value")
        .groupBy("dimension", "value")
        .agg(
            F.sum("_amount").cast("double").alias("amount"),
            F.count("*").alias("transactions"),
            F.sum("_dated").alias("_dated"),
        )
    )
    # The groups of any dimension add up to the scope total; one row per dimension.
    totals = sums.groupBy("dimension").agg(F.sum("_dated").cast("double").alias("_total"))
    # Missing values sort last instead of being filtered first, so that both reads of the groups
    # share one scan and one shuffle.
    order = W.partitionBy("dimension").orderBy(F.col("value").isNull(), F.desc("amount"), F.col("value"))
    return (
        sums.withColumn("rank", F.row_number().over(order))
        .filter((F.col("rank") <= k) & F.col("value").isNotNull())
        .join(F.broadcast(totals), "dimension")
        .withColumns(
            {
                "share_of_spend": F.coalesce(ratio(F.col("amount"), F.col("_total")), F.lit(0.0)),
                "average_transaction": F.col("amount") / F.col("transactions"),
            }
        )
        .drop("_dated", "_total")
    )


def concentration_rank(top: DataFrame) -> DataFrame:
    """Dimensions by the share of their leading category."""
    return top.filter("rank = 1").orderBy(F.desc("share_of_spend"), "dimension")


def _top_values(df: DataFrame, dimension: str, k: int, fields: PaymentFields) -> DataFrame:
    return (
        df.filter(F.col(dimension).isNotNull() & F.col(fields.amount).isNotNull())
        .groupBy(F.col(dimension).alias("category"))
        .agg(F.sum(fields.amount).alias("_amount"))
        .orderBy(F.desc("_amount"), "category")
        .limit(k)
    )


def matrix_densify(periods: DataFrame, top: DataFrame, sparse: DataFrame) -> DataFrame:
    """A cell for each of the ``k`` categories in every period, 0 where the source has none.

    The category list (``k`` entries) reaches each period as one array, so no product of two tables
    is planned and the sparse aggregates join by key.
    """
    names = top.agg(F.array_sort(F.collect_list("category"))).scalar()
    return (
        periods.withColumn("category", F.explode(names))
        .join(sparse, ["category", "key"], "left")
        .na.fill({"cell_actual": 0.0, "cell_transactions": 0})
    )


def rolling_median_share(cells: DataFrame) -> DataFrame:
    """Expected share of a category: the median of the previous six, else its overall share."""
    mine = W.partitionBy("category")
    before = mine.orderBy("period_start").rowsBetween(-SHARE_HISTORY, -1)
    share = ratio(F.col("cell_actual"), F.col("actual"))
    overall = F.coalesce(
        ratio(F.sum("cell_actual").over(mine), F.sum("actual").over(mine)), F.lit(0.0)
    )
    return (
        cells.withColumn("share", share)
        .withColumn(
            "expected_share",
            F.when(
                F.count("share").over(before) >= SHARE_MINIMUM, F.percentile("share", F.lit(0.5)).over(before)
            ).otherwise(overall),
        )
    )


def dimension_matrix(
    df: DataFrame, dimension: str, k: int = TOP_CATEGORIES, fields: PaymentFields = FIELDS
) -> DataFrame:
    """Category x period cells that add up to the monthly benchmark, with an exact residual row."""
    periods = monthly_benchmark(monthly_totals(df, fields)).select(
        "key", "period_start", "actual", "expected", "transactions", "partial_period"
    )
    top = _top_values(df, dimension, k, fields)
    sparse = (
        _dated(df, fields)
        .withColumnRenamed(dimension, "category")
        .join(F.broadcast(top.select("category")), "category", "left_semi")
        .groupBy("category", fields.fiscal_year, fields.fiscal_month)
        .agg(
            F.sum(fields.amount).cast("double").alias("cell_actual"),
            F.count("*").alias("cell_transactions"),
        )
        .select("category", _key(fields).alias("key"), "cell_actual", "cell_transactions")
    )
    dense = rolling_median_share(matrix_densify(periods, top, sparse))
    named = dense.select(
        "category",
        "key",
        "period_start",
        "partial_period",
        F.col("cell_actual").alias("cell_actual"),
        (F.col("expected") * F.col("expected_share")).alias("cell_expected"),
        "cell_transactions",
        F.col("actual").alias("_p_actual"),
        F.col("expected").alias("_p_expected"),
        F.col("transactions").alias("_p_transactions"),
    )
    residual = named.groupBy("key", "period_start", "partial_period").agg(
        (F.max("_p_actual") - F.sum("cell_actual")).alias("cell_actual"),
        (F.max("_p_expected") - F.sum("cell_expected")).alias("cell_expected"),
        F.greatest(F.lit(0), F.max("_p_transactions") - F.sum("cell_transactions")).alias("cell_transactions"),
    ).withColumn("category", F.lit(OTHER))
    cells = named.drop("_p_actual", "_p_expected", "_p_transactions").unionByName(residual)
    variance = F.col("cell_actual") - F.col("cell_expected")
    return cells.select(
        "category",
        "key",
        "period_start",
        "partial_period",
        F.col("cell_actual").alias("actual"),
        F.col("cell_expected").alias("expected"),
        F.col("cell_transactions").alias("transactions"),
        (-variance).alias("business_impact"),
        variance_pct(variance, F.col("cell_expected")).alias("variance_pct"),
    )


def latest_contributions(matrix: DataFrame) -> DataFrame:
    """The cells of the last period."""
    last = matrix.agg(F.max("period_start")).scalar()
    return matrix.filter(F.col("period_start") == last)


def reconciliation(matrix: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Whether the cells of the last period add up to the benchmark impact of that period."""
    ours = latest_contributions(matrix).groupBy("key").agg(F.sum("business_impact").alias("matrix_impact"))
    theirs = benchmark.select("key", F.col("business_impact").alias("scope_impact"))
    gap = F.abs(F.col("matrix_impact") - F.col("scope_impact"))
    return ours.join(theirs, "key").withColumn(
        "reconciles", gap <= F.greatest(F.lit(0.01), F.abs("scope_impact") * 1e-9)
    )


def waterfall(contributions: DataFrame) -> DataFrame:
    """Running start and end of the impacts, largest first, and the net row. A handful of bars."""
    order = W.orderBy(F.abs("business_impact").desc(), F.col("category")).rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    bars = contributions.select(
        F.row_number().over(W.orderBy(F.abs("business_impact").desc(), F.col("category"))).alias("step"),
        "category",
        "business_impact",
        F.sum("business_impact").over(order).alias("end"),
    ).withColumn("start", F.col("end") - F.col("business_impact"))
    net = contributions.agg(
        (F.count("*") + 1).cast("int").alias("step"),
        F.lit("Net impact").alias("category"),
        F.sum("business_impact").alias("business_impact"),
        F.sum("business_impact").alias("end"),
        F.lit(0.0).alias("start"),
    )
    return bars.unionByName(net).withColumn("base", F.least("start", "end"))


def node_id(parent: Column, level: str | Column, value: Column) -> Column:
    """The id of a node follows from that of its parent, so ids chain down all levels."""
    return F.sha2(F.concat_ws("|", parent, F.lit(level) if isinstance(level, str) else level, value), 256)


def path_node_id(path: Sequence[Predicate]) -> Column:
    """The id of the node that a drill path leads to; of an empty path the root's."""
    at = F.sha2(F.lit("root"), 256)
    for level, value in path:
        at = node_id(at, level, F.lit(value))
    return at


def hierarchy_tree(df: DataFrame, levels: Sequence[str], fields: PaymentFields = FIELDS) -> DataFrame:
    """All nodes of all levels from one rollup, the root included.

    A node has its own id and that of its parent, its sums, its share of the parent and the half-open
    interval of leaf numbers below it: ``first_leaf`` to ``end_leaf``. Leaves are numbered in the order of
    their paths, so everything below a node is one range, and a node lies below another one if its
    interval lies within the other's. A row whose value is missing at a level belongs to the node above.

    Leaf paths are sorted by ranges; a leaf's number is its place in its range and the sizes of the ranges
    before it, so no task numbers all of them.
    """
    spark = df.sparkSession
    some = df.filter(F.col(fields.amount).isNotNull())
    values = F.array(*[F.col(quoted(x)).cast("string") for x in levels])
    known = F.slice(values, F.lit(1), F.coalesce(F.nullif(F.array_position(F.transform(values, lambda v: v.isNull()), F.lit(True)), F.lit(0)) - 1, F.size(values)).cast("int"))
    leaves = some.groupBy(known.alias("path")).agg(F.sum(fields.amount).alias("amount"), F.count("*").alias("transactions"))
    placed = shared_table(leaves.orderBy("path").withColumn("_at", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("_at", 33)
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one row a range
    before, so_far = [], 0
    for p in sorted(sizes):
        before += [F.lit(p), F.lit(so_far)]
        so_far += sizes[p]
    base = F.create_map(*before) if before else F.create_map(F.lit(0).cast("long"), F.lit(0))
    number = F.element_at(base.cast("map<bigint, bigint>"), part) + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    names = F.array(*[F.lit(x) for x in levels])
    # (index, level, value, id, parent) of every node on a path, the root first.
    step = "struct<i: int, level: string, value: string, id: string, parent: string>"
    root = F.array(F.struct(F.lit(0).alias("i"), F.lit(None).cast("string").alias("level"), F.lit(None).cast("string").alias("value"), path_node_id([]).alias("id"), F.lit(None).cast("string").alias("parent"))).cast(f"array<{step}>")

    def descend(nodes: Column, value: Column) -> Column:
        above = F.element_at(nodes, -1)
        level = F.element_at(names, above["i"] + 1)
        node = F.struct((above["i"] + 1).alias("i"), level.alias("level"), value.alias("value"), node_id(above["id"], level, value).alias("id"), above["id"].alias("parent"))
        return F.array_append(nodes, node.cast(step))

    nodes = (
        placed.select("amount", "transactions", number.alias("leaf"), F.explode(F.aggregate("path", root, descend)).alias("n"))
        .groupBy(F.col("n.id").alias("node_id"), F.col("n.parent").alias("parent_node_id"), F.col("n.i").alias("level_index"), F.col("n.level").alias("level"), F.col("n.value").alias("value"))
        .agg(F.sum("amount").cast("double").alias("amount"), F.sum("transactions").alias("transactions"), F.min("leaf").alias("first_leaf"), (F.max("leaf") + 1).alias("end_leaf"))
    )
    nodes = shared_table(nodes, "nodes")
    parents = nodes.select(F.col("node_id").alias("_id"), F.col("amount").alias("_above"))
    share = F.when(F.col("parent_node_id").isNull(), F.lit(1.0)).otherwise(F.coalesce(ratio(F.col("amount"), F.col("_above")), F.lit(0.0)))
    return nodes.join(parents, F.col("parent_node_id") == F.col("_id"), "left").withColumn("share_of_parent", share).drop("_id", "_above")


def subtree(tree: DataFrame, node: str) -> DataFrame:
    """A node of ``hierarchy_tree`` and all nodes below it, by its interval: no walk over the levels."""
    at = tree.filter(F.col("node_id") == node).select("first_leaf", "end_leaf", "level_index").first()
    if at is None:
        return tree.limit(0)
    inside = (F.col("first_leaf") >= at["first_leaf"]) & (F.col("end_leaf") <= at["end_leaf"]) & (F.col("level_index") > at["level_index"])
    return tree.filter((F.col("node_id") == node) | inside)


def hierarchy_children(
    df: DataFrame,
    path: Sequence[Predicate],
    level: str,
    levels: Sequence[str],
    k: int = TOP_CHILDREN,
    other: bool = True,
    fields: PaymentFields = FIELDS,
) -> DataFrame:
    """The next level below a drill path: the largest children and the rest as one row.

    The level is aggregated once; the first ``k`` values and the level total are read from that
    aggregate.
    """
    scope = hierarchy_path_filter(df.filter(F.col(fields.amount).isNotNull()), path, levels)
    sums = scope.groupBy(F.col(level).alias("value")).agg(
        F.sum(fields.amount).cast("double").alias("amount"), F.count("*").alias("transactions")
    )
    # Missing values sort last and drop out after the limit, so that every read of the level shares
    # one scan and one shuffle.
    shown = (
        sums.orderBy(F.col("value").isNull(), F.desc("amount"), "value")
        .limit(k)
        .filter(F.col("value").isNotNull())
    )
    parent = sums.agg(
        F.struct(F.sum("amount").alias("amount"), F.sum("transactions").alias("transactions")).alias("p")
    ).scalar()
    rows = shown.withColumn("drillable", F.lit(True))
    if other:
        rest = (
            shown.agg(
                F.coalesce(F.sum("amount"), F.lit(0.0)).alias("_a"),
                F.coalesce(F.sum("transactions"), F.lit(0)).alias("_t"),
            )
            .withColumn("_p", parent)
            .select(
                F.lit(OTHER).alias("value"),
                F.greatest(F.lit(0.0), F.col("_p.amount") - F.col("_a")).alias("amount"),
                F.greatest(F.lit(0), F.col("_p.transactions") - F.col("_t")).alias("transactions"),
                F.lit(False).alias("drillable"),
                (F.abs("_p.amount") * OTHER_THRESHOLD).alias("_floor"),
            )
            .filter("amount > _floor")
            .drop("_floor")
        )
        rows = rows.unionByName(rest)
    parent_id = path_node_id(path)
    return rows.select(
        node_id(parent_id, level, F.col("value")).alias("node_id"),
        parent_id.alias("parent_node_id"),
        F.lit(len(path)).alias("level_index"),
        F.lit(level).alias("level"),
        "value",
        "amount",
        "transactions",
        F.coalesce(ratio(F.col("amount"), parent["amount"]), F.lit(0.0)).alias("share_of_parent"),
        "drillable",
    )
