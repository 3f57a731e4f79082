"""Data contract, metric catalog and dimension catalog."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variscope.functions.values import BLANKS, any_of, finite_number, trimmed

# The columns of the contract, its metadata fields and the names it understands.
REQUIRED_WIDE = ("period_date", "actual_value")
REQUIRED_LONG = ("period_date", "scenario", "value")
DIMENSION_PREFIX = "dim_"
WIDE_COMPARISONS = ("plan_value", "budget_value", "target_value", "forecast_value")
METADATA_FIELDS = (
    "record_id", "dataset_name", "metric_id", "metric_name", "metric_definition",
    "metric_description", "metric_owner", "metric_certification", "metric_unit", "metric_scale",
    "numerator_metric_id", "denominator_metric_id", "metric_caveat", "close_process_note",
    "allocation_note", "currency", "metric_polarity", "aggregation_method",
    "fiscal_year_start_month", "planning_lens", "source_system", "scenario",
)
SCENARIOS = {
    "actual": "actual", "actuals": "actual", "reported": "actual", "observed": "actual",
    "plan": "plan", "budget": "budget", "target": "target", "expected": "expected",
    "forecast": "forecast", "outlook": "forecast", "latest_estimate": "forecast",
    "latest_forecast": "forecast",
    "prior_year": "prior_year", "prior": "prior_year", "py": "prior_year", "last_year": "prior_year",
}
COMPARISON_ORDER = ("budget", "expected", "plan", "target", "forecast")
SUPPORTED_AGGREGATIONS = ("sum", "average", "avg", "mean", "period_end", "ending_balance", "snapshot")
COMPARISON_COLUMNS = ("target", "plan", "budget", "forecast", "business_target", "prior_year")
LENSES = ("revenue", "opex", "capex", "marketing", "corporate", "workforce")
LENS_PATTERNS = (
    ("capex", r"(capex|capital|asset|investment)"),
    ("marketing", r"(marketing|campaign|media|demand|lead)"),
    ("workforce", r"(headcount|workforce|fte|labor|employee|attrition)"),
    ("opex", r"(opex|expense|cost|spend|vendor)"),
    ("corporate", r"(corporate|g&a|general and administrative|legal|allocation)"),
)
# Dimension, its label, its child level and the other words that name it.
DIMENSION_CATALOG = (
    ("year", "Year", "quarter", ("calendar year",)),
    ("quarter", "Quarter", "month", ("qtr",)),
    ("month", "Month", None, ("time", "date", "period")),
    ("region", "Region", "market", ("geography", "area")),
    ("market", "Market", None, ("local market", "territory")),
    ("stateGroup", "Market Type", None, ("location type", "market classification")),
    ("channel", "Channel", "storeType", ("sales channel", "route to market")),
    ("storeType", "Channel Subtype", None, ("subchannel", "channel type", "store type")),
    ("salesMotion", "Sales Motion", None, ("motion", "selling motion")),
    ("productFamily", "Product Family", "productLine", ("product", "products", "category", "product group")),
    ("productLine", "Product Line", "productName", ("line", "product subcategory")),
    ("productName", "Product", None, ("product name", "item")),
    ("productTier", "Product Tier", None, ("tier", "product level")),
    ("deviceBrand", "Product Brand", None, ("brand", "device brand")),
    ("deviceOs", "Device OS", None, ("os", "operating system")),
    ("offer", "Offer", None, ("promotion", "promo", "deal")),
    ("planType", "Plan Type", None, ("plan",)),
    ("promoFlag", "Promotion Status", None, ("promo status",)),
    ("customerSegment", "Customer Segment", "accountType", ("segment", "customer type")),
    ("accountType", "Account Type", None, ("account", "customer subsegment")),
    ("tenureBand", "Tenure", None, ("tenure", "customer age")),
    ("ageBand", "Age Band", None, ("age",)),
    ("creditBand", "Credit Band", None, ("credit",)),
    ("employeeBand", "Employee Band", None, ("company size", "employees")),
    ("acquisitionSource", "Acquisition Source", None, ("source", "acquisition")),
    ("inventoryStatus", "Inventory Status", None, ("inventory", "stock")),
    ("fulfillment", "Fulfillment", None, ("delivery", "shipping")),
    ("serviceTier", "Service Tier", None, ("service level",)),
    ("supportTier", "Support Tier", None, ("support",)),
    ("paymentType", "Payment Type", None, ("payment",)),
    ("contractType", "Contract Type", None, ("contract",)),
)


def contract_mode(columns: Sequence[str]) -> str:
    """``wide``, ``long`` or ``unrecognized``, from the column names."""
    if set(REQUIRED_WIDE) <= set(columns):
        return "wide"
    return "long" if set(REQUIRED_LONG) <= set(columns) else "unrecognized"


def dimension_fields(columns: Sequence[str]) -> dict[str, str]:
    """``dim_*`` columns and their cleaned names."""
    found = {}
    for c in columns:
        if c.lower().startswith(DIMENSION_PREFIX):
            bare = c[len(DIMENSION_PREFIX) :].strip()
            found[c] = re.sub(r"[^a-zA-Z0-9]+", "_", bare).strip("_").lower() or c
    return found


def normalize_wide(df: DataFrame) -> DataFrame:
    """Contract rows with one column per scenario, renamed; the first comparison present is the target."""
    names = df.columns
    renamed = {
        "plan_value": "plan", "budget_value": "budget", "target_value": "business_target",
        "forecast_value": "forecast", "prior_year_value": "prior_year",
    }
    primary = next((c for c in WIDE_COMPARISONS if c in names), None)
    out = [df["period_date"], df["actual_value"].alias("actual")]
    if primary:
        out.append(df[primary].alias("target"))
    out += [df[c].alias(n) for c, n in renamed.items() if c in names]
    out += [df[c].alias(n) for c, n in dimension_fields(names).items()]
    out += [df[c] for c in names if c in METADATA_FIELDS and c != "scenario"]
    return df.select(*out)


def normalized_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(trimmed(c)), r"[\s-]+", "_")


def _lookup(c: Column, table: dict[str, str], default: Column | None = None) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.try_element_at(pairs, c)
    return found if default is None else F.coalesce(found, default)


def _scenario_sums(df: DataFrame, keys: Sequence[Column], carried: Sequence[Column] = ()) -> DataFrame:
    """Sums per key and scenario. Rows are summed under their raw scenario text first, so the names
    are read once per group instead of once per row."""
    raw = df.select(*keys, df["scenario"].cast("string").alias("_raw"), finite_number(df, "value").alias("_value"), *carried)
    names = raw.columns[: len(keys)]
    extra = [F.max(c).alias(c) for c in raw.columns[len(keys) + 2 :]]
    sums = raw.filter(F.col("_value").isNotNull()).groupBy(*names, "_raw").agg(F.sum("_value").alias("_value"), *extra)
    scenario = normalized_name(F.col("_raw"))
    return sums.withColumn("_scenario", _lookup(scenario, SCENARIOS, scenario))


def primary_comparison(df: DataFrame) -> Column:
    """The comparison scenario of a long table: plan-like before forecast, then by name. A scalar."""
    seen = _scenario_sums(df, []).agg(
        F.coalesce(*[F.max(F.when(F.col("_scenario") == s, F.lit(s))) for s in COMPARISON_ORDER])
    )
    return seen.scalar()


def normalize_long(df: DataFrame, row_idx: str | None = None) -> DataFrame:
    """One row per date, dimensions and metric, with the scenarios as columns.

    With ``row_idx`` the metadata of the last row of each group is kept as well.
    """
    names = df.columns
    dims = dimension_fields(names)
    metric = [c for c in ("metric_id", "metric_name") if c in names][:1]
    keys = ["period_date", *dims.values(), *metric]
    key_columns = [df["period_date"], *[df[c].alias(n) for c, n in dims.items()], *[df[c] for c in metric]]
    carried = [
        c for c in names if row_idx and c in METADATA_FIELDS and c not in ("scenario", "record_id", *metric)
    ]
    # The last row wins: the largest (row, metadata) pair.
    last = [F.struct(df[row_idx].alias("i"), *[df[c] for c in carried]).alias("_last")] if carried else []
    total = lambda s: F.sum(F.when(F.col("_scenario") == s, F.col("_value")))
    folded = _scenario_sums(df, key_columns, last).groupBy(*keys).agg(
        total("actual").alias("actual"),
        *[total(s).alias(f"_{s}") for s in COMPARISON_ORDER],
        total("prior_year").alias("prior_year"),
        F.count_if(F.coalesce("_scenario", F.lit("")) != "").alias("_named"),
        *([F.max("_last").alias("_last")] if carried else []),
    )
    # Filtered once the sums are complete: before them the filter would move down to every row.
    folded = folded.filter("_named > 0")
    target = F.coalesce(*[F.when(F.col("_primary") == s, F.col(f"_{s}")) for s in COMPARISON_ORDER])
    return folded.withColumn("_primary", primary_comparison(df)).select(
        *keys,
        "actual",
        target.alias("target"),
        F.col("_plan").alias("plan"),
        F.col("_budget").alias("budget"),
        F.col("_target").alias("business_target"),
        F.col("_expected").alias("expected"),
        F.col("_forecast").alias("forecast"),
        "prior_year",
        *[F.col("_last")[c].alias(c) for c in carried],
    )


def _label(names: Sequence[str]) -> str:
    """The column that identifies the metric."""
    return next((c for c in ("metric_id", "metric_name") if c in names), "")


def validate_contract(df: DataFrame) -> DataFrame:
    """Broken contract rules as rows ``(level, code, detail)``; errors stop an ingest."""
    names = df.columns
    mode = contract_mode(names)
    present = lambda c: F.nullif(trimmed(df[c].cast("string")), F.lit(""))
    identity = _label(names)
    none = F.lit(None).cast("string")
    aggregation = normalized_name(present("aggregation_method")) if "aggregation_method" in names else none
    bad = F.when(~aggregation.isin(list(SUPPORTED_AGGREGATIONS)), aggregation)
    actuals = F.count_if(_lookup(normalized_name(df["scenario"].cast("string")), SCENARIOS) == "actual") if mode == "long" else F.lit(1)
    # Two identities are enough to know; min and max need no set of all names.
    sums = df.agg(
        *[
            f(present(c) if c in names else none).alias(f"_{f.__name__}_{n}")
            for n, c in (("id", identity), ("name", "metric_name"))
            for f in (F.min, F.max)
        ],
        F.min(bad).alias("_bad"),
        actuals.alias("_actuals") if mode == "long" else F.count("*").alias("_actuals"),
    )
    many = F.col("_min_id") != F.col("_max_id")
    rules = [
        ("error", "several_metrics", many, F.lit(identity)),
        ("warning", "several_names", ~many & (F.col("_min_name") != F.col("_max_name")), F.lit("metric_name")),
        ("error", "unsupported_aggregation", F.col("_bad").isNotNull(), F.col("_bad")),
        ("error", "no_actual_scenario", F.lit(mode == "long") & (F.col("_actuals") == 0), F.lit("scenario")),
        ("warning", "no_dimensions", F.lit(not dimension_fields(names)), F.lit("dim_*")),
        (
            "warning", "no_comparison",
            F.lit(mode == "wide" and not any(c in names for c in WIDE_COMPARISONS)), F.lit("plan_value"),
        ),
    ]
    listed = F.array(
        *[
            F.when(c, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), d.alias("detail")))
            for level, code, c, d in rules
        ]
    )
    return sums.select(F.inline(F.filter(listed, lambda x: x.isNotNull())))


def apply_contract(df: DataFrame, row_idx: str | None = None) -> DataFrame:
    """Normalise a table that follows the contract; raise on contract errors, pass others through.

    The metadata of a long table is that of the last row by ``row_idx``, or in the order of the files.
    """
    mode = contract_mode(df.columns)
    if mode == "unrecognized":
        return df
    errors = validate_contract(df).filter("level = 'error'").collect()  # six rules at most
    if errors:
        raise ValueError("data contract: " + "; ".join(f"{e['code']} ({e['detail']})" for e in errors))
    if mode == "wide":
        return normalize_wide(df)
    if row_idx is None:
        row_idx, df = "_row_idx", df.withColumn("_row_idx", F.monotonically_increasing_id())
    return normalize_long(df, row_idx)


def first_values(df: DataFrame, fields: Sequence[str], row_idx: str, key: str = "metric_id") -> DataFrame:
    """First non-blank value of each metadata field per metric, by row order. The aggregation is
    partial, so a metric with most of the rows costs one row per task."""
    found = []
    for f in fields:
        if f in df.columns and f != key:
            text = F.btrim(F.col(f).cast("string"), F.lit(BLANKS))
            found.append(
                F.coalesce(F.min_by(text, F.when(text != "", F.col(row_idx))), F.lit("")).alias(f)
            )
        elif f != key:
            found.append(F.lit("").alias(f))
    return df.groupBy(key).agg(*found)


def _aggregation(c: Column, governed: bool) -> Column:
    n = normalized_name(c)
    out = F.when(n.isin("average", "avg", "mean"), "average").when(
        n.isin("period_end", "ending_balance", "snapshot", *(["last_value"] if governed else [])), "period_end"
    )
    if governed:
        out = out.when(n.isin("ratio", "rate", "percentage", "percent"), "ratio").when(
            n.isin("distinct_count", "count_distinct", "unique_count"), "distinct_count"
        )
    return out.otherwise("sum")


def _polarity(c: Column) -> Column:
    return F.when(normalized_name(c).isin("lower_is_better", "lower"), "lower_is_better").otherwise("higher_is_better")


def _fiscal_start(c: Column) -> Column:
    n = c.try_cast("double")
    return F.when((n == F.floor(n)) & n.between(1, 12), n.cast("int")).otherwise(1)


def infer_defaults(df: DataFrame, measures: Sequence[str], row_idx: str) -> DataFrame:
    """One row per metric: the measures, polarity, lens, aggregation and fiscal start to begin with."""
    fields = [
        "planning_lens", "metric_name", "aggregation_method", "metric_polarity", "fiscal_year_start_month", "dataset_name",
    ]
    actual = "actual" if "actual" in df.columns and "actual" in measures else next(iter(measures), "")
    comparisons = [c for c in COMPARISON_COLUMNS if c != actual and c in df.columns and c in measures]
    expected = next(iter(comparisons), next((m for m in measures if m != actual), ""))
    first = first_values(df, fields, row_idx)
    explicit = normalized_name(F.col("planning_lens"))
    text = F.lower(F.concat_ws(" ", "metric_name", "metric_id"))
    lens = F.when(explicit.isin(list(LENSES)), explicit)
    for name, pattern in LENS_PATTERNS:
        lens = lens.when(text.rlike(pattern), name)
    return first.select(
        "metric_id",
        F.lit(actual).alias("actual_key"),
        F.lit(expected).alias("expected_key"),
        _polarity(F.col("metric_polarity")).alias("metric_polarity"),
        lens.otherwise("revenue").alias("planning_lens"),
        _aggregation(F.col("aggregation_method"), False).alias("aggregation"),
        _fiscal_start(F.col("fiscal_year_start_month")).alias("fiscal_year_start_month"),
        F.coalesce(F.nullif("dataset_name", F.lit("")), F.lit("Uploaded finance data")).alias("dataset_label"),
        F.coalesce(F.nullif("metric_name", F.lit("")), F.lit(actual or "Selected metric")).alias("metric_label"),
    )


def infer_metric_definition(df: DataFrame, actual: str, comparison: str | None, row_idx: str) -> DataFrame:
    """One row per metric: the governed definition, how complete it is and what it lacks."""
    first = first_values(df, [f for f in METADATA_FIELDS if f != "scenario"], row_idx)
    c = F.col
    blank = lambda x: F.nullif(x, F.lit(""))
    status = _lookup(
        normalized_name(c("metric_certification")),
        {
            "certified": "certified", "approved": "certified", "draft": "draft", "provisional": "draft",
            "deprecated": "deprecated", "retired": "deprecated",
        },
        F.lit("unknown"),
    )
    scale = c("metric_scale").try_cast("double")
    defined = first.withColumns(
        {
            "description": F.coalesce(blank(c("metric_definition")), c("metric_description")),
            "certification_status": status,
            "aggregation": _aggregation(c("aggregation_method"), True),
            "polarity": _polarity(c("metric_polarity")),
            "unit": F.coalesce(blank(c("metric_unit")), blank(c("currency")), F.lit("unspecified")),
            "scale": F.when(scale > 0, scale).otherwise(F.lit(1.0)),
            "fiscal_start": _fiscal_start(c("fiscal_year_start_month")),
        }
    )
    parts = F.array(blank(c("numerator_metric_id")), blank(c("denominator_metric_id")))
    lacking = [
        (c("description") == "", "business definition"),
        (c("metric_owner") == "", "metric owner"),
        (c("certification_status") == "unknown", "certification status"),
        (c("unit") == "unspecified", "unit or currency"),
        ((c("aggregation") == "ratio") & F.exists(parts, lambda x: x.isNull()), "ratio numerator and denominator"),
        (F.lit(comparison is None), "approved comparison scenario"),
    ]
    missing = F.filter(F.array(*[F.when(cond, F.lit(n)) for cond, n in lacking]), lambda x: x.isNotNull())
    return defined.withColumn("_missing", missing).select(
        "metric_id",
        F.coalesce(blank(c("metric_name")), F.lit(actual)).alias("name"),
        "description",
        c("metric_owner").alias("owner"),
        "certification_status",
        "aggregation",
        "polarity",
        "unit",
        "scale",
        c("fiscal_start").alias("fiscal_year_start_month"),
        F.lit(actual).alias("actual_field"),
        F.lit(comparison).alias("comparison_field"),
        F.array_join(
            F.array_distinct(
                F.filter(
                    F.array("metric_caveat", "close_process_note", "allocation_note"), lambda x: x != ""
                )
            ),
            "; ",
        ).alias("caveats"),
        F.round((6 - F.size("_missing")) / 6 * 100).cast("int").alias("semantic_completeness"),
        F.array_join("_missing", ", ").alias("missing_semantics"),
        c("aggregation").isin("sum", "average", "period_end").alias("attribution_supported"),
    )


def validate_scope(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Requests ``(request_id, metric_id, aggregation, comparison)`` that the metric catalog does not
    allow, one row per reason."""
    known = catalog.select(
        "metric_id", F.col("aggregation").alias("_aggregation"), F.col("comparison_field").alias("_comparison"),
        "attribution_supported",
    )
    joined = requests.join(known, "metric_id", "left")
    absent = F.col("_aggregation").isNull()
    reasons = F.array(
        F.when(absent, F.lit("unknown_metric")),
        F.when(~absent & (F.col("aggregation") != F.col("_aggregation")), F.lit("aggregation_not_allowed")),
        F.when(~absent & ~F.col("attribution_supported"), F.lit("attribution_not_supported")),
        F.when(~absent & ~F.col("comparison").eqNullSafe(F.col("_comparison")), F.lit("comparison_not_allowed")),
    )
    return joined.select(
        "request_id", "metric_id", F.explode(F.filter(reasons, lambda x: x.isNotNull())).alias("reason")
    )


def catalog_children() -> dict[str, str]:
    """Child level of each dimension that has one."""
    return {name: child for name, _, child, _ in DIMENSION_CATALOG if child}


def resolve_dimension(question: Column, available: Sequence[str]) -> Column:
    """The first available dimension of the catalog that a question names, else null."""
    q = F.lower(question)
    named = [
        F.when(any_of(q.contains(w.lower()) for w in (name, label, *synonyms)), F.lit(name))
        for name, label, _, synonyms in DIMENSION_CATALOG
        if name in available
    ]
    return F.coalesce(*named) if named else F.lit(None).cast("string")


def next_drill(scores: DataFrame, states: DataFrame, children: dict[str, str] | None = None) -> DataFrame:
    """Where to drill after each state ``(last_dimension)``: the child level of the last dimension
    when it has one (by default as the catalog has it), else the best-scored other dimension."""
    children = catalog_children() if children is None else children
    best = scores.select("dimension", "score", "top_category")
    child = _lookup(F.col("last_dimension"), children or {"": ""})
    ranked = F.array_sort(
        F.collect_list(F.struct((-F.col("score")).alias("s"), "dimension", "top_category"))
    )
    # The ranking has one entry per dimension of the specification.
    ranking = best.agg(ranked.alias("r")).scalar()
    options = F.filter(
        "_ranking",
        lambda x: F.when(F.col("_child").isNotNull(), x["dimension"] == F.col("_child")).otherwise(
            x["dimension"] != F.col("last_dimension")
        ),
    )
    return (
        states.withColumn("_ranking", ranking)
        .withColumn("_child", child)
        .withColumn("_next", F.try_element_at(options, F.lit(1)))
        .select(
            "last_dimension",
            F.col("_next.dimension").alias("next_dimension"),
            F.col("_next.top_category").alias("value"),
            F.when(F.col("_child").isNotNull(), "hierarchy").otherwise("score").alias("reason"),
        )
    )


def schema_union(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all inputs under the union of their columns."""
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out
