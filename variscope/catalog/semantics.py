"""Contract, metric-catalog and drill-catalog queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from variscope.catalog.attribution import SPEC
from variscope.catalog.registry import FACT, day, investigation, query, r
from variscope.operators import semantics as M
from variscope.plans.investigation import Investigation
from variscope.sources.warehouse import fact, table


def wide_contract(spark, sf):
    """The fact as a wide contract file."""
    df = fact(spark, sf, ["period_date", "actual", "target", "extended_price", "region", "ptype"])
    return df.select(
        "period_date",
        F.col("actual").alias("actual_value"),
        F.col("target").alias("forecast_value"),
        F.col("extended_price").alias("budget_value"),
        F.lit("net_price").alias("metric_name"),
        F.col("region").alias("dim_Sales Region"),
        F.col("ptype").alias("dim_product"),
    )


@query(
    "normalize_wide",
    f"""WITH {FACT} SELECT cast(period_date AS VARCHAR) AS period_date, region AS sales_region, ptype AS product, metric_name, count(*) AS rows, round(cast(sum(actual) AS DOUBLE), 4) AS actual,
    round(cast(sum(extended_price) AS DOUBLE), 4) AS target, round(cast(sum(extended_price) AS DOUBLE), 4) AS budget, round(cast(sum(target) AS DOUBLE), 4) AS forecast FROM (SELECT *, 'net_price' AS metric_name FROM fact) GROUP BY ALL""",
)
def normalize_wide(spark, sf):
    df = M.normalize_wide(wide_contract(spark, sf))
    return df.groupBy(F.col("period_date").cast("string").alias("period_date"), "sales_region", "product", "metric_name").agg(
        F.count("*").alias("rows"),
        *[F.round(F.sum(c).cast("double"), 4).alias(c) for c in ("actual", "target", "budget", "forecast")],
    )


def long_contract(spark, sf):
    """Each order line as an ``Actuals`` row, a ``Budget`` row and, if open, a ``Latest Estimate`` row."""
    df = fact(spark, sf, ["period_date", "actual", "target", "extended_price", "linestatus", "region", "ptype"])
    rows = F.array(
        F.struct(F.lit(" Actuals").alias("scenario"), F.col("actual").alias("value")),
        F.struct(F.lit("Budget").alias("scenario"), F.col("target").alias("value")),
        F.struct(
            F.when(F.col("linestatus") == "O", "Latest-Estimate").alias("scenario"), F.col("extended_price").alias("value")
        ),
    )
    return df.select(
        F.trunc("period_date", "month").alias("period_date"),
        F.lit("net_price").alias("metric_id"),
        F.col("region").alias("dim_region"),
        F.col("ptype").alias("dim_product"),
        F.inline(rows),
    )


@query(
    "normalize_long",
    f"""WITH {FACT} SELECT cast(cast(date_trunc('month', period_date) AS DATE) AS VARCHAR) AS period_date, 'net_price' AS metric_id, region, ptype AS product, round(cast(sum(actual) AS DOUBLE), 4) AS actual,
    round(cast(sum(target) AS DOUBLE), 4) AS target, round(cast(sum(target) AS DOUBLE), 4) AS budget, round(cast(sum(extended_price) FILTER (WHERE linestatus = 'O') AS DOUBLE), 4) AS forecast,
    cast(NULL AS DOUBLE) AS plan FROM fact GROUP BY ALL""",
)
def normalize_long(spark, sf):
    return M.normalize_long(long_contract(spark, sf)).select(
        day("period_date"), "metric_id", "region", "product", r("actual", 4), r("target", 4), r("budget", 4), r("forecast", 4), r("plan", 4)
    )


@query(
    "validate_contract",
    """SELECT 'error' AS level, 'several_metrics' AS code, 'metric_id' AS detail FROM part HAVING count(DISTINCT p_type) > 1
    UNION ALL SELECT 'error', 'unsupported_aggregation', 'ratio' FROM part HAVING count(*) FILTER (WHERE p_size > 20 AND p_size <= 30) > 0
    UNION ALL SELECT 'warning', 'no_dimensions', 'dim_*'""",
)
def validate_contract(spark, sf):
    df = metric_rows(spark, sf).select(
        "metric_id", "metric_name", "aggregation_method", F.lit("2024-01-01").alias("period_date"),
        F.col("row_idx").alias("actual_value"), F.lit(1).alias("plan_value"),
    )
    return M.validate_contract(df)


def metric_rows(spark, sf):
    """Parts as metric metadata rows: one metric per part type, described by many rows."""
    size, brand = F.col("p_size"), F.col("p_brand")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("row_idx"),
        F.col("p_type").alias("metric_id"),
        F.when(size > 5, F.concat(F.lit(" "), "p_name")).otherwise("").alias("metric_name"),
        F.when(size > 40, "Avg").when(size > 30, "Period End").when(size > 20, "Ratio").when(size > 10, "").otherwise("sum").alias("aggregation_method"),
        F.when(brand.isin("Brand#1", "Brand#2", "Brand#3"), "Lower Is Better").otherwise("").alias("metric_polarity"),
        F.when(size > 45, brand).alias("metric_owner"),
        F.when(size > 48, "Approved").otherwise("  ").alias("metric_certification"),
        F.when(size == 50, F.concat(F.lit("price of "), "p_name")).alias("metric_description"),
        F.when(size > 15, (size % 14).cast("string")).alias("fiscal_year_start_month"),
        F.when(brand == "Brand#25", "EUR").alias("currency"),
        F.when(size == 1, "Check cost basis").alias("metric_caveat"),
    )


METRICS = """mr AS (SELECT p_partkey AS i, p_type AS metric_id, CASE WHEN p_size > 5 THEN p_name ELSE '' END AS metric_name,
  CASE WHEN p_size > 40 THEN 'average' WHEN p_size > 30 THEN 'period_end' WHEN p_size > 20 THEN 'ratio' WHEN p_size > 10 THEN '' ELSE 'sum' END AS agg,
  CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'lower_is_better' END AS pol, CASE WHEN p_size > 45 THEN p_brand END AS own, CASE WHEN p_size > 48 THEN 'certified' END AS cert,
  CASE WHEN p_size = 50 THEN 'price of ' || p_name END AS descr, CASE WHEN p_size > 15 THEN p_size % 14 END AS fs, CASE WHEN p_brand = 'Brand#25' THEN 'EUR' END AS cur, CASE WHEN p_size = 1 THEN 'Check cost basis' END AS cav FROM part),
first AS (SELECT metric_id, arg_min(nullif(metric_name, ''), i) FILTER (WHERE metric_name <> '') AS metric_name, coalesce(arg_min(agg, i) FILTER (WHERE agg <> ''), 'sum') AS agg, coalesce(min(pol), 'higher_is_better') AS pol,
  coalesce(arg_min(own, i) FILTER (WHERE own IS NOT NULL), '') AS own, coalesce(min(cert), 'unknown') AS cert, coalesce(arg_min(descr, i) FILTER (WHERE descr IS NOT NULL), '') AS descr,
  arg_min(fs, i) FILTER (WHERE fs IS NOT NULL) AS fs, coalesce(min(cur), 'unspecified') AS unit, coalesce(min(cav), '') AS cav FROM mr GROUP BY metric_id),
defs AS (SELECT *, CASE WHEN fs BETWEEN 1 AND 12 THEN fs ELSE 1 END AS fss, concat_ws(', ', CASE WHEN descr = '' THEN 'business definition' END, CASE WHEN own = '' THEN 'metric owner' END, CASE WHEN cert = 'unknown' THEN 'certification status' END,
  CASE WHEN unit = 'unspecified' THEN 'unit or currency' END, CASE WHEN agg = 'ratio' THEN 'ratio numerator and denominator' END) AS miss,
  (descr = '')::INT + (own = '')::INT + (cert = 'unknown')::INT + (unit = 'unspecified')::INT + (agg = 'ratio')::INT AS k FROM first)"""


@query(
    "infer_defaults",
    f"""WITH {METRICS} SELECT metric_id, 'actual' AS actual_key, 'target' AS expected_key, pol AS metric_polarity, 'revenue' AS planning_lens, CASE WHEN agg = 'ratio' THEN 'sum' ELSE agg END AS aggregation,
    cast(fss AS INTEGER) AS fiscal_year_start_month, 'Uploaded finance data' AS dataset_label, metric_name AS metric_label FROM defs""",
)
def infer_defaults(spark, sf):
    df = metric_rows(spark, sf).withColumns({"actual": F.lit(1), "target": F.lit(1)})
    return M.infer_defaults(df, ["actual", "target"], "row_idx")


@query(
    "infer_metric_definition",
    f"""WITH {METRICS} SELECT metric_id, metric_name AS name, descr AS description, own AS owner, cert AS certification_status, agg AS aggregation, pol AS polarity, unit, cast(1.0 AS DOUBLE) AS scale, cast(fss AS INTEGER) AS fiscal_year_start_month,
    'actual' AS actual_field, 'target' AS comparison_field, cav AS caveats, cast(round((6 - k) / 6 * 100) AS INTEGER) AS semantic_completeness, miss AS missing_semantics, agg <> 'ratio' AS attribution_supported FROM defs""",
)
def infer_metric_definition(spark, sf):
    return M.infer_metric_definition(metric_rows(spark, sf), "actual", "target", "row_idx")


@query(
    "validate_scope",
    f"""WITH {METRICS}, rq AS (SELECT i AS request_id, mr.metric_id, coalesce(nullif(mr.agg, ''), 'sum') AS a, CASE WHEN mr.pol IS NOT NULL THEN 'plan' ELSE 'target' END AS c, defs.agg AS da FROM mr JOIN defs USING (metric_id))
    SELECT request_id, metric_id, 'aggregation_not_allowed' AS reason FROM rq WHERE a <> da UNION ALL SELECT request_id, metric_id, 'attribution_not_supported' FROM rq WHERE da = 'ratio'
    UNION ALL SELECT request_id, metric_id, 'comparison_not_allowed' FROM rq WHERE c <> 'target'""",
)
def validate_scope(spark, sf):
    rows = metric_rows(spark, sf)
    catalog = M.infer_metric_definition(rows, "actual", "target", "row_idx")
    requests = rows.select(
        F.col("row_idx").alias("request_id"),
        "metric_id",
        M._aggregation(F.col("aggregation_method"), True).alias("aggregation"),
        F.when(F.col("metric_polarity") != "", "plan").otherwise("target").alias("comparison"),
    )
    return M.validate_scope(requests, catalog)


@query(
    "next_drill",
    f"""WITH {FACT}, {investigation()}, kids AS (SELECT * FROM (VALUES ('region', 'nation'), ('ptype', 'brand'), ('returnflag', 'linestatus')) AS v(p, c)),
    x AS (SELECT l.dimension AS last_dimension, s.dimension AS next_dimension, s.top_category AS value, CASE WHEN c IS NULL THEN 'score' ELSE 'hierarchy' END AS reason,
      row_number() OVER (PARTITION BY l.dimension ORDER BY s.score DESC, s.dimension) AS k FROM scores l LEFT JOIN kids ON p = l.dimension JOIN scores s ON CASE WHEN c IS NULL THEN s.dimension <> l.dimension ELSE s.dimension = c END)
    SELECT last_dimension, next_dimension, value, reason FROM x WHERE k = 1""",
)
def next_drill(spark, sf):
    scores = Investigation(fact(spark, sf), SPEC).scores
    states = scores.select(F.col("dimension").alias("last_dimension"))
    return M.next_drill(scores, states, {"region": "nation", "ptype": "brand", "returnflag": "linestatus"})


@query(
    "schema_union",
    """SELECT c_mktsegment, c_nationkey, s_nationkey, count(*) AS rows, count(name) AS named FROM
    (SELECT c_mktsegment, c_nationkey, NULL AS s_nationkey, c_name AS name FROM customer UNION ALL SELECT NULL, NULL, s_nationkey, s_name FROM supplier) GROUP BY ALL""",
)
def schema_union(spark, sf):
    customers = table(spark, sf, "customer").withColumnRenamed("c_name", "name")
    suppliers = table(spark, sf, "supplier").withColumnRenamed("s_name", "name")
    return (
        M.schema_union([customers, suppliers])
        .groupBy("c_mktsegment", "c_nationkey", "s_nationkey")
        .agg(F.count("*").alias("rows"), F.count("name").alias("named"))
    )
