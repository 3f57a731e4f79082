"""Payments queries: the aggregates a spend dashboard asks of its warehouse."""

from __future__ import annotations

from pyspark.sql import functions as F

from variscope.catalog.registry import PAYMENTS, day, query, r
from variscope.operators import concentration as P
from variscope.operators.cohort import hierarchy_path_filter, scope_filter
from variscope.sources.warehouse import PAYMENT_DIMENSIONS, payments

DIMS = list(PAYMENT_DIMENSIONS)
DIM_LIST = ", ".join(DIMS)

MONTHLY = f"""{PAYMENTS}, monthly AS (SELECT fiscal_year, fiscal_month_number, fiscal_year || '-' || lpad(cast(fiscal_month_number AS VARCHAR), 2, '0') AS key,
  min(transaction_date) AS period_start, max(transaction_date) AS period_end, cast(sum(dollar_amount) AS DOUBLE) AS amount, count(*) AS transactions
  FROM payments WHERE dollar_amount IS NOT NULL GROUP BY ALL)"""

BENCH = f"""{MONTHLY}, b0 AS (SELECT *, max(period_end) OVER () AS latest, amount AS actual,
  CASE WHEN count(amount) OVER h >= 3 THEN median(amount) OVER h ELSE median(amount) OVER () END AS e0
  FROM monthly WHERE amount <> 0 WINDOW h AS (ORDER BY period_start ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
b1 AS (SELECT *, date_trunc('month', period_start) = date_trunc('month', latest) AND day(latest) < day(last_day(period_start)) AS partial_period FROM b0),
b2 AS (SELECT *, CASE WHEN partial_period THEN e0 * (day(latest) / day(last_day(period_start))) ELSE e0 END AS expected FROM b1),
b3 AS (SELECT *, expected - actual AS impact, list(expected - actual) OVER (ORDER BY period_start ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS hist FROM b2),
b4 AS (SELECT *, list_median(hist) AS center FROM b3),
b5 AS (SELECT *, coalesce(nullif(1.4826 * list_median(list_transform(hist, lambda x: abs(x - center))), 0), list_stddev_pop(hist)) AS sc FROM b4),
b6 AS (SELECT *, CASE WHEN len(hist) >= 4 AND sc > 0 THEN abs(impact - center) / sc ELSE 0 END AS score, abs(expected) * 0.03 AS threshold FROM b5),
bench AS (SELECT *, abs(impact) >= threshold AND threshold > 0 AS material,
  CASE WHEN impact < 0 AND (abs(impact) >= 2 * threshold OR score >= 3) THEN 'critical'
       WHEN impact < 0 AND ((abs(impact) >= threshold AND threshold > 0) OR score >= 2) THEN 'watch'
       WHEN impact > 0 AND abs(impact) >= threshold AND threshold > 0 THEN 'favorable' ELSE 'normal' END AS severity,
  row_number() OVER (ORDER BY period_start DESC) AS rr FROM b6)"""

TOP = f"""{PAYMENTS}, tot AS (SELECT cast(sum(dollar_amount) AS DOUBLE) AS total FROM payments),
topn AS (SELECT *, amount / total AS share, row_number() OVER (PARTITION BY dimension ORDER BY amount DESC, value) AS rank FROM
  (SELECT dimension, value, cast(sum(dollar_amount) AS DOUBLE) AS amount, count(*) AS transactions
   FROM (UNPIVOT (SELECT dollar_amount, {DIM_LIST} FROM payments) ON {DIM_LIST} INTO NAME dimension VALUE value) GROUP BY ALL), tot
  QUALIFY rank <= 8)"""


def matrix_sql(dim):
    return f"""{BENCH}, tops AS (SELECT {dim} AS category FROM payments WHERE {dim} IS NOT NULL GROUP BY 1 ORDER BY sum(dollar_amount) DESC, 1 LIMIT 8),
sparse AS (SELECT {dim} AS category, fiscal_year || '-' || lpad(cast(fiscal_month_number AS VARCHAR), 2, '0') AS key, cast(sum(dollar_amount) AS DOUBLE) AS a, count(*) AS t
  FROM payments WHERE {dim} IN (SELECT category FROM tops) GROUP BY ALL),
dense AS (SELECT tops.category, bench.key, period_start, partial_period, actual AS pa, expected AS pe, transactions AS pt, coalesce(a, 0) AS a, coalesce(t, 0) AS t,
  coalesce(a, 0) / nullif(actual, 0) AS share FROM bench CROSS JOIN tops LEFT JOIN sparse ON sparse.category = tops.category AND sparse.key = bench.key),
cells0 AS (SELECT *, pe * CASE WHEN count(share) OVER h >= 3 THEN median(share) OVER h ELSE coalesce(sum(a) OVER (PARTITION BY category) / nullif(sum(pa) OVER (PARTITION BY category), 0), 0) END AS e
  FROM dense WINDOW h AS (PARTITION BY category ORDER BY period_start ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
cells AS (SELECT category, key, period_start, partial_period, a, e, t FROM cells0
  UNION ALL SELECT 'Other categories', key, period_start, partial_period, any_value(pa) - sum(a), any_value(pe) - sum(e), greatest(0, any_value(pt) - sum(t)) FROM cells0 GROUP BY ALL)"""


@query(
    "scan_payments",
    f"""WITH {PAYMENTS} SELECT vendor, round(cast(sum(dollar_amount) AS DOUBLE), 4) AS amount, count(*) AS transactions FROM payments
    WHERE department = 'ASIA' AND transaction_date >= DATE '2000-01-01' GROUP BY vendor ORDER BY sum(dollar_amount) DESC, vendor LIMIT 20""",
)
def scan_payments(spark, sf):
    df = payments(spark, sf, ["department", "vendor"])
    where = (F.col("department") == "ASIA") & (F.col("transaction_date") >= F.lit("2000-01-01").cast("date"))
    return P.scan_payments(df, where, "vendor", 20).select("vendor", r("amount", 4), "transactions")


@query(
    "source_summary",
    f"""WITH {PAYMENTS} SELECT count(dollar_amount) AS row_count, round(cast(sum(dollar_amount) AS DOUBLE), 4) AS total_amount, cast(min(transaction_date) AS VARCHAR) AS min_date,
    cast(max(transaction_date) AS VARCHAR) AS max_date, arg_max(fiscal_year, transaction_date) AS max_fiscal_year FROM payments""",
)
def source_summary(spark, sf):
    return P.source_summary(payments(spark, sf, [])).select(
        "row_count", r("total_amount", 4), day("min_date"), day("max_date"), "max_fiscal_year"
    )


@query(
    "source_health",
    f"""WITH {PAYMENTS}, t AS (SELECT count(dollar_amount) AS n, count(transaction_date) AS d, count(department) AS l, cast(sum(dollar_amount) AS DOUBLE) AS total FROM payments)
    SELECT 'minimum_rows' AS "check", n >= 1000000 AS passed, cast(n AS DOUBLE) AS value FROM t UNION ALL SELECT 'required_columns', TRUE, 0.0
    UNION ALL SELECT 'latest_row', d > 0, cast(d AS DOUBLE) FROM t UNION ALL SELECT 'monthly_aggregate', n > 0, cast(n AS DOUBLE) FROM t
    UNION ALL SELECT 'leading_dimension', l > 0, cast(l AS DOUBLE) FROM t UNION ALL SELECT 'finite_total', TRUE, round(total, 4) FROM t""",
)
def source_health(spark, sf):
    return P.source_health(payments(spark, sf), DIMS, "department").select("check", "passed", r("value", 4))


@query(
    "scope_filter",
    f"""WITH {PAYMENTS}, m AS (SELECT max(transaction_date) AS d, arg_max(fiscal_year, transaction_date) AS fy FROM payments)
    SELECT '24m' AS scope, department, count(*) AS transactions, round(cast(sum(dollar_amount) AS DOUBLE), 4) AS amount FROM payments, m
      WHERE transaction_date >= date_trunc('month', d) - INTERVAL 23 MONTH AND fund_group = 'BUILDING' GROUP BY 2
    UNION ALL SELECT 'current_fy', department, count(*), round(cast(sum(dollar_amount) AS DOUBLE), 4) FROM payments, m WHERE fiscal_year = fy GROUP BY 2""",
)
def scope_filter_query(spark, sf):
    df = payments(spark, sf, ["department", "fund_group"])
    args = ("dollar_amount", "transaction_date", "fiscal_year", DIMS)

    def shape(rows, scope):
        return rows.groupBy(F.lit(scope).alias("scope"), "department").agg(
            F.count("*").alias("transactions"), F.round(F.sum("dollar_amount").cast("double"), 4).alias("amount")
        )

    months = scope_filter(df, "24m", *args, where=("fund_group", "BUILDING"))
    year = scope_filter(df, "current_fy", *args, where=("not_a_field", "x"))
    return shape(months, "24m").unionByName(shape(year, "current_fy"))


@query(
    "monthly_totals",
    f"""WITH {MONTHLY} SELECT key, cast(period_start AS VARCHAR) AS period_start, cast(period_end AS VARCHAR) AS period_end, round(amount, 4) AS amount, transactions FROM monthly""",
)
def monthly_totals(spark, sf):
    return P.monthly_totals(payments(spark, sf, [])).select("key", day("period_start"), day("period_end"), r("amount", 4), "transactions")


@query(
    "monthly_benchmark",
    f"""WITH {BENCH} SELECT key, cast(period_start AS VARCHAR) AS period_start, round(actual, 4) AS actual, round(expected, 5) AS expected, round(impact, 5) AS business_impact,
    round(-impact / nullif(abs(expected), 0), 6) AS variance_pct, transactions, partial_period, round(score, 6) AS anomaly_score, severity AS alert_severity FROM bench""",
)
def monthly_benchmark(spark, sf):
    return P.monthly_benchmark(P.monthly_totals(payments(spark, sf, []))).select(
        "key", day("period_start"), r("actual", 4), r("expected", 5), r("business_impact", 5), r("variance_pct"),
        "transactions", "partial_period", r("anomaly_score"), "alert_severity",
    )


@query(
    "partial_period_proration",
    f"WITH {BENCH} SELECT key, partial_period, round(e0, 5) AS full_expected, round(expected, 5) AS expected FROM bench",
)
def partial_period_proration(spark, sf):
    monthly = P.monthly_totals(payments(spark, sf, [])).filter("amount <> 0").withColumnRenamed("amount", "actual")
    full = P.rolling_median_baseline(monthly, P.BENCHMARK).withColumn("full_expected", F.col("expected"))
    latest = monthly.agg(F.max("period_end")).scalar()
    return P.partial_period_proration(full, latest).select("key", "partial_period", r("full_expected", 5), r("expected", 5))


@query(
    "benchmark_trend",
    f"""WITH {BENCH}, t AS (SELECT avg(impact) FILTER (WHERE rr <= 3) AS rec, avg(impact) FILTER (WHERE rr BETWEEN 4 AND 6) AS pri,
      avg(abs(expected)) FILTER (WHERE rr <= 6) AS ex, count(*) AS n FROM bench)
    SELECT CASE WHEN n < 6 THEN 'insufficient' WHEN abs(rec - pri) < greatest(1, ex * 0.01) THEN 'stable' WHEN rec > pri THEN 'improving' ELSE 'worsening' END AS direction,
      round(rec, 6) AS recent_average_impact, round(pri, 6) AS prior_average_impact FROM t""",
)
def benchmark_trend(spark, sf):
    return P.benchmark_trend(P.monthly_benchmark(P.monthly_totals(payments(spark, sf, [])))).select(
        "direction", r("recent_average_impact"), r("prior_average_impact")
    )


@query(
    "trailing_12",
    f"""WITH {BENCH} SELECT round(sum(actual) FILTER (WHERE rr <= 12), 4) AS trailing_actual, round(sum(impact) FILTER (WHERE rr <= 12), 5) AS trailing_impact,
    any_value(key) FILTER (WHERE rr = 1) AS current_month, round(any_value(impact) FILTER (WHERE rr = 1), 5) AS current_impact,
    arg_min(key, impact) FILTER (WHERE impact < 0) AS worst_month, round(min(impact) FILTER (WHERE impact < 0), 5) AS worst_impact FROM bench""",
)
def trailing_12(spark, sf):
    return P.trailing_12(P.monthly_benchmark(P.monthly_totals(payments(spark, sf, [])))).select(
        r("trailing_actual", 4), r("trailing_impact", 5), "current_month", r("current_impact", 5), "worst_month", r("worst_impact", 5)
    )


@query(
    "analysis_health",
    f"WITH {MONTHLY} SELECT count(*) AS months, cast(sum(transactions) AS BIGINT) AS rows, cast(45 + least(25, count(*)) + 20 + CASE WHEN sum(transactions) >= 1000000 THEN 10 ELSE 5 END AS DOUBLE) AS analysis_health FROM monthly WHERE amount <> 0",
)
def analysis_health(spark, sf):
    return P.analysis_health(payments(spark, sf), DIMS).select("months", "rows", r("analysis_health"))


@query(
    "top_n_per_dimension",
    f"""WITH {TOP} SELECT dimension, value, rank, round(amount, 4) AS amount, transactions, round(share, 8) AS share_of_spend,
    round(amount / transactions, 8) AS average_transaction FROM topn""",
)
def top_n_per_dimension(spark, sf):
    return P.top_n_per_dimension(payments(spark, sf), DIMS).select(
        "dimension", "value", F.col("rank").cast("bigint").alias("rank"), r("amount", 4), "transactions",
        r("share_of_spend", 8), r("average_transaction", 8),
    )


@query(
    "concentration_rank",
    f"WITH {TOP} SELECT dimension, value, round(share, 8) AS share_of_spend FROM topn WHERE rank = 1 ORDER BY share DESC, dimension",
)
def concentration_rank(spark, sf):
    return P.concentration_rank(P.top_n_per_dimension(payments(spark, sf), DIMS)).select("dimension", "value", r("share_of_spend", 8))


@query(
    "dimension_matrix",
    f"""WITH {matrix_sql('account')} SELECT category, key, partial_period, round(a, 4) AS actual, round(e, 3) AS expected, cast(t AS BIGINT) AS transactions,
    round(e - a, 3) AS business_impact, round((a - e) / nullif(abs(e), 0), 6) AS variance_pct FROM cells""",
)
def dimension_matrix(spark, sf):
    return P.dimension_matrix(payments(spark, sf, ["account"]), "account").select(
        "category", "key", "partial_period", r("actual", 4), r("expected", 3), "transactions", r("business_impact", 3), r("variance_pct")
    )


@query(
    "matrix_densify",
    f"WITH {matrix_sql('vendor')} SELECT category, key, round(a, 4) AS cell_actual, cast(t AS BIGINT) AS cell_transactions FROM dense",
)
def matrix_densify(spark, sf):
    df = payments(spark, sf, ["vendor"])
    periods = P.monthly_totals(df).filter("amount <> 0").select("key", "period_start")
    sparse = df.groupBy(F.col("vendor").alias("category"), P._key(P.FIELDS).alias("key")).agg(
        F.sum("dollar_amount").cast("double").alias("cell_actual"), F.count("*").alias("cell_transactions")
    )
    return P.matrix_densify(periods, P._top_values(df, "vendor", 8, P.FIELDS), sparse).select(
        "category", "key", r("cell_actual", 4), "cell_transactions"
    )


@query(
    "rolling_median_share",
    f"WITH {matrix_sql('fund_group')} SELECT category, key, round(share, 8) AS share, round(e / pe, 8) AS expected_share FROM cells0",
)
def rolling_median_share(spark, sf):
    df = payments(spark, sf, ["fund_group"])
    periods = P.monthly_totals(df).filter("amount <> 0").withColumnRenamed("amount", "actual")
    sparse = df.groupBy(F.col("fund_group").alias("category"), P._key(P.FIELDS).alias("key")).agg(
        F.sum("dollar_amount").cast("double").alias("cell_actual"), F.count("*").alias("cell_transactions")
    )
    dense = P.matrix_densify(periods, P._top_values(df, "fund_group", 8, P.FIELDS), sparse)
    return P.rolling_median_share(dense).select("category", "key", r("share", 8), r("expected_share", 8))


@query(
    "matrix_reconciliation",
    f"""WITH {matrix_sql('account')}, l AS (SELECT sum(e - a) AS m FROM cells WHERE period_start = (SELECT max(period_start) FROM cells))
    SELECT key, round(m, 3) AS matrix_impact, round(impact, 3) AS scope_impact, abs(m - impact) <= greatest(0.01, abs(impact) * 1e-9) AS reconciles FROM bench, l WHERE rr = 1""",
)
def matrix_reconciliation(spark, sf):
    df = payments(spark, sf, ["account"])
    out = P.reconciliation(P.dimension_matrix(df, "account"), P.monthly_benchmark(P.monthly_totals(df)))
    return out.select("key", r("matrix_impact", 3), r("scope_impact", 3), "reconciles")


@query(
    "waterfall",
    f"""WITH {matrix_sql('account')}, l AS (SELECT category, e - a AS impact FROM cells WHERE period_start = (SELECT max(period_start) FROM cells)),
    w AS (SELECT row_number() OVER o AS step, category, impact, sum(impact) OVER o AS en FROM l WINDOW o AS (ORDER BY abs(impact) DESC, category ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT cast(step AS INTEGER) AS step, category, round(impact, 3) AS business_impact, round(en - impact, 3) AS start, round(en, 3) AS "end", round(least(en - impact, en), 3) AS base FROM w
    UNION ALL SELECT cast(count(*) + 1 AS INTEGER), 'Net impact', round(sum(impact), 3), 0.0, round(sum(impact), 3), round(least(0, sum(impact)), 3) FROM l""",
)
def waterfall(spark, sf):
    matrix = P.dimension_matrix(payments(spark, sf, ["account"]), "account")
    zero = lambda c: (F.round(F.col(c), 3) + 0.0).alias(c)
    return P.waterfall(P.latest_contributions(matrix)).select(
        "step", "category", zero("business_impact"), zero("start"), zero("end"), zero("base")
    )


def children_sql(path_where, path, level, k, other):
    parent = "sha256('root')"
    for step in path:
        parent = f"sha256({parent} || '|' || '{step.replace('=', '|')}')"
    base = f"""{PAYMENTS}, sums AS (SELECT {level} AS value, cast(sum(dollar_amount) AS DOUBLE) AS amount, count(*) AS transactions FROM payments WHERE {path_where} GROUP BY 1),
tot AS (SELECT sum(amount) AS pa, sum(transactions) AS pt FROM sums),
shown AS (SELECT *, TRUE AS drillable FROM sums WHERE value IS NOT NULL ORDER BY amount DESC, value LIMIT {k}),
rest AS (SELECT 'Other categories' AS value, greatest(0, any_value(pa) - sum(amount)) AS amount, greatest(0, any_value(pt) - sum(transactions)) AS transactions, FALSE AS drillable FROM shown, tot),
al AS (SELECT * FROM shown UNION ALL SELECT rest.* FROM rest, tot WHERE {other} AND amount > abs(pa) * 0.005)"""
    return f"""WITH {base} SELECT sha256({parent} || '|{level}|' || value) AS node_id, {parent} AS parent_node_id, '{level}' AS level, value, round(amount, 4) AS amount,
  cast(transactions AS BIGINT) AS transactions, round(amount / pa, 8) AS share_of_parent, drillable FROM al, tot"""


def _children(df):
    return df.select("node_id", "parent_node_id", "level", "value", r("amount", 4), "transactions", r("share_of_parent", 8), "drillable")


@query(
    "hierarchy_children",
    children_sql("department = 'ASIA' AND fund_group = 'BUILDING'", ["department=ASIA", "fund_group=BUILDING"], "account", 7, "TRUE"),
)
def hierarchy_children(spark, sf):
    df = payments(spark, sf, ["department", "fund_group", "account"])
    return _children(P.hierarchy_children(df, [("department", "ASIA"), ("fund_group", "BUILDING")], "account", DIMS))


@query(
    "hierarchy_children_flat",
    children_sql("department = 'ASIA'", ["department=ASIA"], "vendor", 9, "FALSE"),
)
def hierarchy_children_flat(spark, sf):
    df = payments(spark, sf, ["department", "vendor"])
    return _children(P.hierarchy_children(df, [("department", "ASIA")], "vendor", DIMS, P.TOP_CHILDREN_FLAT, False))


TREE = ["department", "activity", "fund_group", "expenditure_type", "account"]


def _tree_sql() -> str:
    ids = ["sha256('root')"]
    for d in TREE:
        ids.append(f"sha256({ids[-1]} || '|{d}|' || {d})")
    nodes = " UNION ALL ".join(
        f"SELECT {ids[i]} AS node_id, {ids[i - 1] if i else 'NULL'} AS parent_node_id, {i} AS level_index, {repr(TREE[i - 1]) if i else 'NULL'} AS level, {TREE[i - 1] if i else 'NULL'} AS value, a, t, leaf FROM leaves"
        f"{f' WHERE {TREE[i - 1]} IS NOT NULL' if i else ''}"
        for i in range(len(TREE) + 1)
    )
    cut = ", ".join(f"CASE WHEN {' AND '.join(f'{x} IS NOT NULL' for x in TREE[: i + 1])} THEN {d} END AS {d}" for i, d in enumerate(TREE))
    return f"""WITH {PAYMENTS}, gaps AS (SELECT * REPLACE (CASE WHEN expenditure_type <> 'R' THEN expenditure_type END AS expenditure_type) FROM payments),
    cut AS (SELECT {cut}, dollar_amount FROM gaps WHERE dollar_amount IS NOT NULL),
    sums AS (SELECT {", ".join(TREE)}, sum(dollar_amount) AS a, count(*) AS t FROM cut GROUP BY ALL),
    leaves AS (SELECT *, row_number() OVER (ORDER BY {", ".join(f"{d} NULLS FIRST" for d in TREE)}) - 1 AS leaf FROM sums),
    nodes AS (SELECT node_id, parent_node_id, level_index, level, value, cast(sum(a) AS DOUBLE) AS amount, cast(sum(t) AS BIGINT) AS transactions, min(leaf) AS first_leaf, max(leaf) + 1 AS end_leaf FROM ({nodes}) GROUP BY ALL)
    SELECT n.node_id, n.parent_node_id, n.level_index, n.level, n.value, round(n.amount, 4) AS amount, n.transactions, n.first_leaf, n.end_leaf, round(CASE WHEN p.node_id IS NULL THEN 1 ELSE n.amount / p.amount END, 8) AS share_of_parent
    FROM nodes n LEFT JOIN nodes p ON p.node_id = n.parent_node_id"""


@query("hierarchy_tree", _tree_sql())
def hierarchy_tree(spark, sf):
    df = payments(spark, sf, TREE).withColumn("expenditure_type", F.when(F.col("expenditure_type") != "R", F.col("expenditure_type")))
    return P.hierarchy_tree(df, TREE).select(
        "node_id", "parent_node_id", "level_index", "level", "value", r("amount", 4), "transactions", "first_leaf", "end_leaf", r("share_of_parent", 8)
    )


@query(
    "hierarchy_path_filter",
    f"WITH {PAYMENTS} SELECT fund, count(*) AS transactions, round(cast(sum(dollar_amount) AS DOUBLE), 4) AS amount FROM payments WHERE department = 'EUROPE' AND fund_type = 'O' GROUP BY fund",
)
def hierarchy_path_filter_query(spark, sf):
    df = payments(spark, sf, ["department", "fund_type", "fund"])
    rows = hierarchy_path_filter(df, [("department", "EUROPE"), ("fund_type", "O"), ("lob", "Payments")], DIMS)
    return rows.groupBy("fund").agg(F.count("*").alias("transactions"), F.round(F.sum("dollar_amount").cast("double"), 4).alias("amount"))
