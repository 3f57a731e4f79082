"""Data-quality queries over the fact with gaps and the customer table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from variscope.catalog.registry import FACT, GAPS, canon, day, query, r
from variscope.functions.timeparse import parse_time_value
from variscope.operators import quality as Q
from variscope.sources.warehouse import DIMENSIONS, FACT_MISSING_COLUMNS, fact, fact_with_gaps, table

AS_OF = date(2001, 10, 1)
OPTIONS = Q.QualityOptions(AS_OF, required=("actual", "cost_center"), keys=("supplier",), freshness_days=30)
TEXTS = ", ".join(f"cast({c} AS VARCHAR) AS {c}" for c in FACT_MISSING_COLUMNS)

# One CTE per step: cells, distinct values, per-column aggregates, the profile.
PROFILE = f"""{GAPS}, cells AS (SELECT col, value, nullif(trim(value), '') IS NULL AS missing FROM
  (SELECT {TEXTS} FROM gaps) UNPIVOT INCLUDE NULLS (value FOR col IN ({", ".join(FACT_MISSING_COLUMNS)}))),
vals AS (SELECT col, value, count(*) AS n, CASE WHEN regexp_matches(trim(value), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') THEN try_cast(value AS DOUBLE) END AS num,
    CASE WHEN regexp_matches(value, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') THEN try_cast(value AS DATE) END AS dt, lower(regexp_replace(trim(value), '\\s+', ' ', 'g')) AS norm
  FROM cells WHERE NOT missing GROUP BY ALL),
base AS (SELECT col, count(*) AS row_count, count(*) FILTER (WHERE missing) AS null_count FROM cells GROUP BY col),
va AS (SELECT col, count(*) AS distinct_count, sum(n) AS non_null, max(n) AS top, sum(n) FILTER (WHERE num IS NOT NULL) AS nums, sum(n) FILTER (WHERE num IS NULL) AS strs,
  sum(n) FILTER (WHERE dt IS NOT NULL) AS dates, sum(n) FILTER (WHERE dt IS NULL) AS bad_dates, min(dt) AS min_dt, max(dt) AS max_dt, sum(n) FILTER (WHERE dt > DATE '{AS_OF}' + 1) AS future,
  bool_or(regexp_matches(value, '(?:\\+?\\d[\\s().-]*){{9,}}')) AS phone FROM vals GROUP BY col),
numcells AS (SELECT col, try_cast(value AS DOUBLE) AS v FROM cells WHERE NOT missing AND col IN (SELECT col FROM va WHERE nums > 0)),
qs AS (SELECT col, quantile_cont(v, 0.25) AS q1, median(v) AS med, quantile_cont(v, 0.75) AS q3, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS mn, max(v) AS mx,
  count(v) AS nc, count(*) FILTER (WHERE v = 0) AS zeros, count(*) FILTER (WHERE v < 0) AS neg FROM numcells WHERE v IS NOT NULL GROUP BY col),
outl AS (SELECT col, count(*) FILTER (WHERE q3 > q1 AND (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1))) AS oc,
  count(*) FILTER (WHERE q3 > q1 AND (v < q1 - 3 * (q3 - q1) OR v > q3 + 3 * (q3 - q1))) AS xc FROM numcells JOIN qs USING (col) GROUP BY col),
norms AS (SELECT col, norm, count(*) AS spellings, sum(n) AS rows FROM vals WHERE num IS NULL GROUP BY ALL),
strs AS (SELECT col, sum(rows) FILTER (WHERE spellings > 1) AS coll FROM norms GROUP BY col),
edges AS (SELECT col, sum(n) FILTER (WHERE value <> trim(value)) AS ws, min(length(value)) AS minl, max(length(value)) AS maxl, sum(n * length(value)) / sum(n) AS avgl, sum(n) AS tc FROM vals WHERE num IS NULL GROUP BY col),
pf0 AS (SELECT base.col, row_count, null_count, null_count / row_count AS null_rate, coalesce(distinct_count, 0) AS dc, coalesce(non_null, 0) AS nn, coalesce(top, 0) / row_count AS top_share,
  coalesce(nums, 0) AS nums, coalesce(strs, 0) AS strs, coalesce(dates, 0) AS dates, bad_dates, future, min_dt, max_dt, coalesce(phone, FALSE) AS phone, coalesce(oc, 0) AS oc, coalesce(xc, 0) AS xc, nc, q1, med, q3,
  coalesce(coll, 0) AS coll, coalesce(ws, 0) AS ws FROM base LEFT JOIN va USING (col) LEFT JOIN qs USING (col) LEFT JOIN outl USING (col) LEFT JOIN strs USING (col) LEFT JOIN edges USING (col)),
pf1 AS (SELECT *, dc / nn AS uniq, greatest(nums, strs) / nn AS tc, nums / nn >= 0.8 AS has_num, dates / nn >= 0.5 AND dates > 0 AS has_dt, dc > greatest(80, 0.2 * row_count) AS high, dc <= 1 AS const,
  CASE WHEN nums / nn >= 0.95 THEN 'numeric' WHEN dates / nn >= 0.9 THEN 'date' WHEN dc / row_count >= 0.92 THEN 'identifier' ELSE 'categorical' END AS kind FROM pf0),
pf2 AS (SELECT *, NOT const AND top_share >= 0.98 AS near, (uniq >= 0.98 AND high) AS ident, CASE WHEN has_num THEN oc / nc ELSE 0 END AS orate FROM pf1),
pf AS (SELECT *, CASE WHEN ident THEN 'identifier' WHEN kind = 'numeric' AND tc >= 0.9 AND null_rate < 0.5 AND NOT const THEN 'measure'
    WHEN kind IN ('categorical', 'date') AND dc > 1 AND NOT high AND null_rate < 0.7 THEN 'dimension' ELSE 'excluded' END AS role,
  100 * (0.42 * (1 - null_rate) + 0.28 * tc + 0.18 * (1 - least(1, (ws + coll) / (2 * nn))) + 0.12 * (1 - least(1, orate * 1.5 + CASE WHEN const THEN 0.3 WHEN near THEN 0.12 ELSE 0 END))) AS quality FROM pf2)"""


def _profiler(spark, sf):
    return Q.Profiler(fact_with_gaps(spark, sf), OPTIONS)


@query(
    "column_profile",
    f"""WITH {PROFILE} SELECT col AS "column", row_count, null_count, dc AS distinct_count, round(null_rate, 8) AS null_rate, round(uniq, 8) AS uniqueness_rate, round(tc, 8) AS type_consistency,
    kind AS inferred_kind, const AS constant, near AS near_constant, high AS high_cardinality, ident AS identifier_candidate, phone AS potential_sensitive, role AS analysis_role, round(quality, 6) AS quality_score FROM pf""",
)
def column_profile(spark, sf):
    return Q.column_profile(_profiler(spark, sf)).select(
        "column", "row_count", "null_count", "distinct_count", r("null_rate", 8), r("uniqueness_rate", 8), r("type_consistency", 8),
        "inferred_kind", "constant", "near_constant", "high_cardinality", "identifier_candidate", "potential_sensitive",
        "analysis_role", r("quality_score"),
    )


@query("analysis_role", f"""WITH {PROFILE} SELECT role AS analysis_role, kind AS inferred_kind, count(*) AS columns FROM pf GROUP BY ALL""")
def analysis_role(spark, sf):
    return Q.column_profile(_profiler(spark, sf)).groupBy("analysis_role", "inferred_kind").agg(F.count("*").alias("columns"))


@query(
    "profile_fields",
    f"""WITH {PROFILE} SELECT col AS "column", dc AS distinct_count, null_count, CASE WHEN nn > 20 AND uniq >= 0.98 AND dc > greatest(80, 0.2 * row_count) THEN 'identifier'
      WHEN nums / nn >= 0.95 THEN 'numeric' WHEN dates / nn >= 0.9 THEN 'date' WHEN nn > 20 AND uniq >= 0.92 THEN 'identifier' ELSE 'categorical' END AS kind FROM pf""",
)
def profile_fields(spark, sf):
    return Q.profile_fields(_profiler(spark, sf))


@query(
    "outliers_iqr",
    f"""WITH {PROFILE} SELECT pf.col AS "column", pf.nc AS numeric_count, round(pf.q1, 6) AS q1, round(pf.med, 6) AS median, round(pf.q3, 6) AS q3, round(mean, 4) AS mean, round(std, 4) AS standard_deviation,
    mn AS min, mx AS max, zeros, neg AS negatives, oc AS outlier_count, xc AS extreme_outlier_count, round((mean - pf.med) / std, 6) AS skew_indicator FROM pf JOIN qs USING (col)""",
)
def outliers_iqr(spark, sf):
    return Q.outliers_iqr(_profiler(spark, sf)).select(
        "column", "numeric_count", r("q1"), r("median"), r("q3"), r("mean", 4), r("standard_deviation", 4), "min", "max",
        "zeros", "negatives", "outlier_count", "extreme_outlier_count", r("skew_indicator"),
    )


@query(
    "string_variants",
    f"""WITH t AS (SELECT 'segment' AS col, CASE WHEN c_acctbal < 0 THEN lower(c_mktsegment) WHEN c_acctbal > 9000 THEN c_mktsegment || ' ' ELSE c_mktsegment END AS value FROM customer
      UNION ALL SELECT 'name', c_name FROM customer),
    v AS (SELECT col, value, count(*) AS n, lower(regexp_replace(trim(value), '\\s+', ' ', 'g')) AS norm FROM t GROUP BY ALL),
    g AS (SELECT col, norm, count(*) AS sp, sum(n) AS rows FROM v GROUP BY ALL)
    SELECT col AS "column", cast(sum(n) AS BIGINT) AS text_count, min(length(value)) AS min_length, max(length(value)) AS max_length, round(sum(n * length(value)) / sum(n), 6) AS average_length,
      cast(coalesce(sum(n) FILTER (WHERE value <> trim(value)), 0) AS BIGINT) AS whitespace_count,
      cast((SELECT coalesce(sum(rows) FILTER (WHERE sp > 1), 0) FROM g WHERE g.col = v.col) AS BIGINT) AS collision_rows FROM v GROUP BY col""",
)
def string_variants(spark, sf):
    c = table(spark, sf, "customer")
    segment = F.when(F.col("c_acctbal") < 0, F.lower("c_mktsegment")).when(
        F.col("c_acctbal") > 9000, F.concat("c_mktsegment", F.lit(" "))
    ).otherwise(F.col("c_mktsegment"))
    df = c.select(segment.alias("segment"), F.col("c_name").alias("name"))
    return Q.string_variants(Q.Profiler(df, OPTIONS)).select(
        "column", "text_count", F.col("min_length").cast("bigint").alias("min_length"), F.col("max_length").cast("bigint").alias("max_length"),
        r("average_length"), "whitespace_count", "collision_rows",
    )


@query(
    "sensitive_scan",
    """WITH t AS (SELECT 'customer_id' AS col, cast(c_custkey AS VARCHAR) AS v FROM customer UNION ALL SELECT 'full_name', c_name FROM customer
      UNION ALL SELECT 'contact', lower(replace(c_name, '#', '.')) || '@' || lower(c_mktsegment) || '.example' FROM customer UNION ALL SELECT 'segment', c_mktsegment FROM customer
      UNION ALL SELECT 'badge', lpad(cast(c_custkey AS VARCHAR), 3, '0') || '-' || lpad(cast(c_nationkey AS VARCHAR), 2, '0') || '-' || substr(c_name, 15, 4) FROM customer),
    f AS (SELECT col, bool_or(regexp_matches(v, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$')) AS e, bool_or(regexp_matches(v, '(?:\\+?\\d[\\s().-]*){9,}')) AS p, bool_or(regexp_matches(v, '^\\d{3}-\\d{2}-\\d{4}$')) AS s FROM t GROUP BY col),
    x AS (SELECT col, concat_ws(',', CASE WHEN col = 'full_name' THEN 'name' END, CASE WHEN e THEN 'email' END, CASE WHEN p THEN 'phone' END, CASE WHEN s THEN 'ssn' END) AS rs FROM f)
    SELECT col AS "column", rs AS sensitive_reasons, rs <> '' AS potential_sensitive FROM x""",
)
def sensitive_scan(spark, sf):
    c = table(spark, sf, "customer")
    contact = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example"))
    badge = F.concat(
        F.lpad(F.col("c_custkey").cast("string"), 3, "0"), F.lit("-"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"),
        F.lit("-"), F.substring("c_name", 15, 4),
    )
    df = c.select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("full_name"), contact.alias("contact"),
        F.col("c_mktsegment").alias("segment"), badge.alias("badge"),
    )
    return Q.sensitive_scan(Q.Profiler(df, OPTIONS))


TIMES = """times AS (SELECT o_orderkey, CASE
    WHEN o_orderstatus = 'P' AND o_orderpriority = '4-NOT SPECIFIED' THEN 'pending'
    WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN strftime(o_orderdate, '%Y') || '-02-31'
    WHEN o_orderpriority = '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderpriority = '2-HIGH' THEN strftime(o_orderdate, '%Y-%m')
    WHEN o_orderpriority = '3-MEDIUM' THEN year(o_orderdate) || '-Q' || quarter(o_orderdate) WHEN o_orderpriority = '4-NOT SPECIFIED' THEN isoyear(o_orderdate) || '-W' || weekofyear(o_orderdate)
    ELSE strftime(o_orderdate, '%-m/%-d/%Y') END AS period, cast(o_orderdate AS DATE) AS d, o_orderstatus, o_orderpriority FROM orders)"""


def order_times(spark, sf):
    """Orders with their date in a different spelling per priority, some of them unusable."""
    o = table(spark, sf, "orders").withColumn("d", F.col("o_orderdate").cast("date"))
    p, pending = F.col("o_orderpriority"), F.col("o_orderstatus") == "P"
    year = F.year("d").cast("string")
    thursday = F.date_add(F.trunc("d", "week"), 3)
    text = (
        F.when(pending & (p == "4-NOT SPECIFIED"), "pending")
        .when(pending & (p == "5-LOW"), F.concat(year, F.lit("-02-31")))
        .when(p == "1-URGENT", F.date_format("d", "yyyy-MM-dd"))
        .when(p == "2-HIGH", F.date_format("d", "yyyy-MM"))
        .when(p == "3-MEDIUM", F.concat(year, F.lit("-Q"), F.quarter("d").cast("string")))
        .when(p == "4-NOT SPECIFIED", F.concat(F.year(thursday).cast("string"), F.lit("-W"), F.weekofyear("d").cast("string")))
        .otherwise(F.date_format("d", "M/d/yyyy"))
    )
    return o.select("o_orderkey", text.alias("period"), "d", "o_orderstatus", "o_orderpriority")


PARSED = f"""{TIMES}, parsed AS (SELECT *, CASE WHEN period = 'pending' OR period LIKE '%-02-31' THEN 'unparsed' WHEN o_orderpriority = '2-HIGH' THEN 'month' WHEN o_orderpriority = '3-MEDIUM' THEN 'quarter'
  WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'week' ELSE 'day' END AS precision,
  CASE WHEN period = 'pending' OR period LIKE '%-02-31' THEN NULL WHEN o_orderpriority = '2-HIGH' THEN cast(date_trunc('month', d) AS DATE) WHEN o_orderpriority = '3-MEDIUM' THEN cast(date_trunc('quarter', d) AS DATE)
  WHEN o_orderpriority = '4-NOT SPECIFIED' THEN cast(date_trunc('week', d) AS DATE) ELSE d END AS day FROM times)"""


@query(
    "parse_time_column",
    f"WITH {PARSED} SELECT precision, count(*) AS rows, cast(min(day) AS VARCHAR) AS min_date, cast(max(day) AS VARCHAR) AS max_date FROM parsed GROUP BY 1",
)
def parse_time_column(spark, sf):
    return Q.parse_time_report(order_times(spark, sf), "period").select("precision", "rows", day("min_date"), day("max_date"))


SPELLINGS = ["MMMM d, yyyy", "d MMM yyyy", "yyyy/MM/dd HH:mm", "M/d/yyyy h:mm a", "MMM yyyy", "d-MMM-yyyy", "EEE, d MMM yyyy HH:mm:ss", "M-d-yyyy"]


@query(
    "parse_free_dates",
    f"""SELECT o_orderkey, strftime(CASE CAST(o_custkey % {len(SPELLINGS) + 1} AS INTEGER) WHEN 2 THEN date_trunc('day', d) + INTERVAL 10 HOUR WHEN 3 THEN date_trunc('day', d) + INTERVAL 10 HOUR
      WHEN 4 THEN date_trunc('month', d) WHEN 6 THEN date_trunc('day', d) + INTERVAL 10 HOUR WHEN {len(SPELLINGS)} THEN NULL ELSE date_trunc('day', d) END, '%Y-%m-%d %H:%M') AS read
    FROM (SELECT *, cast(o_orderdate AS TIMESTAMP) AS d FROM orders)""",
)
def parse_free_dates(spark, sf):
    """Every order's date, spelled in one of several ways by its customer; the last way is no date."""
    o = table(spark, sf, "orders")
    at = F.date_trunc("day", F.col("o_orderdate").cast("timestamp")) + F.expr("INTERVAL 10 HOURS")
    way = F.col("o_custkey") % (len(SPELLINGS) + 1)
    spelled = F.coalesce(*[F.when(way == i, F.date_format(at, f)) for i, f in enumerate(SPELLINGS)], F.lit("one day in 2024"))
    texts = o.select("o_orderkey", spelled.alias("text"))
    return texts.select("o_orderkey", F.date_format(parse_time_value(texts, "text")["ts"], "yyyy-MM-dd HH:mm").alias("read"))


@query(
    "detect_time_fields",
    f"""WITH {PARSED}, x AS (SELECT 'period' AS field, day, precision FROM parsed UNION ALL SELECT 'd', d, 'day' FROM times),
    f AS (SELECT field, count(*) AS n, count(day) AS k, count(DISTINCT day) AS dp, min(day) AS mn, max(day) AS mx FROM x GROUP BY 1)
    SELECT field, round(k / n, 8) AS parse_rate, dp AS distinct_periods, cast(mn AS VARCHAR) AS min_date, cast(mx AS VARCHAR) AS max_date,
      CASE field WHEN 'period' THEN 'month' ELSE 'day' END AS suggested_grain, round(least(1, k / n * 0.82 + least(0.12, dp / 100) + CASE field WHEN 'period' THEN 0.12 ELSE 0 END), 8) AS confidence FROM f""",
)
def detect_time_fields(spark, sf):
    found = Q.detect_time_fields(order_times(spark, sf), ["period", "d", "o_orderstatus", "o_orderpriority"])
    return found.select(
        "field", r("parse_rate", 8), "distinct_periods", day("min_date"), day("max_date"), "suggested_grain", r("confidence", 8)
    )


@query(
    "date_quality",
    f"""WITH {TIMES}, x AS (SELECT 'period' AS col, CASE WHEN period = 'pending' OR period LIKE '%-02-31' OR o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN NULL
      WHEN o_orderpriority = '2-HIGH' THEN cast(date_trunc('month', d) AS DATE) ELSE d END AS v FROM times UNION ALL SELECT 'd', d FROM times)
    SELECT col AS "column", count(v) AS valid_dates, count(*) - count(v) AS invalid_dates, cast(min(v) AS VARCHAR) AS min_date, cast(max(v) AS VARCHAR) AS max_date,
      count(*) FILTER (WHERE v > DATE '{AS_OF}' + 1) AS future_dates, cast(DATE '{AS_OF}' - max(v) AS INTEGER) AS days_since_latest FROM x GROUP BY 1""",
)
def date_quality(spark, sf):
    p = Q.Profiler(order_times(spark, sf), OPTIONS, ["period", "d", "o_orderstatus"])
    return Q.date_quality(p).select("column", "valid_dates", "invalid_dates", day("min_date"), day("max_date"), "future_dates", "days_since_latest")


@query(
    "top_values",
    f"""WITH {PROFILE} SELECT col AS "column", value, n AS count, round(n / 60000.0, 8) AS share, row_number() OVER (PARTITION BY col ORDER BY n DESC, value) AS rank FROM vals
    WHERE col IN ('brand', 'region', 'supplier', 'priority', 'period_date') QUALIFY rank <= 10""".replace("60000.0", "(SELECT count(*) FROM gaps)"),
)
def top_values(spark, sf):
    columns = ["brand", "region", "supplier", "priority", "period_date"]
    p = Q.Profiler(fact_with_gaps(spark, sf, columns), OPTIONS)
    return Q.top_values(p).select("column", "value", "count", r("share", 8), F.col("rank").cast("bigint").alias("rank"))


EVENT_COLUMNS = "event_type, user_id, value"


@query(
    "duplicate_rows",
    """WITH x AS (SELECT cast(ts AS DATE) AS d, event_type, user_id, count(*) AS n FROM events GROUP BY ALL)
    SELECT cast(sum(n) AS BIGINT) AS row_count, cast(sum(n - 1) AS BIGINT) AS duplicate_rows, round(sum(n - 1) / sum(n), 8) AS duplicate_rate FROM x""",
)
def duplicate_rows(spark, sf):
    df = table(spark, sf, "events").select(F.col("ts").cast("date").alias("d"), "event_type", "user_id")
    return Q.duplicate_rows(df).select("row_count", "duplicate_rows", r("duplicate_rate", 8))


@query(
    "missing_cells",
    f"""WITH {GAPS} SELECT count(*) AS row_count, count(*) * 14 AS cell_count, cast(sum((actual IS NULL)::INT + (priority IS NULL)::INT + (nullif(trim(region), '') IS NULL)::INT) AS BIGINT) AS missing_cells,
    round(sum((actual IS NULL)::INT + (priority IS NULL)::INT + (nullif(trim(region), '') IS NULL)::INT) / (count(*) * 14), 8) AS missing_rate, cast(0 AS BIGINT) AS empty_rows FROM gaps""",
)
def missing_cells(spark, sf):
    return Q.missing_cells(fact_with_gaps(spark, sf)).select("row_count", "cell_count", "missing_cells", r("missing_rate", 8), "empty_rows")


@query(
    "empty_rows",
    f"""WITH {GAPS} SELECT count(*) AS row_count, count(*) FILTER (WHERE actual IS NULL AND priority IS NULL AND nullif(trim(region), '') IS NULL) AS empty_rows FROM gaps""",
)
def empty_rows(spark, sf):
    columns = ["actual", "priority", "region"]
    return Q.missing_cells(fact_with_gaps(spark, sf, columns), columns).select("row_count", "empty_rows")


@query("infer_kind", f"""WITH {PROFILE} SELECT col AS "column", kind AS inferred_kind FROM pf""")
def infer_kind(spark, sf):
    return _profiler(spark, sf).profile.select("column", "inferred_kind")


@query(
    "identifier_name",
    """SELECT 'order_id' AS "column", TRUE AS identifier_name, count(DISTINCT o_orderkey) AS distinct_count FROM orders UNION ALL SELECT 'customer_id', TRUE, count(DISTINCT o_custkey) FROM orders
    UNION ALL SELECT 'accountId', TRUE, count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'paid', TRUE, count(DISTINCT o_orderstatus) FROM orders UNION ALL SELECT 'identity', FALSE, count(DISTINCT o_orderstatus) FROM orders""",
)
def identifier_name(spark, sf):
    df = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_custkey").alias("accountId"),
        F.col("o_orderstatus").alias("paid"), F.col("o_orderstatus").alias("identity"),
    )
    return Q.profile_fields(Q.Profiler(df, OPTIONS)).select(
        "column", Q.identifier_name(F.col("column")).alias("identifier_name"), "distinct_count"
    )


@query(
    "missing_patterns",
    f"""WITH {GAPS}, x AS (SELECT concat_ws('|', CASE WHEN actual IS NULL THEN 'actual' END, CASE WHEN priority IS NULL THEN 'priority' END, CASE WHEN nullif(trim(region), '') IS NULL THEN 'region' END) AS columns FROM gaps)
    SELECT columns, count(*) AS count, round(count(*) / (SELECT count(*) FROM gaps), 8) AS share FROM x WHERE columns <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12""",
)
def missing_patterns(spark, sf):
    return Q.missing_patterns(fact_with_gaps(spark, sf)).select("columns", "count", r("share", 8))


@query(
    "correlations",
    f"""WITH {FACT}, f AS (SELECT cast(actual AS DOUBLE) AS actual, cast(target AS DOUBLE) AS target, cast(quantity AS DOUBLE) AS quantity, cast(extended_price AS DOUBLE) AS extended_price FROM fact),
    c AS (SELECT 'actual' AS "left", 'target' AS "right", corr(actual, target) AS c, count(*) AS n FROM f UNION ALL SELECT 'actual', 'quantity', corr(actual, quantity), count(*) FROM f
      UNION ALL SELECT 'actual', 'extended_price', corr(actual, extended_price), count(*) FROM f UNION ALL SELECT 'target', 'quantity', corr(target, quantity), count(*) FROM f
      UNION ALL SELECT 'target', 'extended_price', corr(target, extended_price), count(*) FROM f UNION ALL SELECT 'quantity', 'extended_price', corr(quantity, extended_price), count(*) FROM f)
    SELECT "left", "right", round(c, 6) AS correlation, n AS sample_size FROM c WHERE abs(c) >= 0.8 AND n >= 20""",
)
def correlations(spark, sf):
    df = fact(spark, sf, ["actual", "target", "quantity", "extended_price"])
    return Q.correlations(df, df.columns).select("left", "right", r("correlation"), "sample_size")


FD_COLUMNS = ["region", "nation", "segment", "brand", "ptype", "returnflag", "linestatus", "priority"]


@query(
    "functional_dependencies",
    f"""WITH {GAPS}, n AS (SELECT row_number() OVER () AS id, {", ".join(f"nullif(trim({c}), '') AS {c}" for c in FD_COLUMNS)} FROM gaps),
    l AS (UNPIVOT n ON {", ".join(FD_COLUMNS)} INTO NAME col VALUE value),
    sz AS (SELECT col, count(DISTINCT value) AS k FROM l GROUP BY 1),
    pr AS (SELECT a.col AS det, b.col AS dep, a.value AS dv, count(*) AS n, count(DISTINCT b.value) AS k FROM l a JOIN l b ON a.id = b.id AND a.col <> b.col GROUP BY ALL),
    f AS (SELECT det, dep, sum(n) AS rows, coalesce(sum(n) FILTER (WHERE k = 1), 0) AS same FROM pr GROUP BY ALL)
    SELECT det AS determinant, dep AS dependent, round(same / rows, 8) AS confidence, cast(rows AS BIGINT) AS rows FROM f JOIN sz a ON a.col = det JOIN sz b ON b.col = dep
    WHERE a.k >= b.k AND a.k <= 60 AND b.k <= 60 AND rows >= 30 AND same / rows >= 0.98 ORDER BY same / rows DESC, f.rows DESC, det, dep LIMIT 20""",
)
def functional_dependencies(spark, sf):
    return Q.functional_dependencies(fact_with_gaps(spark, sf, FD_COLUMNS), FD_COLUMNS).select(
        "determinant", "dependent", r("confidence", 8), "rows"
    )


@query(
    "key_check",
    """SELECT 'o_orderkey' AS "column", count(*) - count(o_orderkey) AS null_count, round(count(DISTINCT o_orderkey) / count(*), 8) AS uniqueness_rate, count(DISTINCT o_orderkey) = count(*) AS valid FROM orders
    UNION ALL SELECT 'o_custkey', count(*) - count(o_custkey), round(count(DISTINCT o_custkey) / count(*), 8), count(DISTINCT o_custkey) = count(*) FROM orders""",
)
def key_check(spark, sf):
    p = Q.Profiler(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), OPTIONS)
    return Q.key_check(Q.column_profile(p), ["o_orderkey", "o_custkey"]).select("column", "null_count", r("uniqueness_rate", 8), "valid")


ISSUES = f"""{PROFILE}, dup AS (SELECT sum(n - 1) AS d, sum(n) AS t FROM (SELECT count(*) AS n FROM gaps GROUP BY {", ".join(f"nullif(trim(cast({c} AS VARCHAR)), '')" for c in FACT_MISSING_COLUMNS)})),
fresh AS (SELECT min(greatest(0, DATE '{AS_OF}' - max_dt)) AS days FROM pf WHERE has_dt),
issues AS (
  SELECT col AS "column", 'completeness' AS dimension, 'critical' AS severity, 'High missingness' AS title, null_count AS affected_rows FROM pf WHERE null_rate >= 0.4
  UNION ALL SELECT col, 'completeness', 'warning', 'Missing values', null_count FROM pf WHERE null_rate >= 0.05 AND null_rate < 0.4
  UNION ALL SELECT col, 'validity', CASE WHEN tc < 0.8 THEN 'critical' ELSE 'warning' END, 'Mixed runtime types', cast(round(nn * (1 - tc)) AS BIGINT) FROM pf WHERE tc < 0.95
  UNION ALL SELECT col, 'conformity', 'warning', 'Whitespace inconsistencies', cast(ws AS BIGINT) FROM pf WHERE ws > 0
  UNION ALL SELECT col, 'consistency', 'warning', 'Category variants', cast(coll AS BIGINT) FROM pf WHERE coll > 0
  UNION ALL SELECT col, 'distribution', CASE WHEN xc > 0 THEN 'warning' ELSE 'info' END, 'Potential numeric outliers', oc FROM pf WHERE has_num AND orate >= 0.02
  UNION ALL SELECT col, 'validity', CASE WHEN bad_dates / nn > 0.1 THEN 'critical' ELSE 'warning' END, 'Invalid date values', cast(bad_dates AS BIGINT) FROM pf WHERE has_dt AND bad_dates > 0
  UNION ALL SELECT col, 'validity', 'warning', 'Future-dated records', cast(future AS BIGINT) FROM pf WHERE has_dt AND future > 0
  UNION ALL SELECT col, 'distribution', 'info', 'Constant column', NULL FROM pf WHERE const
  UNION ALL SELECT col, 'distribution', 'info', 'Near-constant column', NULL FROM pf WHERE near
  UNION ALL SELECT col, 'readiness', 'info', 'Identifier-like column', NULL FROM pf WHERE ident
  UNION ALL SELECT col, 'privacy', 'warning', 'Potential sensitive data', NULL FROM pf WHERE phone
  UNION ALL SELECT NULL, 'uniqueness', CASE WHEN d / t >= 0.1 THEN 'critical' ELSE 'warning' END, 'Duplicate rows', cast(d AS BIGINT) FROM dup WHERE d > 0 AND d / t >= 0.005
  UNION ALL SELECT NULL, 'timeliness', CASE WHEN days > 90 THEN 'critical' ELSE 'warning' END, 'Freshness SLA missed', NULL FROM fresh WHERE days > 30
  UNION ALL SELECT 'cost_center', 'schema', 'critical', 'Required column missing', NULL
  UNION ALL SELECT col, 'integrity', 'critical', 'Key is not unique and complete', NULL FROM pf WHERE col = 'supplier' AND (null_count > 0 OR uniq < 1))"""


@query(
    "quality_issues",
    f"""WITH {ISSUES} SELECT "column", dimension, severity, title, affected_rows, dimension || ':' || coalesce("column", 'dataset') || ':' || title AS issue_id FROM issues""",
)
def quality_issues(spark, sf):
    return Q.quality_issues(_profiler(spark, sf))


@query(
    "quality_dimensions",
    f"""WITH {ISSUES}, s AS (SELECT sum(row_count) AS cells, sum(null_count) AS missing, any_value(row_count) AS n, avg(tc * 100) AS mc, sum(ws + coll) AS fmt, sum(CASE WHEN has_num THEN oc ELSE 0 END) AS outs,
      sum(CASE WHEN has_num THEN nc ELSE 0 END) AS nums, count(*) FILTER (WHERE role = 'measure') AS me, count(*) FILTER (WHERE role = 'dimension') AS di, count(*) FILTER (WHERE phone) AS se FROM pf),
    i AS (SELECT count(*) FILTER (WHERE severity = 'critical') AS blockers, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE dimension = 'validity' AND severity = 'critical') AS inv FROM issues),
    sc AS (SELECT 100 * (1 - missing / cells) AS completeness, 100 * (1 - d / t) AS uniqueness, greatest(0, mc - inv * 8) AS validity, 100 * (1 - least(1, fmt / cells * 3)) AS conformity, 100 - d / t * 100 AS integrity,
      100 * (1 - least(1, outs / greatest(nums, 1) * 2)) AS distribution, greatest(0, 100 * (1 - greatest(0, days - 30) / 90)) AS timeliness, CASE WHEN se > 0 THEN 75.0 ELSE 100.0 END AS privacy,
      CASE WHEN me > 0 THEN 45 ELSE 0 END + CASE WHEN di >= 2 THEN 45 ELSE di * 20 END + 10.0 AS readiness, blockers, warnings, me, di FROM s, dup, fresh, i),
    l AS (SELECT blockers, warnings, blockers = 0 AND me > 0 AND di >= 2 AS analysis_ready, unnest([{{'d': 'completeness', 's': completeness}}, {{'d': 'uniqueness', 's': uniqueness}}, {{'d': 'validity', 's': validity}}, {{'d': 'conformity', 's': conformity}},
      {{'d': 'integrity', 's': integrity}}, {{'d': 'distribution', 's': distribution}}, {{'d': 'timeliness', 's': timeliness}}, {{'d': 'accuracy', 's': NULL}}, {{'d': 'drift', 's': NULL}}, {{'d': 'lineage', 's': NULL}},
      {{'d': 'privacy', 's': privacy}}, {{'d': 'readiness', 's': readiness}},
      {{'d': 'overall', 's': (completeness + uniqueness + validity + conformity + integrity + distribution + timeliness + readiness) / 8}}]) AS x FROM sc)
    SELECT x.d AS dimension, round(cast(x.s AS DOUBLE), 6) AS score, CASE WHEN x.d = 'overall' THEN CASE WHEN x.s >= 95 THEN 'excellent' WHEN x.s >= 85 THEN 'good' WHEN x.s >= 70 THEN 'watch' ELSE 'poor' END
      WHEN x.d = 'privacy' THEN CASE WHEN x.s < 100 THEN 'warning' ELSE 'pass' END WHEN x.s IS NULL THEN 'not-configured' WHEN x.s >= 90 THEN 'pass' WHEN x.s >= 70 THEN 'warning' ELSE 'critical' END AS status,
      blockers, warnings, analysis_ready FROM l""",
)
def quality_dimensions(spark, sf):
    return Q.quality_dimensions(_profiler(spark, sf)).select("dimension", r("score"), "status", "blockers", "warnings", "analysis_ready")
