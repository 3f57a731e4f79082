"""Cohort queries: predicates, canonical values, windows, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from variscope.catalog.registry import FACT, GAPS, canon, day, query, r
from variscope.functions.values import canonical_category, finite_number
from variscope.operators import cohort as H
from variscope.sources.coerce import coerce_values, coercion_report
from variscope.sources.warehouse import fact, fact_with_gaps, table


@query(
    "apply_predicates",
    f"""WITH {GAPS} SELECT returnflag, count(*) AS count, round(cast(sum(target) AS DOUBLE), 4) AS target FROM gaps
    WHERE {canon('region')} = '(missing)' AND {canon('priority')} = '1-URGENT' GROUP BY 1""",
)
def apply_predicates(spark, sf):
    df = fact_with_gaps(spark, sf, ["region", "priority", "returnflag", "target"])
    rows = H.apply_predicates(df, [("region", "(missing)"), ("priority", "1-URGENT")])
    return rows.groupBy("returnflag").agg(F.count("*").alias("count"), F.round(F.sum("target").cast("double"), 4).alias("target"))


@query(
    "canonical_category",
    f"WITH {GAPS} SELECT {canon('region')} AS region, {canon('priority')} AS priority, count(*) AS count FROM gaps GROUP BY ALL",
)
def canonical_category_query(spark, sf):
    df = fact_with_gaps(spark, sf, ["region", "priority"])
    return df.groupBy(canonical_category(df, "region").alias("region"), canonical_category(df, "priority").alias("priority")).agg(
        F.count("*").alias("count")
    )


NUMBERS = """texts AS (SELECT o_orderstatus, CASE o_orderpriority WHEN '1-URGENT' THEN ' ' || cast(cast(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || ' ' WHEN '2-HIGH' THEN cast(o_custkey AS VARCHAR) || 'd'
  WHEN '3-MEDIUM' THEN 'NaN' WHEN '4-NOT SPECIFIED' THEN '' ELSE '-' || cast(o_custkey AS VARCHAR) || 'e1' END AS t FROM orders)"""


@query(
    "finite_number",
    f"""WITH {NUMBERS}, n AS (SELECT o_orderstatus, CASE WHEN regexp_matches(trim(t), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') THEN try_cast(trim(t) AS DECIMAL(18,2)) END AS v, t FROM texts)
    SELECT o_orderstatus, count(*) AS rows, count(v) AS valid_rows, round(cast(sum(v) AS DOUBLE), 2) AS total FROM (SELECT o_orderstatus, t, coalesce(v, CASE WHEN t LIKE '-%e1' THEN cast(cast(replace(t, 'e1', '0') AS BIGINT) AS DECIMAL(18,2)) END) AS v FROM n) GROUP BY 1""",
)
def finite_number_query(spark, sf):
    o = table(spark, sf, "orders")
    key = F.col("o_custkey").cast("string")
    text = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit(" "), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" ")))
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(key, F.lit("d")))
        .when(F.col("o_orderpriority") == "3-MEDIUM", "NaN")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "")
        .otherwise(F.concat(F.lit("-"), key, F.lit("e1")))
    )
    df = o.select("o_orderstatus", text.alias("t"))
    v = finite_number(df, "t").cast("decimal(18,2)")
    return df.groupBy("o_orderstatus").agg(
        F.count("*").alias("rows"), F.count(v).alias("valid_rows"), F.round(F.sum(v).cast("double"), 2).alias("total")
    )


@query(
    "period_end_rows",
    f"WITH {FACT} SELECT region, segment, round(cast(actual AS DOUBLE), 4) AS actual, FALSE AS fallback, cast(period_date AS VARCHAR) AS population_date FROM fact WHERE period_date = (SELECT max(period_date) FROM fact)",
)
def period_end_rows(spark, sf):
    df = fact(spark, sf, ["period_date", "region", "segment", "actual"])
    return H.period_end_rows(df, "period_date").select("region", "segment", r("actual", 4), "fallback", day("population_date"))


WINDOWS = {
    "90d": "d - 89", "8w": "d - 49", "13w": "d - 84", "15m": "date_trunc('month', d) - INTERVAL 14 MONTH",
    "24m": "date_trunc('month', d) - INTERVAL 23 MONTH", "mtd": "date_trunc('month', d)",
    "qtd": "date_trunc('quarter', date_trunc('month', d) - INTERVAL 6 MONTH) + INTERVAL 6 MONTH",
    "ytd": "date_trunc('year', date_trunc('month', d) - INTERVAL 6 MONTH) + INTERVAL 6 MONTH", "all": "DATE '0001-01-01'",
}


@query(
    "time_window_filter",
    f"WITH {FACT}, m AS (SELECT max(period_date) AS d FROM fact) "
    + " UNION ALL ".join(
        f"SELECT '{w}' AS \"window\", count(*) AS count, round(cast(sum(actual) AS DOUBLE), 4) AS actual, cast(min(period_date) AS VARCHAR) AS first_day FROM fact, m WHERE period_date >= {c}"
        for w, c in WINDOWS.items()
    ),
)
def time_window_filter(spark, sf):
    df = fact(spark, sf, ["period_date", "actual"])
    out = None
    for w in WINDOWS:
        one = H.time_window_filter(df, "period_date", w, 7).agg(
            F.lit(w).alias("window"), F.count("*").alias("count"), F.round(F.sum("actual").cast("double"), 4).alias("actual"),
            F.min("period_date").cast("string").alias("first_day"),
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "search_preview",
    """SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer WHERE contains(lower(concat_ws(chr(31), cast(c_custkey AS VARCHAR), c_name, cast(c_nationkey AS VARCHAR), c_mktsegment)), 'build')
    ORDER BY c_custkey LIMIT 100""",
)
def search_preview(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return H.search_preview(c, " BUILD", ["c_custkey"])


def raw_ledger(spark, sf):
    """Orders as an accounting export: every column is text."""
    o = table(spark, sf, "orders")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    amount = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("$"), F.format_number(price, 2)))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit("("), price.cast("string"), F.lit(")")))
        .otherwise(F.concat((F.col("o_custkey") / 10).cast("decimal(18,1)").cast("string"), F.lit("%")))
    )
    return o.select(
        "o_orderkey",
        amount.alias("amount"),
        F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("account"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "TRUE").when(F.col("o_orderpriority") == "5-LOW", "false").otherwise("").alias("urgent"),
        F.col("o_orderpriority").alias("priority"),
    )


LEDGER = """led AS (SELECT o_orderkey, o_orderstatus, cast(o_totalprice AS DECIMAL(18,2)) AS price, cast(o_custkey / 10 AS DECIMAL(18,1)) AS pct, lpad(cast(o_custkey AS VARCHAR), 9, '0') AS account, o_orderpriority AS priority FROM orders)"""


@query(
    "coerce_values",
    f"""WITH {LEDGER} SELECT o_orderkey, round(CASE o_orderstatus WHEN 'F' THEN cast(price AS DOUBLE) WHEN 'O' THEN -cast(price AS DOUBLE) ELSE cast(pct AS DOUBLE) / 100 END, 6) AS amount_number,
    account, cast(NULL AS DOUBLE) AS account_number, CASE priority WHEN '1-URGENT' THEN TRUE WHEN '5-LOW' THEN FALSE END AS urgent_boolean, priority FROM led""",
)
def coerce_values_query(spark, sf):
    return coerce_values(raw_ledger(spark, sf)).select(
        "o_orderkey", r("amount_number"), "account", r("account_number"), "urgent_boolean", "priority"
    )


@query(
    "coercion_report",
    f"""WITH {LEDGER} SELECT 'amount' AS "column", count(*) AS cells, 0 AS missing_cells, count(*) AS number_cells, 0 AS boolean_cells, 0 AS string_cells FROM led
    UNION ALL SELECT 'account', count(*), 0, count(*) FILTER (WHERE account NOT LIKE '0%'), 0, count(*) FILTER (WHERE account LIKE '0%') FROM led
    UNION ALL SELECT 'urgent', count(*), count(*) FILTER (WHERE priority NOT IN ('1-URGENT', '5-LOW')), 0, count(*) FILTER (WHERE priority IN ('1-URGENT', '5-LOW')), 0 FROM led
    UNION ALL SELECT 'priority', count(*), 0, 0, 0, count(*) FROM led""",
)
def coercion_report_query(spark, sf):
    return coercion_report(raw_ledger(spark, sf))
