"""Registration of queries, and the common table expressions their DuckDB counterparts share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from variscope.sources.warehouse import DIMENSIONS, PAYMENT_DIMENSIONS


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its inventory name, with its SQL counterpart if there is one."""

    def add(fn):
        if name in ENTRIES:
            raise ValueError(f"{name} is registered twice")
        ENTRIES[name] = Entry(fn, sql)
        return fn

    return add


def r(c: str | Column, digits: int = 6) -> Column:
    """A rounded double for output, under the name of the column."""
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col.cast("double"), digits)
    return out.alias(c) if isinstance(c, str) else out


def day(c: str) -> Column:
    return F.col(c).cast("date").cast("string").alias(c)


DIMS_SQL = ", ".join(DIMENSIONS)

FACT_COLUMNS_SQL = """
    cast(l_shipdate AS DATE) AS period_date, l_orderkey AS order_key, cast(o_orderdate AS DATE) AS order_date,
    cast(cast(l_extendedprice AS DECIMAL(12,2)) * (1 - cast(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS actual,
    cast(cast(l_extendedprice AS DECIMAL(12,2)) * cast(0.95 AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS target,
    cast(cast(l_extendedprice AS DECIMAL(12,2)) AS DECIMAL(18,4)) AS extended_price,
    cast(l_quantity AS DECIMAL(18,4)) AS quantity, l_discount AS discount,
    r_name AS region, n_name AS nation, c_mktsegment AS segment, p_brand AS brand, p_type AS ptype,
    l_returnflag AS returnflag, l_linestatus AS linestatus, o_orderpriority AS priority,
    o_orderstatus AS orderstatus, s_name AS supplier"""

FACT = f"""fact AS (
  SELECT {FACT_COLUMNS_SQL}
  FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN part ON l_partkey = p_partkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey)"""

GAPS = f"""{FACT}, gaps AS (
  SELECT * REPLACE (
    CASE WHEN priority <> '4-NOT SPECIFIED' THEN priority END AS priority,
    CASE WHEN returnflag = 'R' AND orderstatus = 'P' THEN ' ' ELSE region END AS region,
    CASE WHEN discount <> 0 THEN actual END AS actual)
  FROM fact)"""

PAYMENTS = f"""{FACT}, payments AS (
  SELECT actual AS dollar_amount, period_date AS transaction_date,
    cast(year(period_date - INTERVAL 6 MONTH) + 1 AS INTEGER) AS fiscal_year,
    cast(month(period_date - INTERVAL 6 MONTH) AS INTEGER) AS fiscal_month_number,
    {", ".join(f"{v} AS {k}" for k, v in PAYMENT_DIMENSIONS.items())}
  FROM (SELECT * REPLACE (period_date AS period_date) FROM fact))"""


def canon(c: str) -> str:
    return f"coalesce(nullif(trim({c}), ''), '(missing)')"


def investigation(
    source: str = "fact",
    dims: list[str] | None = None,
    where: str = "TRUE",
    sign: int = 1,
    average: bool = False,
    actual: str = "actual",
    expected: str = "target",
) -> str:
    """CTEs for one investigation: prep, st, sc (scale), contributions and scores."""
    dims = dims or DIMENSIONS
    per = "count" if average else "1"
    weight = "support" if average else "1"
    gross = "avg(abs(cast(residual AS DOUBLE)))" if average else "cast(sum(abs(residual)) AS DOUBLE)"
    return f"""prep AS (
  SELECT {", ".join(f"{canon(d)} AS {d}" for d in dims)}, {actual} AS actual, {expected} AS expected,
    {actual} - {expected} AS residual, period_date
  FROM {source} WHERE ({where}) AND {actual} IS NOT NULL AND {expected} IS NOT NULL),
st AS (SELECT count(*) AS n, {gross} AS gross, avg(abs(cast(residual AS DOUBLE))) AS mean_abs,
    median(cast(residual AS DOUBLE)) AS med, stddev_pop(cast(residual AS DOUBLE)) AS std,
    greatest(20, 0.015 * count(*)) AS min_support FROM prep),
sc AS (SELECT coalesce(nullif(1.4826 * median(abs(cast(residual AS DOUBLE) - med)), 0), nullif(any_value(std), 0), 1) AS scale
  FROM prep, st),
g AS (SELECT dimension, value, count(*) AS count, sum(actual) AS a, sum(expected) AS e
  FROM (UNPIVOT (SELECT * EXCLUDE (period_date) FROM prep) ON {", ".join(dims)} INTO NAME dimension VALUE value)
  GROUP BY ALL),
c0 AS (SELECT dimension, value, count, count / n AS support,
    cast(a AS DOUBLE) / {per} AS actual, cast(e AS DOUBLE) / {per} AS expected,
    cast(a - e AS DOUBLE) / {per} AS variance,
    cast(a - e AS DOUBLE) / count AS variance_per_row,
    abs(cast(a - e AS DOUBLE) / count) / greatest(scale, 1e-9) AS standardized_residual
  FROM g, st, sc),
c1 AS (SELECT *, variance * {weight} * {sign} AS business_impact,
    least(1, standardized_residual / 3) * least(1, sqrt(support / 0.05)) AS surprise FROM c0),
contributions AS (SELECT *,
    abs(business_impact) / coalesce(nullif(sum(abs(business_impact)) OVER (PARTITION BY dimension), 0), 1) AS share_of_abs_variance,
    row_number() OVER (PARTITION BY dimension ORDER BY abs(business_impact) DESC, value) AS category_rank,
    row_number() OVER (PARTITION BY dimension ORDER BY count >= min_support DESC, abs(business_impact) DESC, value) AS top_rank,
    CASE WHEN business_impact > 0 THEN 'favorable' WHEN business_impact < 0 THEN 'unfavorable' ELSE 'neutral' END AS impact_direction
  FROM c1, st),
scores AS (SELECT *, greatest(0, least(100, 100 * (0.5 * impact + 0.22 * surprise + 0.18 * concentration + 0.1 * support_quality) * cardinality_penalty)) AS score
  FROM (SELECT dimension, count(*) AS distinct_count,
      least(1, sum(abs(business_impact)) / any_value(coalesce(nullif(gross, 0), 1))) AS impact,
      sum(surprise * share_of_abs_variance) AS surprise,
      sum(share_of_abs_variance) FILTER (WHERE category_rank <= 3) AS concentration,
      coalesce(sum(abs(business_impact)) FILTER (WHERE count >= min_support) / nullif(sum(abs(business_impact)), 0), 0) AS support_quality,
      1 / (1 + greatest(0, count(*) - 12) / 35) AS cardinality_penalty,
      any_value(value) FILTER (WHERE top_rank = 1) AS top_category,
      any_value(business_impact) FILTER (WHERE top_rank = 1) AS top_category_impact
    FROM contributions GROUP BY dimension HAVING count(*) > 1))"""
