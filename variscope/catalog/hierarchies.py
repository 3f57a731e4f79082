"""Hierarchy queries: level paths, edges, parent tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from variscope.catalog.registry import FACT, GAPS, query, r
from variscope.operators import hierarchy as H
from variscope.sources.warehouse import fact, fact_with_gaps, table

LEVELS = ["region", "nation", "priority", "brand"]
CLEAN = ", ".join(f"nullif(trim({c}), '') AS {c}" for c in LEVELS)

EDGES = f"""{GAPS}, l AS (SELECT {CLEAN} FROM gaps), edges AS (
  SELECT DISTINCT 1 AS depth, '__root__' AS parent_field, 'All data' AS hierarchy_parent, 'region' AS child_field, region AS hierarchy_child FROM l WHERE region IS NOT NULL
  UNION SELECT 2, 'region', region, 'nation', nation FROM l WHERE region IS NOT NULL AND nation IS NOT NULL
  UNION SELECT 3, 'nation', nation, 'priority', priority FROM l WHERE region IS NOT NULL AND nation IS NOT NULL AND priority IS NOT NULL
  UNION SELECT 4, 'priority', priority, 'brand', brand FROM l WHERE region IS NOT NULL AND nation IS NOT NULL AND priority IS NOT NULL AND brand IS NOT NULL)"""


@query(
    "hierarchy_path",
    f"""WITH {GAPS}, l AS (SELECT {CLEAN} FROM gaps), p AS (SELECT CASE WHEN region IS NULL THEN [] WHEN nation IS NULL THEN ['region=' || url_encode(region)] WHEN priority IS NULL THEN ['region=' || url_encode(region), 'nation=' || url_encode(nation)]
      WHEN brand IS NULL THEN ['region=' || url_encode(region), 'nation=' || url_encode(nation), 'priority=' || url_encode(priority)] ELSE ['region=' || url_encode(region), 'nation=' || url_encode(nation), 'priority=' || url_encode(priority), 'brand=' || url_encode(brand)] END AS a FROM l)
    SELECT CASE WHEN len(a) = 0 THEN 'root' ELSE array_to_string(a, '&') END AS path, cast(len(a) AS INTEGER) AS depth, count(*) AS rows FROM p GROUP BY ALL""",
)
def hierarchy_path(spark, sf):
    return H.hierarchy_path(fact_with_gaps(spark, sf, LEVELS), LEVELS)


@query("hierarchy_edges", f"WITH {EDGES} SELECT * FROM edges")
def hierarchy_edges(spark, sf):
    return H.hierarchy_edges(fact_with_gaps(spark, sf, LEVELS), LEVELS)


@query(
    "distinct_edges",
    f"WITH {EDGES} SELECT parent_field, child_field, count(*) AS edges, min(hierarchy_child) AS first_child FROM edges GROUP BY ALL",
)
def distinct_edges(spark, sf):
    edges = H.distinct_edges(H.hierarchy_edges(fact_with_gaps(spark, sf, LEVELS), LEVELS))
    return edges.groupBy("parent_field", "child_field").agg(
        F.count("*").alias("edges"), F.min("hierarchy_child").alias("first_child")
    )


def accounts(spark, sf):
    """A parent table from the master data, with its real-life defects: customers in debt point to a
    closed nation, the richest and the poorest supplier report to each other, and a region heads itself."""
    region = table(spark, sf, "region").select(
        F.concat(F.lit("R:"), "r_name").alias("Node Key"),
        F.when(F.col("r_name") == "EUROPE", "R:EUROPE").otherwise("ALL").alias("parent_id"),
        F.col("r_name").alias("node_name"), F.lit("$0").alias("amount"),
    )
    top = region.agg(F.count("*")).select(
        F.lit("ALL").alias("Node Key"), F.lit("").alias("parent_id"), F.lit("All").alias("node_name"), F.lit("$0").alias("amount")
    )
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("N:"), F.col("n_nationkey").cast("string")).alias("Node Key"),
        F.concat(F.lit("R:"), "r_name").alias("parent_id"), F.col("n_name").alias("node_name"), F.lit("$0").alias("amount"),
    )
    c = table(spark, sf, "customer")
    customer = c.select(
        F.concat(F.lit("C:"), F.col("c_custkey").cast("string")).alias("Node Key"),
        F.when(F.col("c_acctbal") < 0, "N:closed").otherwise(F.concat(F.lit("N:"), F.col("c_nationkey").cast("string"))).alias("parent_id"),
        F.col("c_name").alias("node_name"), F.concat(F.lit("$"), F.col("c_acctbal").cast("decimal(18,2)").cast("string")).alias("amount"),
    )
    s = table(spark, sf, "supplier")
    rich = s.agg(F.max_by("s_suppkey", F.struct("s_acctbal", "s_suppkey"))).scalar()
    poor = s.agg(F.min_by("s_suppkey", F.struct("s_acctbal", "s_suppkey"))).scalar()
    key = F.col("s_suppkey")
    supplier = s.select(
        F.concat(F.lit("S:"), key.cast("string")).alias("Node Key"),
        F.when(key == rich, F.concat(F.lit("S:"), poor.cast("string")))
        .when(key == poor, F.concat(F.lit("S:"), rich.cast("string")))
        .otherwise(F.concat(F.lit("N:"), F.col("s_nationkey").cast("string"))).alias("parent_id"),
        F.col("s_name").alias("node_name"), F.concat(F.lit("$"), F.col("s_acctbal").cast("decimal(18,2)").cast("string")).alias("amount"),
    )
    return top.unionByName(region).unionByName(nation).unionByName(customer).unionByName(supplier)


ACCOUNTS = """acc AS (SELECT 'ALL' AS node_id, NULL AS parent_id, 'All' AS label, 0.0 AS amount
  UNION ALL SELECT 'R:' || r_name, CASE WHEN r_name = 'EUROPE' THEN 'R:EUROPE' ELSE 'ALL' END, r_name, 0 FROM region
  UNION ALL SELECT 'N:' || n_nationkey, 'R:' || r_name, n_name, 0 FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'C:' || c_custkey, CASE WHEN c_acctbal < 0 THEN 'N:closed' ELSE 'N:' || c_nationkey END, c_name, c_acctbal FROM customer
  UNION ALL SELECT 'S:' || s_suppkey, CASE s_suppkey WHEN (SELECT arg_max(s_suppkey, (s_acctbal, s_suppkey)) FROM supplier) THEN 'S:' || (SELECT arg_min(s_suppkey, (s_acctbal, s_suppkey)) FROM supplier)
      WHEN (SELECT arg_min(s_suppkey, (s_acctbal, s_suppkey)) FROM supplier) THEN 'S:' || (SELECT arg_max(s_suppkey, (s_acctbal, s_suppkey)) FROM supplier) ELSE 'N:' || s_nationkey END, s_name, s_acctbal FROM supplier)"""
DEPTHS = f"""WITH RECURSIVE {ACCOUNTS}, flags AS (SELECT node_id, parent_id, coalesce(parent_id = node_id, FALSE) AS self_parent, parent_id IS NOT NULL AND parent_id NOT IN (SELECT node_id FROM acc) AS orphan FROM acc),
walk AS (SELECT node_id, 1 AS depth, node_id AS root FROM flags WHERE parent_id IS NULL OR self_parent OR orphan
  UNION ALL SELECT f.node_id, w.depth + 1, w.root FROM walk w JOIN flags f ON f.parent_id = w.node_id AND NOT f.self_parent)"""


def _nodes(spark, sf):
    df = accounts(spark, sf)
    return H.hierarchy_normalize(df.withColumn("row_idx", F.xxhash64("`Node Key`")), "row_idx")


@query(
    "hierarchy_normalize",
    f"WITH {ACCOUNTS} SELECT node_id, parent_id, label, round(cast(amount AS DOUBLE), 2) AS actual, cast(NULL AS DOUBLE) AS plan, cast(1 AS BIGINT) AS row_count FROM acc",
)
def hierarchy_normalize(spark, sf):
    return _nodes(spark, sf).select("node_id", "parent_id", "label", r("actual", 2), r("plan", 2), "row_count")


@query(
    "hierarchy_normalize_duplicates",
    f"""WITH {FACT} SELECT nation AS node_id, region AS parent_id, nation AS label, round(cast(sum(actual) AS DOUBLE), 4) AS actual, round(cast(sum(target) AS DOUBLE), 4) AS plan,
    round(cast(sum(actual) AS DOUBLE) - cast(sum(target) AS DOUBLE), 4) AS variance, count(*) AS row_count FROM fact GROUP BY 1, 2, 3""",
)
def hierarchy_normalize_duplicates(spark, sf):
    df = fact(spark, sf, ["order_key", "nation", "region", "actual", "target"]).select(
        F.col("nation").alias("member_id"), F.col("region").alias("parent_key"), F.col("actual").alias("value"),
        F.col("target").alias("budget"), F.col("order_key").alias("row_idx"),
    )
    return H.hierarchy_normalize(df, "row_idx").select(
        "node_id", "parent_id", "label", r("actual", 4), r("plan", 4), r("variance", 4), "row_count"
    )


@query(
    "hierarchy_parent_check",
    f"""WITH {ACCOUNTS} SELECT node_id, parent_id, 'self_parent' AS issue FROM acc WHERE parent_id = node_id
    UNION ALL SELECT node_id, parent_id, 'orphan' FROM acc WHERE parent_id IS NOT NULL AND parent_id <> node_id AND parent_id NOT IN (SELECT node_id FROM acc)""",
)
def hierarchy_parent_check(spark, sf):
    return H.hierarchy_parent_check(_nodes(spark, sf))


@query(
    "hierarchy_depth",
    f"""{DEPTHS} SELECT f.node_id, cast(depth AS BIGINT) AS depth, root, orphan, self_parent, root IS NULL AS cycle FROM flags f LEFT JOIN walk USING (node_id)""",
)
def hierarchy_depth(spark, sf):
    return H.hierarchy_depth(_nodes(spark, sf))


@query(
    "hierarchy_cycles",
    f"""{DEPTHS}, d AS (SELECT f.*, depth FROM flags f LEFT JOIN walk USING (node_id)) SELECT count(*) AS nodes, count(*) FILTER (WHERE depth = 1) AS roots, cast(max(depth) AS BIGINT) AS max_depth,
    count(*) FILTER (WHERE orphan) AS orphans, count(*) FILTER (WHERE self_parent) AS self_parents, count(*) FILTER (WHERE depth IS NULL) AS cycle_nodes, FALSE AS valid FROM d""",
)
def hierarchy_cycles(spark, sf):
    return H.hierarchy_cycles(H.hierarchy_depth(_nodes(spark, sf)))


@query(
    "node_insight",
    f"""WITH {FACT}, n AS (SELECT region, nation, cast(sum(actual) AS DOUBLE) AS amount, cast(sum(target) AS DOUBLE) AS expected, count(*) AS transactions FROM fact GROUP BY 1, 2),
    x AS (SELECT *, sum(amount) OVER (PARTITION BY region) AS pa FROM n)
    SELECT nation, transactions, round(amount / abs(pa), 8) AS share_of_parent, round(amount - expected, 4) AS business_impact, CASE WHEN amount > expected THEN 'favorable' WHEN amount < expected THEN 'unfavorable' ELSE 'neutral' END AS direction,
      CASE WHEN transactions >= 100 OR amount / abs(pa) >= 0.2 THEN 'high' ELSE 'medium' END AS confidence FROM x""",
)
def node_insight(spark, sf):
    df = fact(spark, sf, ["region", "nation", "actual", "target"])
    nodes = df.groupBy("region", "nation").agg(
        F.sum("actual").cast("double").alias("amount"), F.sum("target").cast("double").alias("expected"), F.count("*").alias("transactions")
    )
    parents = nodes.groupBy("region").agg(F.sum("amount").alias("parent_amount"))
    return H.node_insight(nodes.join(parents, "region")).select(
        "nation", "transactions", r("share_of_parent", 8), r("business_impact", 4), "direction", "confidence"
    )
