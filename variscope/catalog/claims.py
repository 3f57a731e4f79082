"""Checks of the references of answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from variscope.catalog.registry import query
from variscope.operators import claims as C
from variscope.sources.warehouse import table


def _responses(spark, sf):
    """An answer for every order: claims on its lines, a tool's trace and a drill, some with references that do not hold."""
    o = table(spark, sf, "orders")
    ids = lambda *n: F.array(*[F.lit(f"ev-{i}") for i in n])
    none = F.array().cast("array<string>")
    opened = F.col("o_orderstatus") == "O"
    claim = lambda name, cited: F.struct(F.lit(name).alias("id"), cited.alias("evidence_ids"))
    drill = lambda d, v: F.struct(d.alias("dimension"), v.alias("value"))
    return o.select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.concat(F.lit("answer-"), F.col("o_custkey").cast("string")).alias("answer_id"),
        F.array(claim("claim:1", ids(1, 2)), claim("claim:2", F.when(opened, none).otherwise(ids(3)))).alias("claims"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.array(F.struct(F.lit("scan_dimensions").alias("tool"), ids(1, 4).alias("evidence_ids")))).alias("trace"),
        F.array(
            F.struct(
                F.when(opened, F.lit("orderstatus")).otherwise(F.col("o_orderpriority")).alias("dimension"),
                F.array(drill(F.lit("returnflag-R"), F.lit("R")), drill(F.lit("orderstatus"), F.col("o_orderstatus"))).alias("predicates"),
            )
        ).alias("actions"),
    )


def _known(spark, sf):
    """Lines that were not returned are evidence; a run may drill into the flags of its lines and its status."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("run_id"), "l_linenumber", "l_returnflag")
    ledger = lines.filter("l_returnflag <> 'R'").select("run_id", F.concat(F.lit("ev-"), F.col("l_linenumber").cast("string")).alias("evidence_id"))
    flags = lines.select("run_id", F.concat(F.lit("returnflag-"), "l_returnflag").alias("dimension"))
    return ledger, flags.unionByName(lines.select("run_id", F.lit("orderstatus").alias("dimension")))


REFERENCES = """WITH led AS (SELECT DISTINCT l_orderkey AS run, 'ev-' || l_linenumber AS ref FROM lineitem WHERE l_returnflag <> 'R'),
al AS (SELECT DISTINCT l_orderkey AS run, 'returnflag-' || l_returnflag AS ref FROM lineitem UNION SELECT DISTINCT l_orderkey, 'orderstatus' FROM lineitem),
o AS (SELECT o_orderkey AS run, 'answer-' || o_custkey AS answer_id, o_orderstatus, o_orderpriority FROM orders),
refs AS (SELECT run, answer_id, 'claim' AS part, 0 AS at_, 'claim:1' AS name, j AS ref_at, 'ev-' || (j + 1) AS ref FROM o, unnest([0, 1]) AS u(j)
  UNION ALL SELECT run, answer_id, 'claim', 1, 'claim:2', CASE WHEN o_orderstatus <> 'O' THEN 0 END, CASE WHEN o_orderstatus <> 'O' THEN 'ev-3' END FROM o
  UNION ALL SELECT run, answer_id, 'tool', 0, 'scan_dimensions', j, CASE j WHEN 0 THEN 'ev-1' ELSE 'ev-4' END FROM o, unnest([0, 1]) AS u(j) WHERE o_orderpriority <> '5-LOW'
  UNION ALL SELECT run, answer_id, 'action', 0, d, NULL, d FROM (SELECT *, CASE WHEN o_orderstatus = 'O' THEN 'orderstatus' ELSE o_orderpriority END AS d FROM o)
  UNION ALL SELECT run, answer_id, 'predicate', 0, d, j, d FROM (SELECT *, CASE j WHEN 0 THEN 'returnflag-R' ELSE 'orderstatus' END AS d FROM o, unnest([0, 1]) AS u(j))),
err AS (SELECT refs.*, CASE WHEN part = 'claim' AND refs.ref IS NULL THEN 'claim_without_evidence' WHEN part IN ('claim', 'tool') AND led.ref IS NULL THEN part || '_unknown_evidence'
    WHEN part IN ('action', 'predicate') AND al.ref IS NULL THEN part || '_disallowed_dimension' END AS error
  FROM refs LEFT JOIN led ON led.run = refs.run AND led.ref = refs.ref LEFT JOIN al ON al.run = refs.run AND al.ref = refs.ref)"""


@query(
    "claim_errors",
    f"{REFERENCES} SELECT cast(run AS VARCHAR) AS run_id, answer_id, part, at_ AS at, name, ref_at, ref, error FROM err WHERE error IS NOT NULL",
)
def claim_errors(spark, sf):
    return C.claim_errors(_responses(spark, sf), *_known(spark, sf)).select("run_id", "answer_id", "part", "at", "name", "ref_at", "ref", "error")


@query(
    "claim_check",
    f"""{REFERENCES}, s AS (SELECT cast(run AS VARCHAR) AS run_id, answer_id, 2 AS claims, count(*) FILTER (WHERE part <> 'claim' OR ref IS NOT NULL) AS "references",
      count(*) FILTER (WHERE error = 'claim_without_evidence') AS claims_without_evidence, count(*) FILTER (WHERE error = 'claim_unknown_evidence') AS unknown_in_claims,
      count(*) FILTER (WHERE error = 'tool_unknown_evidence') AS unknown_in_tools, count(*) FILTER (WHERE error = 'action_disallowed_dimension') AS disallowed_in_actions,
      count(*) FILTER (WHERE error = 'predicate_disallowed_dimension') AS disallowed_in_predicates, count(error) AS errors FROM err GROUP BY run, answer_id)
    SELECT * EXCLUDE (errors), claims_without_evidence = 0 AND unknown_in_claims = 0 AS claims_grounded, errors = 0 AS valid FROM s""",
)
def claim_check(spark, sf):
    return C.claim_check(_responses(spark, sf), *_known(spark, sf))
