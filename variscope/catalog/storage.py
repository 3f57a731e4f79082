"""Files, evidence, snapshots. Inputs are written from the tables to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from variscope.catalog.attribution import SPEC
from variscope.catalog.forecasting import _series as forecast_series
from variscope.catalog.quality import OPTIONS
from variscope.catalog.registry import ENTRIES, FACT, GAPS, investigation, query, r
from variscope.catalog.semantics import metric_rows
from variscope.catalog.texts import ARTICLES
from variscope.catalog.timeseries import BASE_CTE, BASELINE
from variscope.catalog.timeseries import _gaps as gap_rows
from variscope.operators import evidence as V
from variscope.operators import grounding as G
from variscope.operators import quality as Q
from variscope.operators import semantics as M
from variscope.operators import timeseries as S
from variscope.operators.cohort import apply_predicates
from variscope.operators.forecast import forecast_backtest
from variscope.plans.investigation import Investigation
from variscope.session import shared_folder
from variscope.sources import files as R
from variscope.sources import sinks as K
from variscope.sources.coerce import coerce_values
from variscope.sources.warehouse import articles, fact, fact_with_gaps, table


@query(
    "read_csv",
    "SELECT o_orderstatus, count(*) AS rows, round(cast(sum(cast(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS total, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY 1",
)
def read_csv(spark, sf):
    path = shared_folder(spark, "orders-csv")
    orders = table(spark, sf, "orders").withColumn("o_totalprice", F.concat(F.lit("$"), F.format_number("o_totalprice", 2)))
    orders.write.option("header", True).option("escape", '"').csv(path)
    df = coerce_values(R.read_csv(spark, path).drop(R.BAD_RECORD), ["o_totalprice"])
    return df.groupBy("o_orderstatus").agg(
        F.count("*").alias("rows"),
        F.round(F.sum(F.col("o_totalprice_number").cast("decimal(18,2)")).cast("double"), 2).alias("total"),
        F.count_distinct("o_orderpriority").alias("priorities"),
    )


def nested_customers(spark, sf):
    """Customers with their nation and orders as nested records."""
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.max("o_orderstatus").alias("last_status"))
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").alias("id"),
        F.struct(
            F.col("c_name").alias("name"),
            F.struct(F.col("n_name").alias("nation"), F.struct(F.col("n_regionkey").alias("region")).alias("area")).alias("place"),
        ).alias("who"),
        F.array("c_mktsegment").alias("segments"),
        F.struct("orders", "last_status").alias("activity"),
    )


NESTED = """c AS (SELECT c_custkey AS id, c_name, n_name, n_regionkey, c_mktsegment, orders, last_status FROM customer JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT o_custkey, count(*) AS orders, max(o_orderstatus) AS last_status FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""


@query("read_json", f"WITH {NESTED} SELECT id, c_name AS name, n_name AS nation, orders FROM c")
def read_json(spark, sf):
    path = shared_folder(spark, "customers-json")
    nested_customers(spark, sf).write.json(path)
    df = R.read_json(spark, path, lines=True)
    return df.select("id", F.col("who.name").alias("name"), F.col("who.place.nation").alias("nation"), F.col("activity.orders").alias("orders"))


@query(
    "flatten_records",
    f"""WITH {NESTED} SELECT id, c_name AS "who.name", n_name AS "who.place.nation", '{{"region":' || n_regionkey || '}}' AS "who.place.area", '["' || c_mktsegment || '"]' AS segments, orders AS "activity.orders", last_status AS "activity.last_status" FROM c""",
)
def flatten_records(spark, sf):
    return R.flatten_records(nested_customers(spark, sf))


@query("ragged_rows", f"WITH {NESTED} SELECT count(*) AS row_count, count(*) FILTER (WHERE orders IS NULL) AS ragged_rows FROM c")
def ragged_rows(spark, sf):
    path = shared_folder(spark, "ragged-json")
    df = nested_customers(spark, sf).select("id", "activity.orders", "activity.last_status")
    df.write.json(path)  # a null field is left out of its record
    return Q.missing_cells(R.read_json(spark, path, lines=True)).select("row_count", "ragged_rows")


@query(
    "ingest_table",
    f"""WITH {FACT} SELECT region, count(*) AS rows, round(cast(sum(actual) AS DOUBLE), 4) AS actual, round(cast(sum(target) AS DOUBLE), 4) AS target FROM fact GROUP BY 1""",
)
def ingest_table(spark, sf):
    path = shared_folder(spark, "contract-csv")
    fact(spark, sf, ["period_date", "actual", "target", "region"]).select(
        "period_date", F.col("actual").alias("actual_value"), F.concat(F.lit("$"), F.col("target").cast("string")).alias("plan_value"),
        F.col("region").alias("dim_Region"),
    ).write.option("header", True).csv(path)
    df = R.ingest_table(spark, path, "csv")
    money = lambda c: F.round(F.sum(F.col(c).cast("decimal(18,4)")).cast("double"), 4).alias(c)
    return df.groupBy("region").agg(F.count("*").alias("rows"), money("actual"), money("target"))


def _ledger(spark, sf):
    """Evidence of one investigation of the whole fact, with its series, forecast and quality."""
    inv = Investigation(fact(spark, sf), SPEC)
    run = inv.run_id
    rows = fact_with_gaps(spark, sf, ["period_date", "actual", "target", "segment"])
    spec = S.SeriesSpec("actual", "period_date", "target", series=("segment",))
    trend = S.trend(S.finance_points(rows, spec), spec)
    forecast = forecast_backtest(forecast_series(spark, sf), "actual", "period_start", ["segment", "brand"]).groupBy("status").agg(F.count("*").alias("series"))
    quality = Q.missing_cells(rows)
    metric = M.infer_metric_definition(metric_rows(spark, sf), "actual", "target", "row_idx")
    text = lambda c: F.col(c).cast("string")
    contract = "dataset-contract"
    changed = S.material_periods(S.finance_points(gap_rows(spark, sf), BASELINE), BASELINE)
    months = changed.select("segment", "period_start", F.last_day("period_start").alias("period_end"))
    parts = [
        V.dataset_evidence(R.content_fingerprint(rows), "Order lines", run),
        V.external_evidence(articles(spark, sf), months, run, "segment"),
        V.scope_evidence(inv.scope, inv.spec, run),
        V.driver_evidence(inv.scores, run),
        V.interaction_evidence(inv.interactions, run),
        V.table_evidence(trend, "time-series", run, "segment", "Trend of a segment", F.concat_ws(" ", "direction", text("change"))),
        V.table_evidence(forecast, "forecast-model", run, "status", "Backtested forecasts", F.concat_ws(" ", "series", "status")),
        V.table_evidence(quality, "quality", run, "row_count", "Missing cells", text("missing_rate")),
        V.table_evidence(metric, "metric-definition", run, "metric_id", "Metric definition", F.concat_ws(" ", "aggregation", "semantic_completeness"), contract),
        V.table_evidence(metric.filter("missing_semantics <> ''"), "limitation", run, "metric_id", "Metric limitation", F.col("missing_semantics"), contract),
    ]
    return inv, V.evidence_table(parts)


@query("evidence_table")
def evidence_table(spark, sf):
    return _ledger(spark, sf)[1]


def _count_of(name: str, what: str = "count(*)") -> str:
    """A figure of another query's SQL."""
    return f"(SELECT {what} FROM ({ENTRIES[name].sql}))"


@query(
    "evidence_kind_counts",
    f"""WITH {GAPS}, {BASE_CTE}, {ARTICLES}, changed AS (SELECT s, cast(p AS DATE) AS p FROM pts WHERE material OR severity IN ('critical', 'watch') QUALIFY row_number() OVER (PARTITION BY s ORDER BY p DESC) <= 12),
    about AS (SELECT DISTINCT s, p FROM changed JOIN art ON published_at BETWEEN p - 30 AND last_day(p))
    SELECT 'driver' AS kind, least(8, {_count_of("score_dimensions")}) AS items UNION ALL SELECT 'scope', 1 UNION ALL SELECT 'variance', 1 UNION ALL SELECT 'dataset', 1 UNION ALL SELECT 'quality', 1
    UNION ALL SELECT 'time-series', count(DISTINCT segment) FROM gaps UNION ALL SELECT 'external-context', count(*) FROM about HAVING count(*) > 0
    UNION ALL SELECT 'interaction', {_count_of("top_interactions")} UNION ALL SELECT 'forecast-model', {_count_of("forecast_backtest", "count(DISTINCT status)")}
    UNION ALL SELECT 'metric-definition', {_count_of("infer_metric_definition", "count(DISTINCT metric_id)")}
    UNION ALL SELECT 'limitation', {_count_of("infer_metric_definition", "count(DISTINCT metric_id) FILTER (WHERE missing_semantics <> '')")}""",
)
def evidence_kind_counts(spark, sf):
    return _ledger(spark, sf)[1].groupBy("kind").agg(F.count_distinct("evidence_id").alias("items"))


@query("evidence_for_kinds")
def evidence_for_kinds(spark, sf):
    ledger = _ledger(spark, sf)[1]
    return G.evidence_for_kinds(ledger, "tool").select("tool", "rank", "kind", "title")


@query(
    "unknown_evidence",
    f"""WITH {FACT}, {investigation()}, best AS (SELECT dimension, top_category FROM scores ORDER BY score DESC, dimension LIMIT 8)
    SELECT c.dimension || '=' || c.value AS claim_id FROM contributions c LEFT JOIN best b ON b.dimension = c.dimension AND b.top_category = c.value WHERE b.dimension IS NULL""",
)
def unknown_evidence(spark, sf):
    inv = Investigation(fact(spark, sf), SPEC)
    ledger = V.driver_evidence(inv.scores, inv.run_id)
    return G.unknown_evidence(V.claims_of(inv.contributions, inv.run_id), ledger).select("claim_id")


@query(
    "allowed_dimensions",
    f"""WITH {FACT}, {investigation()} SELECT dimension, dimension IN (SELECT dimension FROM scores ORDER BY score DESC, dimension LIMIT 8) AS allowed FROM (SELECT DISTINCT dimension FROM contributions)""",
)
def allowed_dimensions(spark, sf):
    """Membership both ways: asked dimensions that are, and are not, among the best eight."""
    inv = Investigation(fact(spark, sf), SPEC)
    asked = inv.contributions.select("dimension").distinct()
    best = inv.scores.orderBy(F.desc("score"), "dimension").limit(V.TOP_DRIVERS).select("dimension")
    inside = asked.intersect(best).withColumn("allowed", F.lit(True))
    return inside.unionByName(asked.exceptAll(best).withColumn("allowed", F.lit(False)))


@query(
    "write_snapshot",
    f"""WITH {FACT}, {investigation()} SELECT dimension, distinct_count, round(score, 6) AS score, top_category FROM scores""",
)
def write_snapshot(spark, sf):
    inv = Investigation(fact(spark, sf), SPEC)
    folder = shared_folder(spark, "snapshot")
    K.write_snapshot(
        {"scope": inv.scope, "contribution": inv.contributions, "dimension_score": inv.scores},
        {"metric_id": "net_price", "aggregation": SPEC.aggregation}, folder, inv.run_id,
    )
    return K.read_snapshot(spark, folder, "dimension_score", inv.run_id).select("dimension", "distinct_count", r("score"), "top_category")


@query(
    "validate_snapshot",
    """WITH h AS (SELECT 'snap-' || o_orderkey AS snapshot_id, o_orderpriority, o_orderstatus, o_custkey FROM orders),
    it AS (SELECT DISTINCT 'snap-' || l_orderkey AS snapshot_id, 'ev-' || l_linenumber AS evidence_id FROM lineitem), al AS (SELECT DISTINCT 'snap-' || l_orderkey AS snapshot_id, 'ev-' || l_linenumber AS evidence_id FROM lineitem WHERE l_returnflag <> 'R')
    SELECT snapshot_id, 'dataset_identity_missing' AS error, NULL AS evidence_id FROM h WHERE o_orderpriority = '4-NOT SPECIFIED' UNION ALL SELECT snapshot_id, 'run_mismatch', NULL FROM h WHERE o_orderstatus = 'P'
    UNION ALL SELECT snapshot_id, 'evidence_not_allowed', evidence_id FROM (SELECT * FROM it EXCEPT SELECT * FROM al)""",
)
def validate_snapshot(spark, sf):
    o = table(spark, sf, "orders")
    name = lambda c: F.concat(F.lit("snap-"), F.col(c).cast("string")).alias("snapshot_id")
    run = F.concat(F.lit("run-"), F.col("o_custkey").cast("string"))
    headers = o.select(
        name("o_orderkey"), F.lit(K.SCHEMA_VERSION).alias("schema_version"), F.lit("net_price").alias("metric_id"), run.alias("run_id"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", "session").alias("session_id"), F.lit("hash").alias("content_hash"),
        F.lit("ledger").alias("ledger_id"), F.when(F.col("o_orderstatus") == "P", "run-other").otherwise(run).alias("ledger_run_id"),
    )
    line = table(spark, sf, "lineitem")
    evidence = F.concat(F.lit("ev-"), F.col("l_linenumber").cast("string")).alias("evidence_id")
    allowed = line.filter("l_returnflag <> 'R'").select(name("l_orderkey"), evidence).distinct()
    return K.validate_snapshot(headers, line.select(name("l_orderkey"), evidence), allowed)


@query(
    "export_quality_report",
    """SELECT 'o_custkey' AS "column", count(*) AS row_count, count(DISTINCT o_custkey) AS distinct_count FROM orders UNION ALL SELECT 'o_orderstatus', count(*), count(DISTINCT o_orderstatus) FROM orders
    UNION ALL SELECT 'o_orderpriority', count(*), count(DISTINCT o_orderpriority) FROM orders""",
)
def export_quality_report(spark, sf):
    p = Q.Profiler(table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority"), OPTIONS)
    path = shared_folder(spark, "quality-report")
    K.export_report(p.profile, path)
    return spark.read.json(path).select("column", "row_count", "distinct_count")


PRINTED = ["o_custkey", "o_orderkey", "o_orderstatus", "o_totalcents"]
PRINT_SQL = """h AS (SELECT o_orderpriority AS run_id, cast('0x' || substr(md5('o_custkey=' || o_custkey || chr(31) || 'o_orderkey=' || o_orderkey || chr(31) || 'o_orderstatus=' || coalesce(o_orderstatus, chr(0))
      || chr(31) || 'o_totalcents=' || cents), 1, 15) AS BIGINT) AS h FROM (SELECT *, cast(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)),
  p AS (SELECT run_id, count(*) AS row_count, cast(sum(h) AS VARCHAR) || '-' || cast(bit_xor(h) AS VARCHAR) AS digest FROM h GROUP BY run_id)"""


def _printed(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("o_totalcents"), F.col("o_orderpriority").alias("run_id"))


@query(
    "content_fingerprint",
    f"WITH {PRINT_SQL} SELECT run_id, row_count, digest, sha256(row_count || '|' || digest || '|{','.join(PRINTED)}') AS content_hash FROM p",
)
def content_fingerprint(spark, sf):
    """Merged from the fingerprints of parts: of each status in each group of orders."""
    df = _printed(spark, sf).withColumn("part", F.col("o_orderstatus"))
    parts = R.fingerprint_parts(df, ["run_id", "part"])
    return R.merge_fingerprints(parts, PRINTED, ["run_id"]).select("run_id", "row_count", "digest", "content_hash")


@query(
    "audit_snapshots",
    """WITH r AS (SELECT o_orderpriority AS run, max(cast(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders GROUP BY 1)
    SELECT run AS run_id, 'content_mismatch' AS error, 'orders' AS about FROM r WHERE cents = (SELECT max(cents) FROM r)
    UNION ALL SELECT run, 'dataset_changed', run FROM r WHERE cents = (SELECT max(cents) FROM r)""",
)
def audit_snapshots(spark, sf):
    """Snapshots of the orders of each priority; then the dearest order of all is changed, in the store and in the data."""
    df, folder = _printed(spark, sf), shared_folder(spark, "audited")
    runs = [x["run_id"] for x in df.select("run_id").distinct().collect()]
    for run in runs:
        rows = df.filter(F.col("run_id") == run).drop("run_id")
        ledger = rows.groupBy("o_orderstatus").agg(F.count("*").alias("n")).select(F.concat(F.lit("ev-"), "o_orderstatus").alias("evidence_id"), "n", F.lit(run).alias("run_id"))
        K.save_investigation(rows, {"orders": rows}, ledger, folder, run, "net_price", {"aggregation": "sum"})
    dearest = df.orderBy(F.desc("o_totalcents")).first()
    changed = df.withColumn("o_totalcents", F.when(F.col("o_totalcents") == dearest["o_totalcents"], -F.col("o_totalcents")).otherwise(F.col("o_totalcents")))
    K.write_run(changed.filter(F.col("run_id") == dearest["run_id"]), f"{folder}/orders", dearest["run_id"])
    now = {run: changed.filter(F.col("run_id") == run).drop("run_id") for run in runs}
    names = spark.read.json(f"{folder}/manifest").select("run_id", "snapshot_id")
    return K.audit_snapshots(spark, folder, now).join(names, "snapshot_id").select("run_id", "error", "about")


@query(
    "evidence_rows",
    f"""WITH {FACT} SELECT order_key, segment, '[redacted]' AS supplier, round(cast(actual AS DOUBLE), 4) AS actual FROM fact WHERE region = 'ASIA' AND priority = '1-URGENT' ORDER BY order_key, actual, segment LIMIT 100""",
)
def evidence_rows(spark, sf):
    df = fact(spark, sf, ["order_key", "segment", "supplier", "actual", "region", "priority"])
    rows = apply_predicates(df, [("region", "ASIA"), ("priority", "1-URGENT")])
    return R.evidence_rows(rows, ["supplier"], ["order_key", "actual", "segment"]).select(
        "order_key", "segment", "supplier", r("actual", 4)
    )
