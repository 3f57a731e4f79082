from __future__ import annotations

import datetime as dt
import os

import pytest

import __spark_entry__ as E
from check import check, connect
from variscope.catalog import load
from variscope.plans.dataset import Dataset

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "scope_totals", "group_dimension_average", "score_dimensions", "find_interactions", "category_rank", "finance_points",
    "period_summary_average", "run_rate", "model_health", "monthly_benchmark", "top_n_per_dimension", "hierarchy_children",
    "forecast_backtest", "event_study", "column_profile", "quality_issues", "functional_dependencies", "coerce_values",
    "normalize_long", "infer_metric_definition", "hierarchy_depth", "mention_join_long_list", "grounding_check_documents",
    "why_factor_score", "read_csv", "flatten_records", "ingest_table", "write_snapshot", "validate_snapshot",
]
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def finance_rows(spark):
    rows = []
    for i in range(240):
        month = f"{2024 + i // 120}-{i // 10 % 12 + 1:02d}"
        rows.append((i, month, ("West", "East", "North")[i % 3], ("a", "b")[i % 2], 100.0 + i % 7 - (30 if i % 3 == 0 else 0), 100.0, "Opex spend"))
    return spark.createDataFrame(rows, "i int, month string, region string, product string, actual double, target double, metric_name string")


def test_dataset_gate_defaults_and_order(spark):
    data = Dataset(finance_rows(spark), dt.date(2026, 1, 1), row_idx="i")
    assert data.dimensions == ["product", "region"] and data.measures == ["actual"]  # a constant target is no measure
    assert data.time_names == ["month"]
    assert data.defaults["planning_lens"] == "opex" and data.defaults["expected_key"] == ""
    inv = data.investigate("month", "ytd", [("product", "a")], expected="target")
    scope = inv.scope.first()
    assert scope["row_count"] == 60  # the 120 rows of the last year, half of them product a
    assert inv.best_dimensions == ["region"]
    shown, spec = data.series("month", window="ytd", expected="target")
    points = shown.orderBy("period_start").collect()
    assert len(points) == 12 and points[0]["prior_year_impact_change"] is not None and points[0]["anomaly_score"] >= 0
    assert data.correlations() is None and data.dependencies().count() == 0
    assert {r["dimension"] for r in data.scores().collect()} >= {"overall", "readiness"}


@needs_data
def test_entry_has_a_stable_schema(spark):
    df = E.entry(spark)
    assert df.columns == ["dimension", "score", "distinct_count", "top_category"] and df.count() == 10


def test_every_query_is_registered_once():
    names, inventory = E.queries(), load()
    assert set(E.oracle_sql()) <= set(names) and set(inventory) <= set(names) and len(inventory) > 140
    assert {n for n, e in inventory.items() if e.sql is None} == {"evidence_table", "evidence_for_kinds"}


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_sql(spark, name):
    status, rows, _, note = check(spark, connect(SF), name, load()[name], SF)
    assert status in ("ok", "EMPTY"), note
    spark.catalog.clearCache()
