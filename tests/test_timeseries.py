from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from variscope.functions.calendar import prior_year
from variscope.functions.timeparse import parse_time_value
from variscope.operators import timeseries as S
from variscope.operators.cohort import time_window_filter
from variscope.operators.events import daily_cohort_aggregate, event_study
from variscope.operators.forecast import forecast_backtest, model_scores, fold_predictions
from variscope.operators.quality import detect_time_fields


@pytest.fixture(scope="module")
def months(spark):
    rows = [(f"{2025 + i // 12}-{i % 12 + 1:02d}", 100.0 + i, 100.0, "W" if i % 2 else "E") for i in range(15)]
    return spark.createDataFrame(rows, "month string, actual double, target double, region string")


SPEC = S.SeriesSpec("actual", "month", "target")


def test_fifteen_months(months):
    points = S.finance_points(months, SPEC)
    assert points.count() == 15
    last = points.orderBy(F.desc("period_start")).first()
    assert (last["actual"], last["expected"], last["business_impact"]) == (114.0, 100.0, 14.0)
    assert last["prior_period_impact_change"] == 1.0 and last["prior_year_impact_change"] == 12.0
    summary = {r["window"]: r for r in S.period_summary(points, SPEC).collect()}
    assert (summary["QTD"]["actual"], summary["QTD"]["expected"], summary["QTD"]["business_impact"]) == (339.0, 300.0, 39.0)
    assert summary["YTD"]["business_impact"] == 39.0 and summary["TRAILING"]["period_count"] == 12


def test_polarity_flips_the_impact(months):
    points = S.finance_points(months, S.SeriesSpec("actual", "month", "target", polarity="lower_is_better"))
    last = points.orderBy(F.desc("period_start")).first()
    assert last["business_impact"] == -14.0 and last["impact_direction"] == "unfavorable"


def test_ytd_window_keeps_three_rows(months):
    assert time_window_filter(months, "month", "ytd").count() == 3
    assert time_window_filter(months, "month", "all").count() == 15


def test_month_is_detected(months):
    found = {r["field"]: r for r in detect_time_fields(months).collect()}
    assert list(found) == ["month"] and found["month"]["suggested_grain"] == "month"
    assert found["month"]["parse_rate"] == 1.0 and found["month"]["distinct_periods"] == 15


def test_snapshot_month_takes_the_latest_date(spark):
    rows = [("2025-01-10", 100.0, 100.0, "a"), ("2025-01-31", 90.0, 80.0, "a"), ("2025-01-31", 60.0, 70.0, "b")]
    df = spark.createDataFrame(rows, "date string, actual double, target double, account string")
    row = S.finance_points(df, S.SeriesSpec("actual", "date", "target", aggregation="period_end")).first()
    assert (row["actual"], row["expected"], row["row_count"], row["valid_row_count"]) == (150.0, 150.0, 3, 2)


@pytest.mark.parametrize(
    ("text", "day", "precision"),
    [
        ("2025-01-10", "2025-01-10", "day"), ("2025/1/31", "2025-01-31", "day"), ("2024-02-29", "2024-02-29", "day"),
        ("2025-02-29", None, None), ("2025-04-31", None, None), ("2025-3", "2025-03-01", "month"),
        ("2025-Q3", "2025-07-01", "quarter"), ("2025 q4", "2025-10-01", "quarter"), ("2026-W01", "2025-12-29", "week"),
        ("2025-W54", None, None), ("1999", "1999-01-01", "quarter"), ("3/9/2024", "2024-03-09", "day"),
        ("Mar 9, 2024", "2024-03-09", "day"), ("2024-03-09T10:00:00Z", "2024-03-09", "day"), ("hello", None, None), ("", None, None),
        ("1850-01-01", None, None),
    ],
)
def test_time_spellings(spark, text, day, precision):
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(parse_time_value(df, "t").alias("p")).select("p.*").first()
    assert (None if row["ts"] is None else str(row["ts"].date())) == day
    if day:
        assert row["precision"] == precision


def test_time_numbers(spark):
    df = spark.createDataFrame([(2024.0,), (1_700_000_000_000.0,), (12.0,)], "t double")
    got = [r[0] for r in df.select(parse_time_value(df, "t")["ts"].cast("date").cast("string")).collect()]
    assert got == ["2024-01-01", "2023-11-14", None]


def test_leap_day_rolls_forward(spark):
    df = spark.createDataFrame([(dt.date(2024, 2, 29),), (dt.date(2024, 3, 31),)], "d date")
    assert [str(r[0]) for r in df.select(prior_year(F.col("d"))).collect()] == ["2023-03-01", "2023-03-31"]


def test_run_rate_projects_an_open_month(spark):
    rows = [(f"2025-06-{d:02d}", 10.0, 8.0) for d in range(1, 13)]
    df = spark.createDataFrame(rows, "d string, actual double, target double")
    spec = S.SeriesSpec("actual", "d", "target", grain="day")
    row = S.run_rate(S.finance_points(df, spec), spec).first()
    assert (row["elapsed_days"], row["total_days"], row["projected_actual"], row["confidence"]) == (12, 30, 300.0, "medium")
    health = S.model_health(S.time_coverage(df, spec), S.recent_signals(S.finance_points(df, spec), spec), spec).first()
    assert health["status"] == "healthy" and not health["seasonality_ready"]


def test_rolling_baseline_needs_three_periods(spark):
    rows = [(f"2025-{m:02d}", float(v)) for m, v in enumerate([10, 20, 60, 100, 30], 1)]
    df = spark.createDataFrame(rows, "m string, actual double")
    got = [r["expected"] for r in S.finance_points(df, S.SeriesSpec("actual", "m")).orderBy("period_start").collect()]
    assert got == [30.0, 30.0, 30.0, 20.0, 40.0]


def test_event_study_difference_in_differences(spark):
    rows = []
    for i in range(60):
        d = dt.date(2025, 1, 1) + dt.timedelta(days=i)
        noise = (i % 3 - 1) * 2.0
        rows.append((d, "Affected", 100.0 + noise - (20.0 if i >= 30 else 0.0), 100.0))
        rows.append((d, "Control", 100.0 + noise, 100.0))
    df = spark.createDataFrame(rows, "period_date date, region string, actual double, target double")
    daily = daily_cohort_aggregate(df, "period_date", "actual", "target", ["region"])
    event = dt.date(2025, 1, 31)
    events = spark.createDataFrame(
        [("did", event, "Affected", "Control", "unfavorable"), ("pre_post", event, "Affected", None, None),
         ("sparse", dt.date(2025, 1, 3), "Affected", "Control", None), ("wrong", event, "Affected", "Control", "favorable")],
        "event_id string, event_day date, affected string, control string, expected_direction string",
    )
    got = {r["event_id"]: r for r in event_study(daily, events, "region").collect()}
    assert got["did"]["raw_effect"] == pytest.approx(-20.0) and got["did"]["method"] == "difference_in_differences"
    assert got["did"]["impact_direction"] == "unfavorable" and got["did"]["status"] == "supported" and got["did"]["confidence"] == "high"
    assert got["pre_post"]["method"] == "pre_post" and got["pre_post"]["parallel_trend_score"] is None
    assert got["pre_post"]["confidence"] == "medium"
    assert (got["sparse"]["status"], got["sparse"]["confidence"]) == ("insufficient", "low")
    assert got["wrong"]["status"] == "contradicted"


def test_backtest_status(spark):
    long = spark.createDataFrame([("a", i, 100.0 + i % 12) for i in range(24)] + [("b", i, 100.0) for i in range(7)], "s string, k int, v double")
    got = {r["s"]: r for r in forecast_backtest(long, "v", "k", ["s"]).collect()}
    assert got["a"]["champion"] is not None and got["a"]["interval_lower"] <= got["a"]["interval_upper"]
    assert got["b"]["status"] == "insufficient" and got["b"]["champion"] is None
    assert got["a"]["history_periods"] == 24 and got["b"]["history_periods"] == 7
    scores = {(r["s"], r["model"]): r for r in model_scores(fold_predictions(long, "v", "k", ["s"]), ["s"]).collect()}
    assert scores[("a", "seasonal_naive_12")]["wape"] == 0.0 and scores[("a", "naive_last")]["folds"] == 18


def test_backtest_of_a_single_series(spark):
    df = spark.createDataFrame([(i, 50.0) for i in range(12)], "k int, v double")
    row = forecast_backtest(df, "v", "k").first()
    assert (row["champion"], row["next_forecast"], row["status"]) == ("naive_last", 50.0, "ready")
