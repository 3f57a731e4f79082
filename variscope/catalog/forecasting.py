"""Forecast backtests over many series and event studies over many events."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from variscope.catalog.registry import FACT, day, query, r
from variscope.operators import events as E
from variscope.operators import forecast as B
from variscope.operators.timeseries import SeriesSpec, period_aggregate
from variscope.sources.warehouse import daily_events, fact

SERIES = """series AS (SELECT segment, brand, date_trunc('month', period_date) AS p, cast(sum(actual) AS DOUBLE) AS actual FROM fact GROUP BY ALL)"""
FOLDS = f"""{FACT}, {SERIES}, w AS (SELECT segment, brand, p, actual, row_number() OVER o - 1 AS i, lag(actual, 1) OVER o AS naive_last,
  CASE WHEN count(actual) OVER m3 = 3 THEN median(actual) OVER m3 END AS rolling_median_3, CASE WHEN count(actual) OVER m6 = 6 THEN median(actual) OVER m6 END AS rolling_median_6,
  lag(actual, 12) OVER o AS seasonal_naive_12 FROM series
  WINDOW o AS (PARTITION BY segment, brand ORDER BY p), m3 AS (PARTITION BY segment, brand ORDER BY p ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
    m6 AS (PARTITION BY segment, brand ORDER BY p ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
folds AS (SELECT segment, brand, p, actual, model, forecast, forecast - actual AS err FROM
  (UNPIVOT (SELECT * FROM w WHERE i >= 6) ON naive_last, rolling_median_3, rolling_median_6, seasonal_naive_12 INTO NAME model VALUE forecast))"""
SCORES = f"""{FOLDS}, med AS (SELECT segment, brand, model, median(err) AS m FROM folds GROUP BY ALL),
sc AS (SELECT segment, brand, model, count(*) AS folds, avg(abs(err)) AS mae, sum(abs(err)) / nullif(sum(abs(actual)), 0) AS wape, sum(err) / nullif(sum(abs(actual)), 0) AS bias,
  1.4826 * median(abs(err - m)) AS residual_scale, quantile_cont(err, 0.1) AS p10, quantile_cont(err, 0.9) AS p90 FROM folds JOIN med USING (segment, brand, model) GROUP BY ALL)"""
KEYS = ["segment", "brand"]


def _series(spark, sf):
    spec = SeriesSpec("actual", "period_date", series=tuple(KEYS))
    points = period_aggregate(fact(spark, sf, ["period_date", "actual", *KEYS]), spec)
    return points.select(*KEYS, "period_start", "actual")


@query(
    "fold_predictions",
    f"WITH {FOLDS} SELECT segment, brand, strftime(p, '%Y-%m-%d') AS period_start, model, round(forecast, 5) AS forecast, round(err, 5) AS error FROM folds",
)
def fold_predictions(spark, sf):
    return B.fold_predictions(_series(spark, sf), "actual", "period_start", KEYS).select(
        *KEYS, day("period_start"), "model", r("forecast", 5), r("error", 5)
    )


@query(
    "model_scores",
    f"WITH {SCORES} SELECT segment, brand, model, folds, round(mae, 8) AS mae, round(wape, 8) AS wape, round(bias, 8) AS bias, round(residual_scale, 6) AS residual_scale FROM sc",
)
def model_scores(spark, sf):
    folds = B.fold_predictions(_series(spark, sf), "actual", "period_start", KEYS)
    return B.model_scores(folds, KEYS).select(*KEYS, "model", "folds", r("mae", 8), r("wape", 8), r("bias", 8), r("residual_scale", 6))


@query(
    "forecast_backtest",
    f"""WITH {SCORES}, best AS (SELECT * FROM sc WHERE folds >= 4 QUALIFY row_number() OVER (PARTITION BY segment, brand ORDER BY wape,
      CASE model WHEN 'naive_last' THEN 0 WHEN 'rolling_median_3' THEN 1 WHEN 'rolling_median_6' THEN 2 ELSE 3 END) = 1),
    hist AS (SELECT segment, brand, list(actual ORDER BY p) AS h, count(*) AS n FROM series GROUP BY ALL),
    nx AS (SELECT *, CASE model WHEN 'naive_last' THEN h[n] WHEN 'rolling_median_3' THEN list_median(h[n-2:n]) WHEN 'rolling_median_6' THEN list_median(h[n-5:n])
      WHEN 'seasonal_naive_12' THEN h[n-11] END AS nxt FROM hist LEFT JOIN best USING (segment, brand))
    SELECT segment, brand, model AS champion, round(wape, 8) AS wape, round(bias, 8) AS bias, round(nxt, 5) AS next_forecast, round(nxt - p90, 8) AS interval_lower,
      round(nxt - p10, 8) AS interval_upper, n AS history_periods, coalesce(folds, 0) AS evaluated_periods,
      CASE WHEN model IS NULL THEN 'insufficient' WHEN n < 10 OR wape > 0.3 OR abs(bias) > 0.1 THEN 'watch' ELSE 'ready' END AS status FROM nx""",
)
def forecast_backtest(spark, sf):
    return B.forecast_backtest(_series(spark, sf), "actual", "period_start", KEYS).select(
        *KEYS, "champion", r("wape", 8), r("bias", 8), r("next_forecast", 5), r("interval_lower", 8), r("interval_upper", 8),
        "history_periods", "evaluated_periods", "status",
    )


DAILY = """med AS (SELECT median(value) AS m FROM events), daily AS (SELECT event_type, cast(ts AS DATE) AS day, sum(cast(value AS DECIMAL(18,4))) AS a, count(*) * any_value(m) AS expected FROM events, med GROUP BY 1, 2),
d AS (SELECT event_type, day, cast(a AS DOUBLE) AS actual, expected, cast(a AS DOUBLE) - expected AS residual FROM daily)"""
STUDY = f"""{DAILY}, ev AS (SELECT DISTINCT 'study-' || event_type AS event_id, DATE '2024-01-16' AS event_day, event_type AS affected,
    CASE WHEN event_type <> 'view' THEN 'view' END AS control FROM events),
sides AS (SELECT event_id, event_day, 'affected' AS side, affected AS c FROM ev UNION ALL SELECT event_id, event_day, 'control', control FROM ev WHERE control IS NOT NULL),
days AS (SELECT event_id, side, day, residual, CASE WHEN day >= event_day - 30 AND day < event_day THEN 'pre' WHEN day >= event_day AND day <= event_day + 30 THEN 'post' END AS phase
  FROM sides JOIN d ON d.event_type = sides.c),
idx AS (SELECT *, row_number() OVER (PARTITION BY event_id, side, phase ORDER BY day) - 1 AS i FROM days WHERE phase IS NOT NULL),
side AS (SELECT event_id, side, count(*) FILTER (WHERE phase = 'pre') AS npre, count(*) FILTER (WHERE phase = 'post') AS npost,
  avg(residual) FILTER (WHERE phase = 'post') - avg(residual) FILTER (WHERE phase = 'pre') AS chg, regr_slope(residual, i) FILTER (WHERE phase = 'pre') AS slope FROM idx GROUP BY ALL),
pm AS (SELECT event_id, median(residual) AS m FROM idx WHERE phase = 'pre' GROUP BY 1),
scl AS (SELECT event_id, coalesce(nullif(1.4826 * median(abs(residual - m)), 0), stddev_pop(residual)) AS scale FROM idx JOIN pm USING (event_id) WHERE phase = 'pre' GROUP BY 1),
st AS (SELECT ev.*, a.npre, a.npost, a.chg AS ac, b.chg AS cc, a.chg - coalesce(b.chg, 0) AS raw, scale,
  CASE WHEN control IS NOT NULL THEN greatest(0, 1 - abs(a.slope - b.slope) / greatest(scale, 1)) END AS par, abs(a.chg - coalesce(b.chg, 0)) / scale AS std,
  a.npre >= 5 AND a.npost >= 5 AND (control IS NULL OR (b.npre >= 5 AND b.npost >= 5)) AS enough
  FROM ev JOIN side a ON a.event_id = ev.event_id AND a.side = 'affected' LEFT JOIN side b ON b.event_id = ev.event_id AND b.side = 'control' JOIN scl ON scl.event_id = ev.event_id),
fin AS (SELECT *, CASE WHEN raw > 0 THEN 'favorable' WHEN raw < 0 THEN 'unfavorable' ELSE 'neutral' END AS dir,
  CASE WHEN NOT enough THEN 'insufficient' WHEN raw > 0 AND std >= 0.75 THEN 'contradicted' WHEN std >= 1 AND (control IS NULL OR par >= 0.5) THEN 'supported' ELSE 'weak' END AS status FROM st)"""


@query(
    "daily_cohort_aggregate",
    f"WITH {DAILY} SELECT event_type, cast(day AS VARCHAR) AS day, round(actual, 4) AS actual, round(expected, 4) AS expected, round(residual, 4) AS residual FROM d",
)
def daily_cohort_aggregate(spark, sf):
    return _daily(spark, sf).select("event_type", day("day"), r("actual", 4), r("expected", 4), r("residual", 4))


def _daily(spark, sf):
    events = daily_events(spark, sf).withColumn("value", F.col("value").cast("decimal(18,4)"))
    return E.daily_cohort_aggregate(events, "event_day", "value", None, ["event_type"])


def _events(spark, sf):
    """One study per event type, against the views as control."""
    return daily_events(spark, sf).select("event_type").distinct().select(
        F.concat(F.lit("study-"), "event_type").alias("event_id"),
        F.lit("2024-01-16").cast("date").alias("event_day"),
        F.col("event_type").alias("affected"),
        F.when(F.col("event_type") != "view", F.lit("view")).alias("control"),
        F.lit("unfavorable").alias("expected_direction"),
    )


@query(
    "event_study",
    f"""WITH {STUDY} SELECT event_id, affected, control, CASE WHEN control IS NULL THEN 'pre_post' ELSE 'difference_in_differences' END AS method, npre AS pre_periods, npost AS post_periods,
    round(ac, 8) AS affected_change, round(cc, 8) AS control_change, round(raw, 8) AS raw_effect, dir AS impact_direction, round(std, 6) AS standardized_effect,
    round(par, 6) AS parallel_trend_score, status, CASE WHEN status = 'supported' AND control IS NOT NULL AND par >= 0.75 AND std >= 1.5 THEN 'high'
      WHEN status = 'insufficient' OR par < 0.5 THEN 'low' ELSE 'medium' END AS confidence FROM fin""",
)
def event_study(spark, sf):
    return E.event_study(_daily(spark, sf), _events(spark, sf), "event_type").select(
        "event_id", "affected", "control", "method", "pre_periods", "post_periods", r("affected_change", 8), r("control_change", 8),
        r("raw_effect", 8), "impact_direction", r("standardized_effect"), r("parallel_trend_score"), "status", "confidence",
    )


@query(
    "event_window_split",
    f"WITH {DAILY} SELECT event_type, CASE WHEN day < DATE '2024-01-16' THEN 'pre' ELSE 'post' END AS phase, count(*) AS days, cast(min(day) AS VARCHAR) AS first_day, cast(max(day) AS VARCHAR) AS last_day, round(avg(residual), 8) AS mean_residual FROM d WHERE day BETWEEN DATE '2024-01-09' AND DATE '2024-01-26' GROUP BY ALL",
)
def event_window_split(spark, sf):
    split = E.event_window_split(_daily(spark, sf), F.lit("2024-01-16").cast("date"), 3, 10)
    return split.groupBy("event_type", "phase").agg(
        F.count("*").alias("days"), F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"),
        F.round(F.avg("residual"), 8).alias("mean_residual"),
    )


@query(
    "affected_vs_control",
    f"""WITH {FACT}, u AS (SELECT 'affected' AS side, actual, target FROM fact WHERE region = 'ASIA' UNION ALL SELECT 'control', actual, target FROM fact WHERE segment = 'BUILDING')
    SELECT side, count(*) AS count, round(cast(sum(actual - target) AS DOUBLE), 4) AS variance FROM u GROUP BY side""",
)
def affected_vs_control(spark, sf):
    df = fact(spark, sf, ["region", "segment", "actual", "target"])
    both = E.affected_vs_control(df, [("region", "ASIA")], [("segment", "BUILDING")])
    return both.groupBy("side").agg(
        F.count("*").alias("count"), F.round(F.sum(F.col("actual") - F.col("target")).cast("double"), 4).alias("variance")
    )


@query(
    "trend_slope",
    f"WITH {DAILY}, i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS i FROM d) SELECT event_type, round(regr_slope(residual, i), 6) AS slope FROM i GROUP BY 1",
)
def trend_slope(spark, sf):
    return E.trend_slope(_daily(spark, sf), "residual", "day", ["event_type"]).select("event_type", r("slope"))


ASIA, BUILDING, EUROPE = (("region", "ASIA"),), (("segment", "BUILDING"),), (("region", "EUROPE"),)
COHORT_EVENTS = (
    E.CohortEvent("tariff", date(1995, 6, 17), ASIA, BUILDING, "unfavorable"),
    E.CohortEvent("rebate", date(1996, 2, 1), ASIA + BUILDING, None, "favorable", 14, 21),
    E.CohortEvent("strike", date(1994, 9, 5), BUILDING, EUROPE, None, 60, 45),
    E.CohortEvent("opening", date(1992, 1, 4), EUROPE, ASIA, "unfavorable", 3, 10),
    E.CohortEvent("overlap", date(1995, 6, 17), ASIA + BUILDING, BUILDING, None, 40, 40),
)


def _cohort_events_sql() -> str:
    """The events as a table, and each cohort's days by its own filter, one after the other."""
    values = ", ".join(
        f"('{e.event_id}', DATE '{e.day}', '{E.cohort_name(e.affected)}', {'NULL' if e.control is None else repr(E.cohort_name(e.control))}, "
        f"{repr(e.expected_direction) if e.expected_direction else 'NULL'}, greatest(7, {e.pre_days}), greatest(7, {e.post_days}))"
        for e in COHORT_EVENTS
    )
    cohorts = {E.cohort_name(c): c for e in COHORT_EVENTS for c in (e.affected, e.control) if c is not None}
    where = {name: " AND ".join(f"{d} = '{v}'" for d, v in c) for name, c in cohorts.items()}
    days = " UNION ALL ".join(
        f"SELECT '{name}' AS c, period_date AS day, cast(sum(actual) AS DOUBLE) AS a, cast(sum(target) AS DOUBLE) AS e FROM fact WHERE {w} GROUP BY 2" for name, w in where.items()
    )
    shared = " UNION ALL ".join(
        f"SELECT '{e.event_id}' AS event_id, count(*) AS shared FROM fact WHERE {where[E.cohort_name(e.affected)]} AND {where[E.cohort_name(e.control)]} "
        f"AND period_date BETWEEN DATE '{e.first_day}' AND DATE '{e.last_day}'"
        for e in COHORT_EVENTS
        if e.control is not None
    )
    return f"""WITH {FACT}, ev AS (SELECT * FROM (VALUES {values}) AS v(event_id, event_day, affected, control, wanted, pre, post)),
d AS ({days}), shared AS ({shared}),
sides AS (SELECT *, 'affected' AS side, affected AS c FROM ev UNION ALL SELECT *, 'control', control FROM ev WHERE control IS NOT NULL),
days AS (SELECT event_id, side, day, a, e, a - e AS residual, CASE WHEN day < event_day THEN 'pre' ELSE 'post' END AS phase
  FROM sides JOIN d USING (c) WHERE day BETWEEN event_day - pre AND event_day + post),
idx AS (SELECT *, row_number() OVER (PARTITION BY event_id, side, phase ORDER BY day) - 1 AS i FROM days),
side AS (SELECT event_id, side, count(*) FILTER (WHERE phase = 'pre') AS npre, count(*) FILTER (WHERE phase = 'post') AS npost,
  coalesce(avg(a) FILTER (WHERE phase = 'pre'), 0) AS pre_actual, coalesce(avg(e) FILTER (WHERE phase = 'post'), 0) AS post_expected,
  coalesce(avg(residual) FILTER (WHERE phase = 'post'), 0) - coalesce(avg(residual) FILTER (WHERE phase = 'pre'), 0) AS chg,
  CASE WHEN count(*) FILTER (WHERE phase = 'pre') > 1 THEN regr_slope(residual, i) FILTER (WHERE phase = 'pre') ELSE 0 END AS slope FROM idx GROUP BY ALL),
pm AS (SELECT event_id, median(residual) AS m, count(*) AS n FROM idx WHERE phase = 'pre' GROUP BY 1),
scl AS (SELECT event_id, CASE WHEN any_value(n) < 2 THEN 0 ELSE coalesce(nullif(1.4826 * median(abs(residual - m)), 0), stddev_pop(residual)) END AS scale
  FROM idx JOIN pm USING (event_id) WHERE phase = 'pre' GROUP BY 1),
st AS (SELECT ev.*, coalesce(a.npre, 0) AS npre, coalesce(a.npost, 0) AS npost, coalesce(a.chg, 0) AS ac, CASE WHEN control IS NOT NULL THEN coalesce(b.chg, 0) END AS cc,
  a.pre_actual, b.post_expected, a.slope, coalesce(a.chg, 0) - coalesce(b.chg, 0) AS raw, coalesce(scale, 0) AS scale,
  CASE WHEN control IS NOT NULL THEN greatest(0, 1 - abs(coalesce(a.slope, 0) - coalesce(b.slope, 0)) / greatest(coalesce(scale, 0), 1)) END AS par,
  coalesce(a.npre, 0) >= 5 AND coalesce(a.npost, 0) >= 5 AND (control IS NULL OR (coalesce(b.npre, 0) >= 5 AND coalesce(b.npost, 0) >= 5)) AS enough, shared
  FROM ev LEFT JOIN side a ON a.event_id = ev.event_id AND a.side = 'affected' LEFT JOIN side b ON b.event_id = ev.event_id AND b.side = 'control'
  LEFT JOIN scl ON scl.event_id = ev.event_id LEFT JOIN shared ON shared.event_id = ev.event_id),
fin AS (SELECT *, CASE WHEN scale > 0 THEN abs(raw) / scale ELSE 0 END AS std, CASE WHEN raw > 0 THEN 'favorable' WHEN raw < 0 THEN 'unfavorable' ELSE 'neutral' END AS dir FROM st),
done AS (SELECT *, CASE WHEN NOT enough THEN 'insufficient' WHEN wanted <> dir AND std >= 0.75 THEN 'contradicted'
  WHEN std >= 1 AND (control IS NULL OR par >= 0.5) THEN 'supported' ELSE 'weak' END AS status FROM fin)
SELECT event_id, affected, control, CASE WHEN control IS NULL THEN 'pre_post' ELSE 'difference_in_differences' END AS method, npre AS pre_periods, npost AS post_periods,
  round(ac, 4) AS affected_change, round(cc, 4) AS control_change, round(raw, 4) AS raw_effect, dir AS impact_direction, round(std, 6) AS standardized_effect,
  round(par, 6) AS parallel_trend_score, status, CASE WHEN status = 'supported' AND control IS NOT NULL AND par >= 0.75 AND std >= 1.5 THEN 'high'
    WHEN status = 'insufficient' OR par < 0.5 THEN 'low' ELSE 'medium' END AS confidence, shared AS shared_rows, round(coalesce(pre_actual, 0), 4) AS pre_actual,
  CASE WHEN control IS NOT NULL THEN round(coalesce(post_expected, 0), 4) END AS control_post_expected, round(coalesce(slope, 0), 6) AS pre_trend_slope,
  concat_ws(',', CASE WHEN control IS NULL THEN 'no_control' END, CASE WHEN par < 0.5 THEN 'pre_trends_differ' END, CASE WHEN NOT enough THEN 'too_few_periods' END) AS diagnostics
FROM done"""


@query("event_study_cohorts", _cohort_events_sql())
def event_study_cohorts(spark, sf):
    df = fact(spark, sf, ["period_date", "actual", "target", "region", "segment"])
    found = E.cohort_event_study(df, "period_date", "actual", "target", COHORT_EVENTS)
    return found.select(
        "event_id", "affected", "control", "method", "pre_periods", "post_periods", r("affected_change", 4), r("control_change", 4), r("raw_effect", 4),
        "impact_direction", r("standardized_effect"), r("parallel_trend_score"), "status", "confidence", "shared_rows",
        F.round("affected_summary.pre_actual", 4).alias("pre_actual"), F.round("control_summary.post_expected", 4).alias("control_post_expected"),
        F.round("affected_summary.pre_trend_slope", 6).alias("pre_trend_slope"), F.array_join("diagnostics", ",").alias("diagnostics"),
    )
