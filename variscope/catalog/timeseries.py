"""Period-series queries: many series at once, plus the daily event series."""

from __future__ import annotations

from pyspark.sql import functions as F

from variscope.catalog.registry import FACT, GAPS, canon, day, query, r
from variscope.functions import calendar as C
from variscope.operators import timeseries as S
from variscope.sources.warehouse import daily_events, fact, fact_with_gaps

PLAN = S.SeriesSpec("actual", "period_date", "target", series=("segment",))
BASELINE = S.SeriesSpec("actual", "period_date", series=("segment",), polarity="lower_is_better")
AVERAGE = S.SeriesSpec(
    "actual", "period_date", "target", series=("region",), grain="quarter", aggregation="average", fiscal_start=7
)
BALANCE = S.SeriesSpec("quantity", "period_date", "target", series=("returnflag",), aggregation="period_end")
DAILY = S.SeriesSpec("value", "event_day", series=("event_type",), grain="day")
COLUMNS = ["period_date", "actual", "target", "segment"]


def start_sql(d: str, grain: str, fs: int = 1) -> str:
    """First day of the period of a date expression."""
    if grain == "day":
        return f"cast({d} AS DATE)"
    if grain in ("week", "month"):
        return f"cast(date_trunc('{grain}', {d}) AS DATE)"
    return f"cast(date_trunc('quarter', date_trunc('month', {d}) - INTERVAL {fs - 1} MONTH) + INTERVAL {fs - 1} MONTH AS DATE)"


def year_sql(d: str, fs: int = 1) -> str:
    return f"cast(date_trunc('year', date_trunc('month', {d}) - INTERVAL {fs - 1} MONTH) + INTERVAL {fs - 1} MONTH AS DATE)"


END_SQL = {
    "day": "{p}",
    "week": "{p} + 6",
    "month": "cast({p} + INTERVAL 1 MONTH AS DATE) - 1",
    "quarter": "cast({p} + INTERVAL 3 MONTH AS DATE) - 1",
}


def points_sql(source, series, d="period_date", actual="actual", expected="target", grain="month", fold="sum", sign=1, fs=1):
    """CTEs up to ``pts``: every point with its alert and changes; ``cov`` holds the row counts."""
    e = expected or "0"
    if fold == "sum":
        value = lambda c: f"cast(sum({c}) AS DOUBLE)"
    else:
        value = lambda c: f"cast(sum({c}) AS DOUBLE) / count(*)"
    picked = "SELECT * FROM src WHERE a IS NOT NULL AND e IS NOT NULL AND d IS NOT NULL"
    if fold == "period_end":
        picked = f"SELECT * FROM ({picked}) QUALIFY d = max(d) OVER (PARTITION BY s, p)"
        value = lambda c: f"cast(sum({c}) AS DOUBLE)"
    base = (
        f"SELECT s, p, {value('a')} AS actual, {value('e')} AS plan, {value('(a - e)')} AS diff, count(*) AS valid_row_count FROM picked GROUP BY s, p"
    )
    expected_sql = "plan" if expected else (
        "CASE WHEN count(actual) OVER h6 >= 3 THEN median(actual) OVER h6 ELSE median(actual) OVER (PARTITION BY s) END"
    )
    diff = "diff" if expected else "actual - expected"
    return f"""src AS (SELECT {canon(series)} AS s, cast({d} AS DATE) AS d, {start_sql(d, grain, fs)} AS p, {actual} AS a, {e} AS e FROM {source}),
cov AS (SELECT s, count(*) AS scoped_rows, count(d) AS parsed_rows, count(CASE WHEN d IS NOT NULL THEN a END) AS actual_rows,
  count(CASE WHEN d IS NOT NULL AND a IS NOT NULL AND e IS NOT NULL THEN 1 END) AS valid_rows,
  count(DISTINCT CASE WHEN a IS NOT NULL AND e IS NOT NULL THEN p END) AS period_count, min(d) AS min_d, max(d) AS max_d FROM src GROUP BY s),
picked AS ({picked}),
p0 AS ({base}),
p1 AS (SELECT *, {expected_sql} AS expected FROM p0 WINDOW h6 AS (PARTITION BY s ORDER BY p ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
p2 AS (SELECT *, {diff} AS variance, ({diff}) * {sign} AS impact FROM p1),
p3 AS (SELECT *, list(impact) OVER (PARTITION BY s ORDER BY p ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS hist,
  lag(impact) OVER (PARTITION BY s ORDER BY p) AS before FROM p2),
p4 AS (SELECT *, CASE WHEN len(hist) >= 4 THEN list_median(hist) END AS center FROM p3),
p5 AS (SELECT *, coalesce(nullif(1.4826 * list_median(list_transform(hist, lambda x: abs(x - center))), 0), list_stddev_pop(hist)) AS sc FROM p4),
p6 AS (SELECT *, CASE WHEN len(hist) >= 4 AND sc > 0 THEN abs(impact - center) / sc ELSE 0 END AS anomaly_score,
  greatest(0, abs(expected) * 0.03) AS threshold FROM p5),
pts AS (SELECT p6.s, p6.p, {END_SQL[grain].format(p="p6.p")} AS p_end, p6.actual, p6.expected, p6.variance, p6.impact, p6.valid_row_count, p6.anomaly_score, p6.threshold,
  abs(p6.impact) >= p6.threshold AND p6.threshold > 0 AS material,
  CASE WHEN p6.impact < 0 AND (abs(p6.impact) >= 2 * p6.threshold OR p6.anomaly_score >= 3) THEN 'critical'
       WHEN p6.impact < 0 AND ((abs(p6.impact) >= p6.threshold AND p6.threshold > 0) OR p6.anomaly_score >= 2) THEN 'watch'
       WHEN p6.impact > 0 AND abs(p6.impact) >= p6.threshold AND p6.threshold > 0 THEN 'favorable' ELSE 'normal' END AS severity,
  p6.impact - p6.before AS prior_change, p6.impact - y.impact AS year_change,
  row_number() OVER (PARTITION BY p6.s ORDER BY p6.p DESC) AS rr, cov.max_d AS latest
  FROM p6 JOIN cov ON cov.s = p6.s LEFT JOIN p6 y ON y.s = p6.s AND y.p = {start_sql("(p6.p - INTERVAL 1 YEAR)", grain, fs)})"""


POINT_SQL = """SELECT s AS series, cast(p AS VARCHAR) AS period_start, cast(p_end AS VARCHAR) AS period_end, round(actual, 6) AS actual,
  round(expected, 6) AS expected, round(impact, 6) AS business_impact, round(variance / nullif(abs(expected), 0), 6) AS variance_pct,
  valid_row_count, round(anomaly_score, 6) AS anomaly_score, round(threshold, 8) AS materiality_threshold, material, severity AS alert_severity,
  round(prior_change, 6) AS prior_period_impact_change, round(year_change, 6) AS prior_year_impact_change FROM pts"""


def _points(df, spec):
    return df.select(
        F.col(spec.series[0]).alias("series"), day("period_start"), day("period_end"), r("actual"), r("expected"),
        r("business_impact"), r("variance_pct"), "valid_row_count", r("anomaly_score"), r("materiality_threshold", 8),
        "material", "alert_severity", r("prior_period_impact_change"), r("prior_year_impact_change"),
    )


PLAN_CTE = points_sql("gaps", "segment")
BASE_CTE = points_sql("gaps", "segment", expected=None, sign=-1)
AVG_CTE = points_sql("gaps", "region", grain="quarter", fold="average", fs=7)
BAL_CTE = points_sql("gaps", "returnflag", actual="quantity", fold="period_end")
EVENTS = "daily AS (SELECT cast(ts AS DATE) AS event_day, event_type, value FROM events)"
DAY_CTE = points_sql("daily", "event_type", "event_day", "value", None, "day")


def _gaps(spark, sf, *extra):
    return fact_with_gaps(spark, sf, [*COLUMNS, *extra])


@query(
    "period_aggregate",
    f"""WITH {GAPS}, {PLAN_CTE} SELECT s AS series, cast(p AS VARCHAR) AS period_start, strftime(p, '%b %Y') AS label,
    round(actual, 4) AS actual, round(expected, 4) AS expected, valid_row_count FROM pts""",
)
def period_aggregate(spark, sf):
    return S.period_aggregate(_gaps(spark, sf), PLAN).select(
        F.col("segment").alias("series"), day("period_start"), "label", r("actual", 4), r("expected", 4), "valid_row_count"
    )


@query(
    "period_aggregate_week",
    f"""WITH {FACT}, {points_sql('fact', 'linestatus', grain='week')} SELECT s AS series, cast(p AS VARCHAR) AS period_start,
    'Week of ' || strftime(p, '%b %-d, %Y') AS label, round(actual, 4) AS actual, round(expected, 4) AS expected, valid_row_count FROM pts""",
)
def period_aggregate_week(spark, sf):
    spec = S.SeriesSpec("actual", "period_date", "target", series=("linestatus",), grain="week")
    df = fact(spark, sf, ["period_date", "actual", "target", "linestatus"])
    return S.period_aggregate(df, spec).select(
        F.col("linestatus").alias("series"), day("period_start"), "label", r("actual", 4), r("expected", 4), "valid_row_count"
    )


@query("finance_points", f"WITH {GAPS}, {PLAN_CTE} {POINT_SQL}")
def finance_points(spark, sf):
    return _points(S.finance_points(_gaps(spark, sf), PLAN), PLAN)


@query("rolling_median_baseline", f"WITH {GAPS}, {BASE_CTE} {POINT_SQL}")
def rolling_median_baseline(spark, sf):
    return _points(S.finance_points(_gaps(spark, sf), BASELINE), BASELINE)


@query("finance_points_quarter_average", f"WITH {GAPS}, {AVG_CTE} {POINT_SQL}")
def finance_points_quarter_average(spark, sf):
    return _points(S.finance_points(_gaps(spark, sf, "region"), AVERAGE), AVERAGE)


@query("finance_points_period_end", f"WITH {GAPS}, {BAL_CTE} {POINT_SQL}")
def finance_points_period_end(spark, sf):
    return _points(S.finance_points(_gaps(spark, sf, "quantity", "returnflag"), BALANCE), BALANCE)


@query("finance_points_day", f"WITH {EVENTS}, {DAY_CTE} {POINT_SQL}")
def finance_points_day(spark, sf):
    return _points(S.finance_points(daily_events(spark, sf), DAILY), DAILY)


@query(
    "rolling_anomaly_score",
    f"WITH {GAPS}, {BASE_CTE} SELECT s AS series, cast(p AS VARCHAR) AS period_start, round(anomaly_score, 6) AS anomaly_score FROM pts",
)
def rolling_anomaly_score(spark, sf):
    points = S.with_variance(S.rolling_median_baseline(S.period_aggregate(_gaps(spark, sf), BASELINE), BASELINE), BASELINE)
    return S.rolling_anomaly_score(points, BASELINE).select(F.col("segment").alias("series"), day("period_start"), r("anomaly_score"))


@query(
    "materiality_alert",
    f"WITH {GAPS}, {PLAN_CTE} SELECT severity AS alert_severity, material, count(*) AS periods FROM pts GROUP BY ALL",
)
def materiality_alert(spark, sf):
    points = S.with_variance(S.period_aggregate(_gaps(spark, sf), PLAN), PLAN)
    alerts = S.materiality_alert(S.rolling_anomaly_score(points, PLAN), PLAN)
    return alerts.groupBy("alert_severity", "material").agg(F.count("*").alias("periods"))


@query(
    "prior_period_change",
    f"WITH {GAPS}, {PLAN_CTE} SELECT s AS series, cast(p AS VARCHAR) AS period_start, round(prior_change, 6) AS prior_period_impact_change FROM pts",
)
def prior_period_change(spark, sf):
    points = S.with_variance(S.period_aggregate(_gaps(spark, sf), PLAN), PLAN)
    return S.prior_period_change(points, PLAN).select(
        F.col("segment").alias("series"), day("period_start"), r("prior_period_impact_change")
    )


@query(
    "prior_year_join",
    f"WITH {GAPS}, {PLAN_CTE} SELECT s AS series, cast(p AS VARCHAR) AS period_start, round(year_change, 6) AS prior_year_impact_change FROM pts",
)
def prior_year_join(spark, sf):
    points = S.with_variance(S.period_aggregate(_gaps(spark, sf), PLAN), PLAN)
    return S.prior_year_join(points, PLAN).select(
        F.col("segment").alias("series"), day("period_start"), r("prior_year_impact_change")
    )


@query(
    "alert_list",
    f"""WITH {GAPS}, {BASE_CTE} SELECT s AS series, cast(p AS VARCHAR) AS period_start, severity AS alert_severity, round(impact, 6) AS business_impact
    FROM pts WHERE severity <> 'normal' ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'watch' THEN 1 ELSE 2 END, p DESC, s LIMIT 6""",
)
def alert_list(spark, sf):
    points = S.finance_points(_gaps(spark, sf), BASELINE).withColumnRenamed("segment", "series")
    return S.alert_list(points).select("series", day("period_start"), "alert_severity", r("business_impact"))


@query(
    "material_periods",
    f"""WITH {GAPS}, {BASE_CTE} SELECT s AS series, cast(p AS VARCHAR) AS period_start, severity AS alert_severity,
    row_number() OVER (PARTITION BY s ORDER BY p DESC) AS recency FROM pts WHERE material OR severity IN ('critical', 'watch')
    QUALIFY recency <= 12""",
)
def material_periods(spark, sf):
    points = S.finance_points(_gaps(spark, sf), BASELINE)
    return S.material_periods(points, BASELINE).select(
        F.col("segment").alias("series"), day("period_start"), "alert_severity", F.col("recency").cast("bigint").alias("recency")
    )


def summary_sql(fold="sum", trailing=12, fs=1, sign=1, digits=4):
    f = {
        "sum": lambda c: f"sum({c})",
        "average": lambda c: f"sum({c} * valid_row_count) / sum(valid_row_count)",
        "period_end": lambda c: f"arg_max({c}, p)",
    }[fold]
    return f"""tagged AS (
  SELECT 'MTD' AS win, * FROM pts WHERE p >= date_trunc('month', latest)
  UNION ALL SELECT 'QTD', * FROM pts WHERE p >= {start_sql('latest', 'quarter', fs)}
  UNION ALL SELECT 'YTD', * FROM pts WHERE p >= {year_sql('latest', fs)}
  UNION ALL SELECT 'TRAILING', * FROM pts WHERE rr <= {trailing}),
summ AS (SELECT s, win, min(p) AS st, max(p_end) AS en, {f('actual')} AS actual, {f('expected')} AS expected, count(*) AS period_count, any_value(latest) AS latest FROM tagged GROUP BY s, win)
SELECT s AS series, win AS window, cast(st AS VARCHAR) AS start, cast(en AS VARCHAR) AS end, round(actual, {digits}) AS actual, round(expected, {digits}) AS expected,
  round((actual - expected) * {sign}, {digits}) AS business_impact, round((actual - expected) / nullif(abs(expected), 0), 6) AS variance_pct,
  round(actual / nullif(expected, 0), 6) AS pace, period_count FROM summ"""


def _summary(df, spec, digits=4):
    return df.select(
        F.col(spec.series[0]).alias("series"), "window", day("start"), day("end"), r("actual", digits), r("expected", digits),
        r("business_impact", digits), r("variance_pct"), r("pace"), "period_count",
    )


@query("period_summary", f"WITH {GAPS}, {PLAN_CTE}, {summary_sql()}")
def period_summary(spark, sf):
    return _summary(S.period_summary(S.finance_points(_gaps(spark, sf), PLAN), PLAN), PLAN)


@query("period_summary_average", f"WITH {GAPS}, {AVG_CTE}, {summary_sql('average', 4, 7, digits=6)}")
def period_summary_average(spark, sf):
    return _summary(S.period_summary(S.finance_points(_gaps(spark, sf, "region"), AVERAGE), AVERAGE), AVERAGE, 6)


@query("period_summary_period_end", f"WITH {GAPS}, {BAL_CTE}, {summary_sql('period_end')}")
def period_summary_period_end(spark, sf):
    return _summary(S.period_summary(S.finance_points(_gaps(spark, sf, "quantity", "returnflag"), BALANCE), BALANCE), BALANCE)


@query(
    "run_rate",
    f"""WITH {EVENTS}, {DAY_CTE}, m AS (SELECT s, any_value(latest) AS latest, sum(actual) AS a, sum(expected) AS e FROM pts WHERE p >= date_trunc('month', latest) GROUP BY s),
    x AS (SELECT *, day(latest) AS el, day(last_day(latest)) AS tot FROM m)
    SELECT s AS series, cast(latest AS VARCHAR) AS as_of, cast(el AS INTEGER) AS elapsed_days, cast(tot AS INTEGER) AS total_days, round(a / el * tot, 6) AS projected_actual,
      round(e / el * tot, 6) AS projected_expected, round((a - e) / el * tot, 6) AS projected_business_impact,
      CASE WHEN a > e THEN 'favorable' WHEN a < e THEN 'unfavorable' ELSE 'neutral' END AS impact_direction,
      CASE WHEN el >= 10 THEN 'medium' ELSE 'low' END AS confidence FROM x WHERE el < tot""",
)
def run_rate(spark, sf):
    return S.run_rate(S.finance_points(daily_events(spark, sf), DAILY), DAILY).select(
        F.col("event_type").alias("series"), day("as_of"), "elapsed_days", "total_days", r("projected_actual"),
        r("projected_expected"), r("projected_business_impact"), "impact_direction", "confidence",
    )


SIGNALS_CTE = """recent AS (SELECT *, CASE WHEN expected = 0 THEN 0 ELSE impact / abs(expected) END AS rate, count(*) OVER (PARTITION BY s) AS k FROM pts WHERE rr <= 12),
med AS (SELECT s, median(rate) AS m FROM recent GROUP BY s),
sg AS (SELECT s, count(*) AS recent_periods, sum(variance) / nullif(sum(abs(expected)), 0) AS bias, stddev_pop(rate) AS vol,
  coalesce(nullif(1.4826 * median(abs(rate - m)), 0), stddev_pop(rate)) AS sc,
  avg(rate) FILTER (WHERE rr <= k - k // 2) AS newer, avg(rate) FILTER (WHERE rr > k - k // 2) AS older FROM recent JOIN med USING (s) GROUP BY s),
signals AS (SELECT s, recent_periods, bias, CASE WHEN recent_periods >= 2 THEN vol END AS vol,
  CASE WHEN recent_periods >= 2 AND sc > 0 THEN abs(newer - older) / sc ELSE 0 END AS drift FROM sg)"""


@query(
    "recent_signals",
    f"WITH {GAPS}, {BASE_CTE}, {SIGNALS_CTE} SELECT s AS series, recent_periods, round(bias, 8) AS forecast_bias, round(vol, 8) AS volatility, round(drift, 6) AS drift_score FROM signals",
)
def recent_signals(spark, sf):
    return S.recent_signals(S.finance_points(_gaps(spark, sf), BASELINE), BASELINE).select(
        F.col("segment").alias("series"), "recent_periods", r("forecast_bias", 8), r("volatility", 8), r("drift_score")
    )


@query(
    "trend",
    f"""WITH {GAPS}, {BASE_CTE}, t AS (SELECT s, avg(impact) FILTER (WHERE rr <= 3) AS rec, avg(impact) FILTER (WHERE rr BETWEEN 4 AND 6) AS pri,
      avg(abs(expected)) FILTER (WHERE rr <= 6) AS ex, count(*) AS n FROM pts GROUP BY s)
    SELECT s AS series, CASE WHEN n < 6 THEN 'insufficient' WHEN abs(rec - pri) < greatest(1, ex * 0.01) THEN 'stable' WHEN rec > pri THEN 'improving' ELSE 'worsening' END AS direction,
      round(rec, 6) AS recent_average_impact, round(pri, 6) AS prior_average_impact, round(rec - pri, 6) AS change FROM t""",
)
def trend(spark, sf):
    return S.trend(S.finance_points(_gaps(spark, sf), BASELINE), BASELINE).select(
        F.col("segment").alias("series"), "direction", r("recent_average_impact"), r("prior_average_impact"), r("change")
    )


@query(
    "time_coverage",
    f"""WITH {GAPS}, {PLAN_CTE} SELECT s AS series, scoped_rows, parsed_rows, valid_rows AS valid_measure_rows, scoped_rows - parsed_rows AS unparsed_rows,
    parsed_rows - valid_rows AS excluded_measure_rows, cast(min_d AS VARCHAR) AS min_date, cast(max_d AS VARCHAR) AS max_date FROM cov""",
)
def time_coverage(spark, sf):
    return S.time_coverage(_gaps(spark, sf), PLAN).select(
        F.col("segment").alias("series"), "scoped_rows", "parsed_rows", "valid_measure_rows", "unparsed_rows",
        "excluded_measure_rows", day("min_date"), day("max_date"),
    )


@query(
    "model_health",
    f"""WITH {GAPS}, {PLAN_CTE}, {SIGNALS_CTE}, h AS (SELECT cov.s, period_count, drift, valid_rows / parsed_rows AS vr, valid_rows / actual_rows AS ec, parsed_rows / scoped_rows AS pr FROM cov JOIN signals USING (s)),
    q AS (SELECT *, greatest(0, 100 - CASE WHEN period_count < 4 THEN 55 WHEN period_count < 8 THEN 25 ELSE 0 END - CASE WHEN pr < 0.9 THEN 20 ELSE 0 END
      - CASE WHEN vr < 0.95 THEN 18 ELSE 0 END - CASE WHEN ec < 0.95 THEN 18 ELSE 0 END - CASE WHEN drift >= 3 THEN 10 ELSE 0 END) AS score FROM h)
    SELECT s AS series, CASE WHEN period_count < 4 THEN 'insufficient' WHEN score >= 80 THEN 'healthy' ELSE 'watch' END AS status, cast(score AS DOUBLE) AS score,
      period_count, round(vr, 8) AS valid_measure_rate, round(drift, 6) AS drift_score, period_count >= 18 AS seasonality_ready FROM q""",
)
def model_health(spark, sf):
    df = _gaps(spark, sf)
    health = S.model_health(S.time_coverage(df, PLAN), S.recent_signals(S.finance_points(df, PLAN), PLAN), PLAN)
    return health.select(
        F.col("segment").alias("series"), "status", "score", "period_count", r("valid_measure_rate", 8), r("drift_score"), "seasonality_ready"
    )


BOUNDS = f"""WITH {FACT}, d AS (SELECT DISTINCT period_date AS d FROM fact)"""


@query(
    "period_bounds",
    f"""{BOUNDS} SELECT cast(d AS VARCHAR) AS d, cast({start_sql('d', 'week')} AS VARCHAR) AS week_start, cast({start_sql('d', 'month')} AS VARCHAR) AS month_start,
    cast({start_sql('d', 'quarter', 7)} AS VARCHAR) AS quarter_start, cast(cast({start_sql('d', 'quarter', 7)} + INTERVAL 3 MONTH AS DATE) - 1 AS VARCHAR) AS quarter_end,
    'FY' || (year(d - INTERVAL 6 MONTH) + 1) || ' Q' || quarter(date_trunc('month', d) - INTERVAL 6 MONTH) AS quarter_label FROM d""",
)
def period_bounds(spark, sf):
    d = F.col("d")
    quarter = C.period_start(d, "quarter", 7)
    return fact(spark, sf, ["period_date"]).select(F.col("period_date").alias("d")).distinct().select(
        d.cast("string").alias("d"), C.period_start(d, "week").cast("string").alias("week_start"),
        C.period_start(d, "month").cast("string").alias("month_start"), quarter.cast("string").alias("quarter_start"),
        C.period_end(quarter, "quarter").cast("string").alias("quarter_end"),
        C.period_label(quarter, "quarter", 7).alias("quarter_label"),
    )


@query("fiscal_year_start", f"{BOUNDS} SELECT cast(d AS VARCHAR) AS d, cast({year_sql('d', 7)} AS VARCHAR) AS fiscal_year_start, cast({year_sql('d', 4)} AS VARCHAR) AS april_year_start FROM d")
def fiscal_year_start(spark, sf):
    d = F.col("d")
    return fact(spark, sf, ["period_date"]).select(F.col("period_date").alias("d")).distinct().select(
        d.cast("string").alias("d"), C.fiscal_year_start(d, 7).cast("string").alias("fiscal_year_start"),
        C.fiscal_year_start(d, 4).cast("string").alias("april_year_start"),
    )


@query("fiscal_quarter_start", f"{BOUNDS} SELECT cast(d AS VARCHAR) AS d, cast({start_sql('d', 'quarter', 2)} AS VARCHAR) AS fiscal_quarter_start FROM d")
def fiscal_quarter_start(spark, sf):
    d = F.col("d")
    return fact(spark, sf, ["period_date"]).select(F.col("period_date").alias("d")).distinct().select(
        d.cast("string").alias("d"), C.fiscal_quarter_start(d, 2).cast("string").alias("fiscal_quarter_start")
    )


@query(
    "window_cutoff",
    f"""WITH {FACT}, m AS (SELECT returnflag, max(period_date) AS d FROM fact GROUP BY 1)
    SELECT returnflag, '90d' AS window, cast(d - 89 AS VARCHAR) AS cutoff FROM m UNION ALL SELECT returnflag, '8w', cast(d - 49 AS VARCHAR) FROM m
    UNION ALL SELECT returnflag, '13w', cast(d - 84 AS VARCHAR) FROM m UNION ALL SELECT returnflag, '15m', cast(cast(date_trunc('month', d) - INTERVAL 14 MONTH AS DATE) AS VARCHAR) FROM m
    UNION ALL SELECT returnflag, '24m', cast(cast(date_trunc('month', d) - INTERVAL 23 MONTH AS DATE) AS VARCHAR) FROM m
    UNION ALL SELECT returnflag, 'mtd', cast({start_sql('d', 'month')} AS VARCHAR) FROM m UNION ALL SELECT returnflag, 'qtd', cast({start_sql('d', 'quarter', 7)} AS VARCHAR) FROM m
    UNION ALL SELECT returnflag, 'ytd', cast({year_sql('d', 7)} AS VARCHAR) FROM m""",
)
def window_cutoff(spark, sf):
    windows = ["90d", "8w", "13w", "15m", "24m", "mtd", "qtd", "ytd"]
    latest = fact(spark, sf, ["period_date", "returnflag"]).groupBy("returnflag").agg(F.max("period_date").alias("d"))
    pairs = F.array(*[
        F.struct(F.lit(w).alias("window"), C.window_cutoff(F.col("d"), w, 7).cast("string").alias("cutoff")) for w in windows
    ])
    return latest.select("returnflag", F.inline(pairs))


@query(
    "visible_points",
    f"WITH {GAPS}, {PLAN_CTE} SELECT s AS series, count(*) AS periods, cast(min(p) AS VARCHAR) AS first_period, round(sum(impact), 4) AS business_impact FROM pts WHERE p >= date_trunc('month', latest) - INTERVAL 14 MONTH GROUP BY s",
)
def visible_points(spark, sf):
    shown = S.visible_points(S.finance_points(_gaps(spark, sf), PLAN), "15m")
    return shown.groupBy(F.col("segment").alias("series")).agg(
        F.count("*").alias("periods"), F.min("period_start").cast("string").alias("first_period"),
        F.round(F.sum("business_impact"), 4).alias("business_impact"),
    )


def _signal(spark, sf, column):
    return S.recent_signals(S.finance_points(_gaps(spark, sf), BASELINE), BASELINE).select(
        F.col("segment").alias("series"), r(column, 6)
    )


@query("forecast_bias", f"WITH {GAPS}, {BASE_CTE}, {SIGNALS_CTE} SELECT s AS series, round(bias, 6) AS forecast_bias FROM signals")
def forecast_bias(spark, sf):
    return _signal(spark, sf, "forecast_bias")


@query("volatility", f"WITH {GAPS}, {BASE_CTE}, {SIGNALS_CTE} SELECT s AS series, round(vol, 6) AS volatility FROM signals")
def volatility(spark, sf):
    return _signal(spark, sf, "volatility")


@query("drift_score", f"WITH {GAPS}, {BASE_CTE}, {SIGNALS_CTE} SELECT s AS series, round(drift, 6) AS drift_score FROM signals")
def drift_score(spark, sf):
    return _signal(spark, sf, "drift_score")
