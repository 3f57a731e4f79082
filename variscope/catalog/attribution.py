"""Attribution queries: totals, contributions, scores, combinations."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from variscope.catalog.registry import DIMS_SQL, FACT, GAPS, canon, day, investigation, query, r
from variscope.functions.quantiles import robust_scale
from variscope.functions.values import canonical_category
from variscope.operators import attribution as A
from variscope.operators.cohort import CohortSpec
from variscope.plans.investigation import Investigation
from variscope.sources.warehouse import DIMENSIONS, fact, fact_with_gaps

SPEC = CohortSpec(tuple(DIMENSIONS), "actual", "target")
COST = CohortSpec(tuple(DIMENSIONS), "actual", "target", polarity="lower_is_better", aggregation="average")

# Totals need no dimension, so their rows come without the joins behind the dimensions.
MEASURES = ["actual", "target"]

TOTALS = [
    "row_count", "valid_row_count", "excluded_measure_rows", "attribution_reconciles",
    "baseline_method", "attribution_basis", "impact_direction",
]


def _totals(df, digits=4):
    return df.select(
        *TOTALS, r("actual", digits), r("expected", digits), r("variance", digits), r("business_impact", digits),
        r("variance_pct"), r("anomaly_score"), r("residual_scale"), day("population_date"),
    )


def totals_sql(source, where="TRUE", sign=1, average=False, actual="actual", expected="target",
               selected="TRUE", method="target", basis="total", date="cast(NULL AS VARCHAR)", digits=4):
    fold = "avg" if average else "sum"
    cast = lambda x: f"cast({x} AS DOUBLE)" if not average else f"{x}"
    d = lambda x: f"cast({x} AS DOUBLE)" if average else x
    return f"""marked AS (SELECT {actual} AS a, {expected} AS e, ({selected}) AND {actual} IS NOT NULL AND {expected} IS NOT NULL AS valid
  FROM {source} WHERE {where}),
v AS (SELECT *, a - e AS res FROM marked WHERE valid),
m AS (SELECT median(cast(res AS DOUBLE)) AS med FROM v),
sc AS (SELECT coalesce(nullif(1.4826 * median(abs(cast(res AS DOUBLE) - med)), 0), nullif(stddev_pop(cast(res AS DOUBLE)), 0), 1) AS scale FROM v, m),
t AS (SELECT (SELECT count(*) FROM marked) AS row_count, count(*) AS valid_row_count,
  {cast(f"{fold}({d('a')})")} AS actual, {cast(f"{fold}({d('e')})")} AS expected, {cast(f"{fold}({d('res')})")} AS variance,
  avg(cast(res AS DOUBLE)) AS mr FROM v)
SELECT row_count, valid_row_count, row_count - valid_row_count AS excluded_measure_rows, TRUE AS attribution_reconciles,
  '{method}' AS baseline_method, '{basis}' AS attribution_basis,
  CASE WHEN variance * {sign} > 0 THEN 'favorable' WHEN variance * {sign} < 0 THEN 'unfavorable' ELSE 'neutral' END AS impact_direction,
  round(actual, {digits}) AS actual, round(expected, {digits}) AS expected, round(variance, {digits}) AS variance, round(variance * {sign}, {digits}) AS business_impact,
  round(variance / nullif(abs(expected), 0), 6) AS variance_pct, round(abs(mr) / greatest(scale, 1e-9), 6) AS anomaly_score,
  round(scale, 6) AS residual_scale, {date} AS population_date FROM t, sc"""


@query("scope_totals", f"WITH {GAPS}, " + totals_sql("gaps"))
def scope_totals(spark, sf):
    return _totals(Investigation(fact_with_gaps(spark, sf, MEASURES), replace(SPEC, dimensions=())).scope)


@query(
    "scope_totals_average",
    f"WITH {GAPS}, "
    + totals_sql("gaps", f"{canon('region')} = 'ASIA' AND {canon('priority')} = '(missing)'", -1, True,
                 basis="support_weighted_average", digits=8),
)
def scope_totals_average(spark, sf):
    spec = CohortSpec(
        ("region", "priority"), "actual", "target",
        predicates=(("region", "ASIA"), ("priority", "(missing)")),
        polarity="lower_is_better", aggregation="average",
    )
    return _totals(Investigation(fact_with_gaps(spark, sf, [*MEASURES, "region", "priority"]), spec).scope, 8)


@query(
    "scope_totals_period_end",
    f"WITH {FACT}, "
    + totals_sql("fact", selected="period_date = (SELECT max(period_date) FROM fact)", basis="latest_period_total",
                 date="(SELECT cast(max(period_date) AS VARCHAR) FROM fact)"),
)
def scope_totals_period_end(spark, sf):
    spec = CohortSpec((), "actual", "target", aggregation="period_end", time_field="period_date")
    return _totals(Investigation(fact(spark, sf, [*MEASURES, "period_date"]), spec).scope)


@query(
    "median_baseline",
    f"WITH {GAPS}, base AS (SELECT cast(median(cast(actual AS DOUBLE)) AS DECIMAL(18,6)) AS b FROM gaps), src AS (SELECT actual, b FROM gaps, base), "
    + totals_sql("src", expected="b", method="robust-median", digits=6),
)
def median_baseline(spark, sf):
    return _totals(Investigation(fact_with_gaps(spark, sf, ["actual"]), CohortSpec((), "actual")).scope, 6)


@query(
    "scope_warnings",
    f"""WITH {GAPS} SELECT unnest(['lower_is_better', 'support_weighted_average', 'rows_excluded']) AS warning
    FROM (SELECT count(*) AS n, count(actual) AS v FROM gaps) WHERE v < n""",
)
def scope_warnings(spark, sf):
    inv = Investigation(fact_with_gaps(spark, sf, MEASURES), replace(COST, dimensions=()))
    return A.scope_warnings(inv.scope, COST)


@query(
    "robust_scale",
    f"""WITH {FACT}, x AS (SELECT cast(actual - target AS DOUBLE) AS v FROM fact), m AS (SELECT median(v) AS c FROM x)
    SELECT round(any_value(c), 6) AS center, round(median(abs(v - c)), 6) AS mad,
      round(coalesce(nullif(1.4826 * median(abs(v - c)), 0), nullif(stddev_pop(v), 0), 1), 6) AS scale, count(*) AS n FROM x, m""",
)
def robust_scale_query(spark, sf):
    rows = fact(spark, sf, ["actual", "target"])
    s = robust_scale(rows, F.col("actual") - F.col("target"))
    return rows.agg(
        F.round(F.lit(s.center), 6).alias("center"),
        F.round(F.lit(s.mad), 6).alias("mad"),
        F.round(F.lit(s.scale), 6).alias("scale"),
        F.count("*").alias("n"),
    )


def contribution_sql(digits=4):
    return f"""SELECT dimension, value, count, round(support, 8) AS support, round(actual, {digits}) AS actual,
  round(expected, {digits}) AS expected, round(variance, {digits}) AS variance, round(business_impact, {digits}) AS business_impact,
  impact_direction, round(variance_per_row, 8) AS variance_per_row,
  round(standardized_residual, 8) AS standardized_residual, round(surprise, 8) AS surprise,
  round(share_of_abs_variance, 8) AS share_of_abs_variance FROM contributions"""


def _contributions(df, digits=4):
    return df.select(
        "dimension", "value", "count", r("support", 8), r("actual", digits), r("expected", digits), r("variance", digits),
        r("business_impact", digits), "impact_direction", r("variance_per_row", 8), r("standardized_residual", 8),
        r("surprise", 8), r("share_of_abs_variance", 8),
    )


@query("group_dimension", f"WITH {GAPS}, {investigation('gaps')} {contribution_sql()}")
def group_dimension(spark, sf):
    return _contributions(Investigation(fact_with_gaps(spark, sf), SPEC).contributions)


@query(
    "group_dimension_average",
    f"WITH {GAPS}, {investigation('gaps', sign=-1, average=True)} {contribution_sql(8)}",
)
def group_dimension_average(spark, sf):
    return _contributions(Investigation(fact_with_gaps(spark, sf), COST).contributions, 8)


SCORE_SQL = """SELECT dimension, distinct_count, round(score, 6) AS score, round(impact, 8) AS impact,
  round(surprise, 8) AS surprise, round(concentration, 8) AS concentration, round(support_quality, 8) AS support_quality,
  round(cardinality_penalty, 8) AS cardinality_penalty, top_category, round(top_category_impact, 6) AS top_category_impact FROM scores"""


def _scores(df):
    return df.select(
        "dimension", "distinct_count", r("score"), r("impact", 8), r("surprise", 8), r("concentration", 8),
        r("support_quality", 8), r("cardinality_penalty", 8), "top_category", r("top_category_impact"),
    )


@query("score_dimensions", f"WITH {GAPS}, {investigation('gaps')} {SCORE_SQL}")
def score_dimensions(spark, sf):
    return _scores(Investigation(fact_with_gaps(spark, sf), SPEC).scores)


@query("score_dimensions_average", f"WITH {GAPS}, {investigation('gaps', sign=-1, average=True)} {SCORE_SQL}")
def score_dimensions_average(spark, sf):
    return _scores(Investigation(fact_with_gaps(spark, sf), COST).scores)


@query(
    "top_dimensions",
    f"""WITH {FACT}, {investigation(where="segment = 'BUILDING'", dims=[d for d in DIMENSIONS if d != "segment"])}
    {SCORE_SQL} ORDER BY scores.score DESC, dimension LIMIT 5""",
)
def top_dimensions(spark, sf):
    spec = CohortSpec(tuple(DIMENSIONS), "actual", "target", predicates=(("segment", "BUILDING"),))
    return _scores(A.top_dimensions(Investigation(fact(spark, sf), spec).scores, 5))


@query(
    "drill",
    f"""WITH {FACT}, {investigation(where="segment = 'BUILDING' AND region = 'ASIA'", dims=[d for d in DIMENSIONS if d not in ("segment", "region")])}
    {SCORE_SQL}""",
)
def drill_query(spark, sf):
    spec = CohortSpec(tuple(DIMENSIONS), "actual", "target", predicates=(("segment", "BUILDING"), ("region", "EUROPE")))
    return _scores(Investigation(fact(spark, sf), spec).drill([("region", "ASIA")]).scores)


@query(
    "parent_comparison",
    f"""WITH {FACT}, pa AS (WITH {investigation(dims=[d for d in DIMENSIONS])} SELECT dimension, score, row_number() OVER (ORDER BY score DESC, dimension) AS rk FROM scores),
    ch AS (WITH {investigation(where="region = 'ASIA'", dims=[d for d in DIMENSIONS if d != "region"])} SELECT dimension, score, row_number() OVER (ORDER BY score DESC, dimension) AS rk FROM scores)
    SELECT pa.dimension, pa.rk AS parent_rank, ch.rk AS child_rank, pa.rk - ch.rk AS rank_gain,
      round(ch.score - pa.score, 6) AS score_change FROM pa LEFT JOIN ch USING (dimension)""",
)
def parent_comparison(spark, sf):
    parent = Investigation(fact(spark, sf), SPEC)
    child = parent.drill([("region", "ASIA")])
    return A.parent_comparison(parent.scores, child.scores).select(
        "dimension", *[F.col(c).cast("bigint").alias(c) for c in ("parent_rank", "child_rank", "rank_gain")], r("score_change")
    )


@query(
    "top_category",
    f"WITH {GAPS}, {investigation('gaps')} SELECT dimension, value, count, round(business_impact, 4) AS business_impact FROM contributions WHERE top_rank = 1",
)
def top_category(spark, sf):
    inv = Investigation(fact_with_gaps(spark, sf), SPEC)
    return A.top_category(inv.contributions, inv.population.minimum_support).select(
        "dimension", "value", "count", r("business_impact", 4)
    )


@query(
    "top_contributions",
    f"""WITH {FACT}, {investigation()} SELECT dimension, value, round(business_impact, 4) AS business_impact FROM contributions
    ORDER BY abs(contributions.business_impact) DESC, dimension, value LIMIT 25""",
)
def top_contributions(spark, sf):
    return A.top_contributions(Investigation(fact(spark, sf), SPEC).contributions, 25).select(
        "dimension", "value", r("business_impact", 4)
    )


@query(
    "category_rank",
    f"""WITH {FACT}, {investigation()} SELECT dimension, value, category_rank, round(share_of_abs_variance, 8) AS share_of_abs_variance,
    round(sum(share_of_abs_variance) FILTER (WHERE category_rank <= 3) OVER (PARTITION BY dimension), 8) AS concentration_top3 FROM contributions""",
)
def category_rank(spark, sf):
    inv = Investigation(fact(spark, sf), SPEC)
    return A.category_ranks(inv.contributions).select(
        "dimension", "value", "category_rank", r("share_of_abs_variance", 8), r("concentration_top3", 8)
    )


INTERACTION_SQL = f""", best AS (SELECT dimension, row_number() OVER (ORDER BY score DESC, dimension) AS dr FROM scores),
cand AS (SELECT c.dimension, c.value, dr, row_number() OVER (PARTITION BY c.dimension ORDER BY abs(business_impact) DESC, c.value) AS cr
  FROM contributions c JOIN best USING (dimension) WHERE dr <= 8 AND support >= 0.015 AND count >= 20),
rows_ AS (SELECT row_number() OVER () AS id, * EXCLUDE (period_date) FROM prep),
hit AS (SELECT id, u.dimension, u.value, actual, expected FROM (UNPIVOT rows_ ON {DIMS_SQL} INTO NAME dimension VALUE value) u
  JOIN cand USING (dimension, value) WHERE cr <= 2),
combos AS (
  SELECT [a.dimension || '=' || a.value, b.dimension || '=' || b.value] AS k, a.actual, a.expected
    FROM hit a JOIN hit b ON a.id = b.id AND a.dimension < b.dimension
  UNION ALL
  SELECT [a.dimension || '=' || a.value, b.dimension || '=' || b.value, d.dimension || '=' || d.value], a.actual, a.expected
    FROM hit a JOIN hit b ON a.id = b.id AND a.dimension < b.dimension JOIN hit d ON d.id = b.id AND b.dimension < d.dimension),
agg AS (SELECT k, count(*) AS count, cast(sum(actual) AS DOUBLE) AS a, cast(sum(expected) AS DOUBLE) AS e,
    cast(sum(actual) - sum(expected) AS DOUBLE) AS v FROM combos GROUP BY k),
inter AS (SELECT array_to_string(list_sort(k), '|') AS segment, len(k) AS ways, count, count / n AS support, a, e, v,
    abs(v / count) / coalesce(nullif(mean_abs, 0), 1) AS lift FROM agg, st WHERE count >= min_support)
SELECT segment, cast(ways AS INTEGER) AS ways, count, round(support, 8) AS support, round(a, 4) AS actual, round(e, 4) AS expected,
  round(v, 4) AS business_impact, round(lift, 8) AS lift, round(abs(v) * sqrt(support) * ln(1 + lift), 4) AS score
FROM inter ORDER BY abs(v) * sqrt(support) * ln(1 + lift) DESC, segment LIMIT 12"""


@query("find_interactions", f"WITH {FACT}, {investigation()}{INTERACTION_SQL}")
def find_interactions(spark, sf):
    return Investigation(fact(spark, sf), SPEC).interactions.select(
        "segment", "ways", "count", r("support", 8), r("actual", 4), r("expected", 4),
        r("business_impact", 4), r("lift", 8), r("score", 4),
    )


@query(
    "top_interactions",
    f"WITH {FACT}, {investigation()}{INTERACTION_SQL}".replace("LIMIT 12", "LIMIT 5"),
)
def top_interactions(spark, sf):
    inv = Investigation(fact(spark, sf), SPEC)
    return A.find_interactions(inv.population, inv.candidates, 5).select(
        "segment", "ways", "count", r("support", 8), r("actual", 4), r("expected", 4),
        r("business_impact", 4), r("lift", 8), r("score", 4),
    )


@query(
    "share_of_abs",
    f"WITH {GAPS}, {investigation('gaps')} SELECT dimension, value, round(share_of_abs_variance, 8) AS share_of_abs_variance FROM contributions",
)
def share_of_abs(spark, sf):
    return Investigation(fact_with_gaps(spark, sf), SPEC).contributions.select("dimension", "value", r("share_of_abs_variance", 8))


@query(
    "concentration_top3",
    f"WITH {GAPS}, {investigation('gaps')} SELECT dimension, round(sum(share_of_abs_variance), 8) AS concentration FROM contributions WHERE category_rank <= 3 GROUP BY 1 HAVING count(*) > 1",
)
def concentration_top3(spark, sf):
    return Investigation(fact_with_gaps(spark, sf), SPEC).scores.select("dimension", r("concentration", 8))


@query(
    "cohort_compare",
    f"""WITH {FACT}, x AS (SELECT region AS value, count(*) AS count, cast(sum(actual) AS DOUBLE) AS actual, cast(sum(target) AS DOUBLE) AS expected,
      cast(sum(actual) - sum(target) AS DOUBLE) AS business_impact FROM fact WHERE segment = 'BUILDING' AND region IN ('ASIA', 'EUROPE') GROUP BY 1)
    SELECT value, count, round(actual, 4) AS actual, round(expected, 4) AS expected, round(business_impact, 4) AS business_impact,
      business_impact = (SELECT max(business_impact) FROM x) AS better FROM x""",
)
def cohort_compare(spark, sf):
    spec = CohortSpec(tuple(DIMENSIONS), "actual", "target", predicates=(("segment", "BUILDING"),))
    pop = A.Population(fact(spark, sf), spec)
    return A.cohort_compare(pop, "region", "ASIA", "EUROPE").select(
        "value", "count", r("actual", 4), r("expected", 4), r("business_impact", 4), "better"
    )


@query(
    "grouping_sets",
    f"""WITH {FACT} SELECT coalesce(region, '(all)') AS region, coalesce(segment, '(all)') AS segment, coalesce(returnflag, '(all)') AS returnflag,
      count(*) AS count, round(cast(sum(actual - target) AS DOUBLE), 4) AS variance
    FROM fact GROUP BY GROUPING SETS ((region), (segment), (returnflag), (region, segment))""",
)
def grouping_sets(spark, sf):
    df = fact(spark, sf, ["region", "segment", "returnflag", "actual", "target"])
    return (
        df.groupingSets(
            [["region"], ["segment"], ["returnflag"], ["region", "segment"]], "region", "segment", "returnflag"
        )
        .agg(F.count("*").alias("count"), F.sum(F.col("actual") - F.col("target")).alias("variance"))
        .select(
            *[F.coalesce(c, F.lit("(all)")).alias(c) for c in ("region", "segment", "returnflag")],
            "count", r("variance", 4),
        )
    )


@query(
    "distinct_aggregates",
    f"WITH {GAPS} SELECT dimension, count(DISTINCT value) AS distinct_count FROM (UNPIVOT (SELECT {', '.join(canon(d) + ' AS ' + d for d in DIMENSIONS)} FROM gaps) ON {DIMS_SQL} INTO NAME dimension VALUE value) GROUP BY 1",
)
def distinct_aggregates(spark, sf):
    df = fact_with_gaps(spark, sf, DIMENSIONS)
    long = df.select(*[canonical_category(df, d).alias(d) for d in DIMENSIONS]).unpivot(
        [], DIMENSIONS, "dimension", "value"
    )
    return long.groupBy("dimension").agg(F.count_distinct("value").alias("distinct_count"))
