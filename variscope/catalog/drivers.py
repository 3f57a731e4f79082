"""Beam search over predicates, stability and redundancy of dimensions, and the landscape of all of them."""

from __future__ import annotations

from dataclasses import replace

from variscope.catalog.attribution import SPEC
from variscope.catalog.registry import DIMS_SQL, FACT, investigation, query, r
from variscope.operators import drivers as D
from variscope.plans.investigation import Investigation
from variscope.sources.warehouse import DIMENSIONS, fact

WIDTH, DEEP = 12, 3
TIMED = replace(SPEC, time_field="period_date")

#: Singles, pairs and triples with the beam's rules; ``b1`` and ``b2`` are the frontiers.
BEAM = f"""{FACT}, {investigation()},
rows_ AS (SELECT row_number() OVER () AS id, * EXCLUDE (period_date) FROM prep),
long AS (UNPIVOT rows_ ON {DIMS_SQL} INTO NAME dimension VALUE value),
s1 AS (SELECT [dimension || '=' || value] AS k, count(*) AS c, sum(actual) AS a, sum(expected) AS e, NULL AS parent FROM long GROUP BY dimension, value
  HAVING count(*) >= (SELECT min_support FROM st)),
m1 AS (SELECT s1.*, cast(s1.a - s1.e AS DOUBLE) AS v, c / n AS support, abs(cast(s1.a - s1.e AS DOUBLE) / c) / coalesce(nullif(mean_abs, 0), 1) AS lift FROM s1, st),
l1 AS (SELECT *, abs(v) * sqrt(support) * ln(1 + lift) AS score, array_to_string(k, '|') AS segment FROM m1),
b1 AS (SELECT * FROM l1 ORDER BY score DESC, segment LIMIT {WIDTH}),
hit AS (SELECT id, dimension, k[1] AS p, actual, expected FROM long JOIN l1 ON k[1] = dimension || '=' || value),
s2 AS (SELECT [x.p, y.p] AS k, count(*) AS c, sum(x.actual) AS a, sum(x.expected) AS e FROM hit x JOIN hit y ON x.id = y.id AND x.dimension < y.dimension
  WHERE x.p IN (SELECT k[1] FROM b1) OR y.p IN (SELECT k[1] FROM b1) GROUP BY 1 HAVING count(*) >= (SELECT min_support FROM st)),
g2 AS (SELECT s2.*, (SELECT max(b1.score) FROM b1 WHERE b1.k[1] = s2.k[1] OR b1.k[1] = s2.k[2]) AS parent FROM s2
  WHERE NOT EXISTS (SELECT 1 FROM b1 WHERE (b1.k[1] = s2.k[1] OR b1.k[1] = s2.k[2]) AND b1.c = s2.c)),
m2 AS (SELECT g2.*, cast(g2.a - g2.e AS DOUBLE) AS v, c / n AS support, abs(cast(g2.a - g2.e AS DOUBLE) / c) / coalesce(nullif(mean_abs, 0), 1) AS lift FROM g2, st),
l2 AS (SELECT *, abs(v) * sqrt(support) * ln(1 + lift) AS score, array_to_string(k, '|') AS segment FROM m2),
b2 AS (SELECT * FROM l2 ORDER BY score DESC, segment LIMIT {WIDTH}),
s3 AS (SELECT list_sort([t.p, b2.k[1], b2.k[2]]) AS k, any_value(b2.k) AS part, count(*) AS c, sum(x.actual) AS a, sum(x.expected) AS e, any_value(b2.c) AS pc, any_value(b2.score) AS parent
  FROM b2 JOIN hit x ON x.p = b2.k[1] JOIN hit y ON y.id = x.id AND y.p = b2.k[2] JOIN hit t ON t.id = x.id AND t.dimension NOT IN (x.dimension, y.dimension)
  GROUP BY list_sort([t.p, b2.k[1], b2.k[2]]), b2.k HAVING count(*) >= (SELECT min_support FROM st)),
g3 AS (SELECT k, any_value(c) AS c, any_value(a) AS a, any_value(e) AS e, max(parent) AS parent FROM s3 GROUP BY k HAVING NOT bool_or(c = pc)),
m3 AS (SELECT g3.*, cast(g3.a - g3.e AS DOUBLE) AS v, c / n AS support, abs(cast(g3.a - g3.e AS DOUBLE) / c) / coalesce(nullif(mean_abs, 0), 1) AS lift FROM g3, st),
l3 AS (SELECT *, abs(v) * sqrt(support) * ln(1 + lift) AS score, array_to_string(k, '|') AS segment FROM m3)"""


def beam_sql(levels: int, k: int) -> str:
    every = " UNION ALL ".join(f"SELECT * FROM (SELECT segment, len(k) AS ways, c, support, a, e, v, lift, score, parent FROM l{i} ORDER BY score DESC, segment LIMIT {max(WIDTH, k)})" for i in range(1, levels + 1))
    return f"""WITH {BEAM}, every AS ({every})
SELECT segment, cast(ways AS INTEGER) AS ways, c AS count, round(support, 8) AS support, round(cast(a AS DOUBLE), 4) AS actual, round(cast(e AS DOUBLE), 4) AS expected,
  round(v, 4) AS business_impact, round(lift, 8) AS lift, round(score, 4) AS score, round(score - coalesce(parent, 0), 4) AS gain,
  CASE WHEN v > 0 THEN 'favorable' WHEN v < 0 THEN 'unfavorable' ELSE 'neutral' END AS impact_direction
FROM every ORDER BY every.score DESC, segment LIMIT {k}"""


def _beam(df):
    return df.select(
        "segment", "ways", "count", r("support", 8), r("actual", 4), r("expected", 4), r("business_impact", 4), r("lift", 8), r("score", 4), r("gain", 4), "impact_direction"
    )


@query("beam_search_pairs", beam_sql(2, 40))
def beam_search_pairs(spark, sf):
    return _beam(D.beam_search(Investigation(fact(spark, sf), SPEC).population, WIDTH, 2, 40))


@query("beam_search", beam_sql(DEEP, 25))
def beam_search(spark, sf):
    return _beam(D.beam_search(Investigation(fact(spark, sf), SPEC).population, WIDTH, DEEP, 25))


#: Scores with the rows of one quarter left out, each from its own rows; a null period leaves out none.
LEFT_OUT = f"""{FACT}, {investigation()},
q AS (SELECT *, date_trunc('quarter', period_date) AS quarter FROM prep),
outs AS (SELECT DISTINCT quarter AS o FROM q UNION ALL SELECT NULL),
long AS (UNPIVOT (SELECT * EXCLUDE (period_date) FROM q) ON {DIMS_SQL} INTO NAME dimension VALUE value),
cells AS (SELECT quarter, dimension, value, count(*) AS c, sum(residual) AS r FROM long GROUP BY ALL),
sums AS (SELECT quarter, count(*) AS n, sum(abs(residual)) AS gross FROM q GROUP BY 1),
base AS (SELECT o, sum(n) AS n, cast(sum(gross) AS DOUBLE) AS gross FROM outs JOIN sums ON o IS NULL OR quarter <> o GROUP BY o),
left_ AS (SELECT o, dimension, value, sum(c) AS c, cast(sum(r) AS DOUBLE) AS res FROM outs JOIN cells ON o IS NULL OR quarter <> o GROUP BY ALL),
shaped AS (SELECT left_.*, n, gross, abs(res) AS size, least(1, abs(res / c) / greatest(scale, 1e-9) / 3) * least(1, sqrt(c / n / 0.05)) AS surprise
  FROM left_ JOIN base ON left_.o IS NOT DISTINCT FROM base.o, sc),
placed AS (SELECT *, row_number() OVER (PARTITION BY o, dimension ORDER BY size DESC, value) AS rk FROM shaped),
loo AS (SELECT o, dimension, greatest(0, least(100, 100 * (0.5 * least(1, sum(size) / coalesce(nullif(any_value(gross), 0), 1)) + 0.22 * coalesce(sum(surprise * size) / nullif(sum(size), 0), 0)
    + 0.18 * coalesce(sum(size) FILTER (WHERE rk <= 3) / nullif(sum(size), 0), 0) + 0.1 * coalesce(sum(size) FILTER (WHERE c >= greatest(20, 0.015 * n)) / nullif(sum(size), 0), 0))
    / (1 + greatest(0, count(*) - 12) / 35))) AS score FROM placed GROUP BY o, dimension HAVING count(*) > 1),
loor AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY round(score, 9) DESC, dimension) AS rank FROM loo),
whole AS (SELECT dimension, score, rank FROM loor WHERE o IS NULL),
stable AS (SELECT whole.dimension, any_value(whole.score) AS score, any_value(whole.rank) AS rank, count(*) AS periods, avg(loor.score) AS mean_score, min(loor.score) AS lowest_score,
    max(loor.score) AS highest_score, stddev_pop(loor.score) AS score_spread, 1 - avg(abs(loor.rank - whole.rank)) / {len(DIMENSIONS) - 1} AS rank_agreement
  FROM whole JOIN loor ON loor.dimension = whole.dimension AND o IS NOT NULL GROUP BY whole.dimension),
steady AS (SELECT *, rank_agreement * (1 - least(1, coalesce(score_spread / nullif(mean_score, 0), 0))) AS stability FROM stable)"""


@query(
    "stability",
    f"""WITH {LEFT_OUT} SELECT dimension, round(score, 6) AS score, rank, cast(periods AS INTEGER) AS periods, round(mean_score, 6) AS mean_score, round(lowest_score, 6) AS lowest_score,
    round(highest_score, 6) AS highest_score, round(score_spread, 6) AS score_spread, round(rank_agreement, 6) AS rank_agreement, round(stability, 6) AS stability FROM steady""",
)
def stability(spark, sf):
    return D.stability(Investigation(fact(spark, sf), TIMED).population).select(
        "dimension", r("score"), "rank", "periods", r("mean_score"), r("lowest_score"), r("highest_score"), r("score_spread"), r("rank_agreement"), r("stability")
    )


def _entropies_sql() -> str:
    """Every grouping on its own."""
    dims = DIMENSIONS
    one = [f"SELECT {i} AS i, {i} AS j, count(*) AS c FROM prep GROUP BY {d}" for i, d in enumerate(dims)]
    two = [f"SELECT {i}, {j}, count(*) FROM prep GROUP BY {dims[i]}, {dims[j]}" for i in range(len(dims)) for j in range(i + 1, len(dims))]
    names = ", ".join(f"({i}, '{d}')" for i, d in enumerate(dims))
    return f"""parts AS ({" UNION ALL ".join(one + two)}),
h AS (SELECT i, j, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS h FROM parts GROUP BY i, j),
named AS (SELECT * FROM (VALUES {names}) AS v(i, name)),
pairs AS (SELECT a.name AS first, b.name AS second, x.h AS hx, y.h AS hy, CASE WHEN abs(x.h + y.h - p.h) < 1e-12 THEN 0 ELSE x.h + y.h - p.h END AS mi
  FROM h p JOIN h x ON x.i = p.i AND x.j = p.i JOIN h y ON y.i = p.j AND y.j = p.j JOIN named a ON a.i = p.i JOIN named b ON b.i = p.j WHERE p.i < p.j),
redundant AS (SELECT *, greatest(0, least(1, mi / sqrt(hx * hy))) AS nmi, greatest(0, least(1, mi / least(hx, hy))) AS determines FROM pairs)"""


@query(
    "redundancy",
    f"""WITH {FACT}, {investigation()}, {_entropies_sql()} SELECT first, second, round(hx, 8) AS first_entropy, round(hy, 8) AS second_entropy, round(mi, 8) AS mutual_information,
    round(nmi, 8) AS nmi, round(determines, 8) AS determines FROM redundant""",
)
def redundancy(spark, sf):
    return D.redundancy(Investigation(fact(spark, sf), SPEC).population).select(
        "first", "second", r("first_entropy", 8), r("second_entropy", 8), r("mutual_information", 8), r("nmi", 8), r("determines", 8)
    )


@query(
    "dimension_landscape",
    f"""WITH {LEFT_OUT}, {_entropies_sql()},
    sides AS (SELECT dimension, sum(least(0, business_impact)) AS unfavorable_impact, sum(greatest(0, business_impact)) AS favorable_offset FROM contributions GROUP BY 1),
    at_ AS (SELECT dimension, row_number() OVER (ORDER BY round(score, 9) DESC, dimension) AS at_ FROM scores),
    worst AS (SELECT CASE WHEN a.at_ > b.at_ THEN first ELSE second END AS dimension, max(nmi) AS redundancy FROM redundant JOIN at_ a ON a.dimension = first JOIN at_ b ON b.dimension = second GROUP BY 1),
    joined AS (SELECT s.dimension, s.score, s.surprise, s.support_quality, unfavorable_impact, favorable_offset, coalesce(stability, 0) AS stability, coalesce(redundancy, 0) AS redundancy
      FROM scores s JOIN sides USING (dimension) LEFT JOIN steady USING (dimension) LEFT JOIN worst USING (dimension)),
    done AS (SELECT *, score * (1 - 0.5 * (1 - stability)) * (1 - 0.5 * redundancy) AS combined_score FROM joined)
    SELECT dimension, round(score, 6) AS score, round(unfavorable_impact, 4) AS unfavorable_impact, round(favorable_offset, 4) AS favorable_offset, round(surprise, 8) AS surprise,
      round(support_quality, 8) AS support_quality, round(stability, 6) AS stability, round(redundancy, 6) AS redundancy, round(combined_score, 6) AS combined_score,
      row_number() OVER (ORDER BY round(done.combined_score, 9) DESC, dimension) AS rank FROM done""",
)
def dimension_landscape(spark, sf):
    inv = Investigation(fact(spark, sf), TIMED)
    found = D.landscape(inv.contributions, inv.scores, D.stability(inv.population), D.redundancy(inv.population))
    return found.select(
        "dimension", r("score"), r("unfavorable_impact", 4), r("favorable_offset", 4), r("surprise", 8), r("support_quality", 8), r("stability"), r("redundancy"), r("combined_score"), "rank"
    )
