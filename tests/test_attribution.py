from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from variscope.operators import attribution as A
from variscope.operators.cohort import CohortSpec, apply_predicates, drill
from variscope.plans.investigation import Investigation


@pytest.fixture(scope="module")
def basic(spark):
    rows = [("West", 100.0, 120.0), ("East", 80.0, 70.0), (" ", 140.0, 110.0), (None, None, 100.0)]
    return spark.createDataFrame(rows, "region string, actual double, target double")


def test_invalid_measures_are_excluded_and_counted(basic):
    spec = CohortSpec(("region",), "actual", "target", polarity="lower_is_better")
    row = Investigation(basic, spec).scope.first()
    assert (row["row_count"], row["valid_row_count"], row["excluded_measure_rows"]) == (4, 3, 1)
    assert (row["actual"], row["expected"], row["variance"]) == (320.0, 300.0, 20.0)
    assert row["business_impact"] == -20.0 and row["impact_direction"] == "unfavorable"


def test_missing_matches_null_and_blank(basic):
    assert apply_predicates(basic, [("region", "(missing)")]).count() == 2
    assert apply_predicates(basic, [("region", "West")]).count() == 1


def two_groups(spark, dated=True):
    rows = [("2025-01-31" if i < 10 else "2025-02-28", "A", 120.0, 100.0) for i in range(20)]
    rows += [("2025-01-31" if i < 10 else "2025-02-28", "B", 80.0, 100.0) for i in range(20)]
    return spark.createDataFrame(rows, "period_date string, group string, actual double, target double")


def test_average_contributions_reconcile(spark):
    spec = CohortSpec(("group",), "actual", "target", aggregation="average")
    inv = Investigation(two_groups(spark), spec)
    scope = inv.scope.first()
    assert scope["actual"] == 100.0 and scope["business_impact"] == 0.0
    assert scope["attribution_basis"] == "support_weighted_average"
    assert inv.contributions.agg(F.sum("business_impact")).first()[0] == pytest.approx(0.0)


def test_period_end_uses_only_the_latest_date(spark):
    rows = [("2025-01-31", "A", 5.0, 5.0)] * 20 + [("2025-02-28", "A", 10.0, 10.0)] * 20
    df = spark.createDataFrame(rows, "period_date string, group string, actual double, target double")
    spec = CohortSpec(("group",), "actual", "target", aggregation="period_end", time_field="period_date")
    row = Investigation(df, spec).scope.first()
    assert (row["valid_row_count"], row["actual"], row["expected"]) == (20, 200.0, 200.0)
    assert str(row["population_date"]) == "2025-02-28" and row["attribution_reconciles"]


def test_period_end_without_dates_falls_back(spark):
    spec = CohortSpec(("group",), "actual", "target", aggregation="period_end")
    inv = Investigation(two_groups(spark).drop("period_date"), spec)
    row = inv.scope.first()
    assert row["valid_row_count"] == 40 and not row["attribution_reconciles"]
    warnings = {w["warning"] for w in A.scope_warnings(inv.scope, spec).collect()}
    assert "period_end_fallback" in warnings


def test_median_baseline_without_a_comparison(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 10.0)], "g string, actual double")
    row = Investigation(df, CohortSpec(("g",), "actual")).scope.first()
    assert row["expected"] == 9.0 and row["baseline_method"] == "robust-median"


def random_rows(n=600, seed=3):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        region, product, channel = rng.choice("NSEW"), rng.choice("xyz"), rng.choice(["web", "shop"])
        bump = 30.0 if (region, channel) == ("N", "web") else 0.0
        rows.append((region, product, channel, round(rng.gauss(100, 10) - bump, 4), 100.0))
    return rows


def brute_interactions(rows):
    """Every pair and triple of the candidate categories, each by a full pass over the rows."""
    dims = ["region", "product", "channel"]
    prepared = [(dict(zip(dims, r[:3])), r[3], r[4], r[3] - r[4]) for r in rows]
    n = len(prepared)
    center = statistics.median(p[3] for p in prepared)
    scale = 1.4826 * statistics.median(abs(p[3] - center) for p in prepared)
    need = max(20, 0.015 * n)
    scores = []
    for d in dims:
        groups = {}
        for p in prepared:
            groups.setdefault(p[0][d], []).append(p)
        cats = []
        for v, ps in groups.items():
            residual = sum(p[3] for p in ps)
            z = abs(residual / len(ps)) / scale
            cats.append((v, len(ps), residual, min(1, z / 3) * min(1, (len(ps) / n / 0.05) ** 0.5)))
        gross = sum(abs(c[2]) for c in cats)
        cats.sort(key=lambda c: (-abs(c[2]), c[0]))
        impact = min(1, gross / sum(abs(p[3]) for p in prepared))
        surprise = sum(c[3] * abs(c[2]) / gross for c in cats)
        top3 = sum(abs(c[2]) / gross for c in cats[:3])
        quality = sum(abs(c[2]) for c in cats if c[1] >= need) / gross
        scores.append((100 * (0.5 * impact + 0.22 * surprise + 0.18 * top3 + 0.1 * quality), d, cats))
    scores.sort(key=lambda s: (-s[0], s[1]))
    picked = [(d, c[0]) for _, d, cats in scores for c in [c for c in cats if c[1] >= need][:2]]
    mean_abs = sum(abs(p[3]) for p in prepared) / n
    import itertools
    import math

    found = {}
    for k in (2, 3):
        for combo in itertools.combinations(picked, k):
            if len({d for d, _ in combo}) < k:
                continue
            subset = [p for p in prepared if all(p[0][d] == v for d, v in combo)]
            if len(subset) < need:
                continue
            v = sum(p[3] for p in subset)
            lift = abs(v / len(subset)) / mean_abs
            score = abs(v) * math.sqrt(len(subset) / n) * math.log1p(lift)
            found["|".join(sorted(f"{d}={x}" for d, x in combo))] = (len(subset), v, score)
    return {d: s for s, d, _ in scores}, found


def test_scores_and_interactions_match_brute_force(spark):
    rows = random_rows()
    df = spark.createDataFrame(rows, "region string, product string, channel string, actual double, target double")
    inv = Investigation(df, CohortSpec(("region", "product", "channel"), "actual", "target"))
    scores, expected = brute_interactions(rows)
    for r in inv.scores.collect():
        assert r["score"] == pytest.approx(scores[r["dimension"]])
        assert 0 <= r["score"] <= 100
    got = {r["segment"]: r for r in inv.interactions.collect()}
    best = sorted(expected, key=lambda k: (-expected[k][2], k))[:12]
    assert set(got) == set(best)
    for k in best:
        assert got[k]["count"] == expected[k][0]
        assert got[k]["business_impact"] == pytest.approx(expected[k][1])
        assert got[k]["score"] == pytest.approx(expected[k][2])


def test_contributions_add_up(spark):
    df = spark.createDataFrame(random_rows(), "region string, product string, channel string, actual double, target double")
    inv = Investigation(df, CohortSpec(("region", "product", "channel"), "actual", "target"))
    total = inv.scope.first()["business_impact"]
    for r in inv.contributions.groupBy("dimension").agg(F.sum("business_impact").alias("i"), F.sum("support").alias("s")).collect():
        assert r["i"] == pytest.approx(total) and r["s"] == pytest.approx(1.0)
    inv.release()


def test_drill_replaces_and_appends():
    spec = CohortSpec(("a", "b", "c"), "actual", predicates=(("a", "1"),))
    child = drill(spec, [("a", "2"), ("b", "3")])
    assert child.predicates == (("a", "2"), ("b", "3")) and child.open_dimensions == ["c"]


def test_cohort_compare_prefers_the_higher_impact(spark):
    pop = A.Population(two_groups(spark), CohortSpec(("group",), "actual", "target", polarity="lower_is_better"))
    better = {r["value"]: r["better"] for r in A.cohort_compare(pop, "group", "A", "B").collect()}
    assert better == {"A": False, "B": True}


@pytest.mark.parametrize("following", [[("product", "x")], [("region", "S")], [("channel", "(missing)")]])
def test_drill_equals_a_fresh_investigation(spark, following):
    rows = [(*r[:2], r[2] if i % 5 else None, r[3] if i % 11 else None, r[4]) for i, r in enumerate(random_rows())]
    df = spark.createDataFrame(rows, "region string, product string, channel string, actual double, target double")
    spec = CohortSpec(("region", "product", "channel"), "actual", "target", predicates=(("region", "N"),))
    child = Investigation(df, spec).drill(following)
    fresh = Investigation(df, child.spec)
    assert child.scope.first().asDict() == pytest.approx(fresh.scope.first().asDict())
    by_name = lambda i: {r["dimension"]: r["score"] for r in i.scores.collect()}
    assert by_name(child) == pytest.approx(by_name(fresh))


def test_measured_rows_and_category_sums_are_stored_once(spark):
    """Steps that run side by side read files; a cache would be filled by each of them."""
    pop = A.Population(two_groups(spark), CohortSpec(("group",), "actual", "target"))
    assert pop.measured.inputFiles() and A.group_dimension(pop).inputFiles()
    child = A.Population(two_groups(spark), CohortSpec(("group",), "actual", "target", predicates=(("group", "A"),)), within=pop)
    assert set(child.measured.inputFiles()) <= set(pop.measured.inputFiles())
