from __future__ import annotations

import datetime as dt
import itertools
import math
import random

import pytest

from variscope.operators import drivers as D
from variscope.operators import events as E
from variscope.operators.attribution import score_dimensions
from variscope.operators.cohort import CohortSpec
from variscope.plans.investigation import Investigation
from variscope.sources.warehouse import DIMENSIONS, fact

DIMS = ("region", "channel", "product", "twin", "single")


def sales(seed: int, n: int):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        region, channel, product = rng.choice("WWEN"), rng.choice(["Store", "Web", None]), rng.choice(["X", "Y", "Z", "rare"] if rng.random() < 0.05 else ["X", "Y"])
        loss = 40.0 if (region, channel, product) == ("W", "Store", "X") else 0.0
        day = dt.date(2024, rng.randint(1, 12), 5) if rng.random() < 0.97 else None
        rows.append((day, region, channel, product, f"twin of {region}", "one", round(rng.uniform(90, 110) - loss, 2), 100.0))
    return rows


@pytest.fixture(scope="module")
def sold(spark):
    return spark.createDataFrame(sales(1, 3000), "day date, region string, channel string, product string, twin string, single string, actual double, target double")


def population(df, **settings):
    return Investigation(df, CohortSpec(DIMS, "actual", "target", time_field="day", **settings)).population


def exhaustive(rows, depth, least):
    """Every combination with enough rows that no part of it makes redundant, with its score."""
    n, mean_abs = len(rows), sum(abs(r[6] - r[7]) for r in rows) / len(rows)
    sums: dict = {}
    for r in rows:
        items = [(d, "(missing)" if v is None else v) for d, v in zip(DIMS, r[1:6], strict=True)]
        for k in range(1, depth + 1):
            for combo in itertools.combinations(sorted(items), k):
                c, v = sums.get(combo, (0, 0.0))
                sums[combo] = c + 1, v + r[6] - r[7]
    out = []
    for combo, (c, v) in sums.items():
        if c >= least and not any(sums[combo[:i] + combo[i + 1 :]][0] == c for i in range(len(combo)) if len(combo) > 1):
            out.append((abs(v) * math.sqrt(c / n) * math.log1p(abs(v / c) / mean_abs), combo, c))
    return sorted(out, key=lambda x: (-x[0], x[1]))


@pytest.mark.parametrize(("width", "k"), [(200, 200), (200, 5)])
def test_a_wide_beam_is_an_exhaustive_search(sold, width, k):
    pop = population(sold)
    want = exhaustive(sales(1, 3000), 3, pop.minimum_support)
    got = D.beam_search(pop, width, 3, k).collect()
    assert len(got) == min(k, len(want)) and got[0]["business_impact"] < 0
    for r, (score, combo, count) in zip(got, want, strict=False):
        assert r["score"] == pytest.approx(score, rel=1e-9) and r["count"] == count
        assert {(p["dimension"], p["value"]) for p in r["predicates"]} == set(combo)


def test_the_beam_finds_the_planted_triple(sold):
    found = D.beam_search(population(sold), 4, 3, 40).orderBy("business_impact").collect()
    triple = max((r for r in found if r["ways"] == 3), key=lambda r: r["score"])
    assert triple["segment"] in ("channel=Store|product=X|region=W", "channel=Store|product=X|twin=twin of W")
    assert triple["lift"] == max(r["lift"] for r in found)


def test_beam_limits(sold):
    pop = population(sold)
    assert {r["ways"] for r in D.beam_search(pop, 5, 1, 50).collect()} == {1}
    assert D.beam_search(pop, 100, 3, 100, minimum_support=10_000).count() == 0
    assert max(r["ways"] for r in D.beam_search(pop, 100, 3, 100, minimum_gain=1e9).collect()) == 2
    assert D.beam_search(population(sold.limit(0)), 5, 2, 5).count() == 0
    many = D.beam_search(pop, 130, 2, 300)  # more paths than one mask holds
    assert many.count() == len(exhaustive(sales(1, 3000), 2, pop.minimum_support))
    with pytest.raises(ValueError):
        D.beam_search(pop, 0)


@pytest.mark.parametrize("aggregation", ["sum", "average"])
def test_left_out_scores_are_those_of_the_other_rows(spark, sold, aggregation):
    pop = population(sold, aggregation=aggregation)
    loo = {(r["_period"], r["dimension"]): r for r in D.leave_one_out_scores(pop, "quarter").collect()}
    out = dt.date(2024, 4, 1)
    part = population(sold.filter("day IS NULL OR quarter(day) <> 2"), aggregation=aggregation)
    part.__dict__["scale"] = pop.scale  # the scale of the whole cohort
    from variscope.operators.attribution import group_dimension

    for period, p in ((None, pop), (out, part)):
        want = {r["dimension"]: r["score"] for r in score_dimensions(group_dimension(p), p).collect()}
        assert {d: r["score"] for (x, d), r in loo.items() if x == period} == {d: pytest.approx(s, rel=1e-9) for d, s in want.items()}
    assert {x for x, _ in loo} == {None, *(dt.date(2024, m, 1) for m in (1, 4, 7, 10))}


def test_stability_of_a_cohort_without_dates(sold):
    rows = D.stability(population(sold.filter("day IS NULL"))).collect()
    assert rows and all(r["periods"] == 0 and r["stability"] is None for r in rows)
    with pytest.raises(ValueError):
        D.stability(Investigation(sold, CohortSpec(DIMS, "actual", "target")).population)


def test_redundancy_matches_plain_python(sold):
    rows = [["(missing)" if v is None else v for v in r[1:6]] for r in sales(1, 3000)]

    def entropy(*columns):
        seen: dict = {}
        for r in rows:
            seen[tuple(r[c] for c in columns)] = seen.get(tuple(r[c] for c in columns), 0) + 1
        return -sum(c / len(rows) * math.log(c / len(rows)) for c in seen.values())

    got = {(r["first"], r["second"]): r for r in D.redundancy(population(sold)).collect()}
    assert len(got) == 10
    for i, j in itertools.combinations(range(5), 2):
        r, mi = got[DIMS[i], DIMS[j]], entropy(i) + entropy(j) - entropy(i, j)
        assert r["mutual_information"] == pytest.approx(mi, abs=1e-9)
    assert got["region", "twin"]["nmi"] == pytest.approx(1.0) and got["region", "single"]["nmi"] == 0.0 and got["region", "single"]["determines"] == 0.0


def test_redundancy_scans_the_fact_once(spark):
    pop = Investigation(fact(spark, "/root/testdata/sf0.001"), CohortSpec(tuple(DIMENSIONS), "actual", "target")).population
    found = D.redundancy(pop)
    assert found.count() == 45
    assert found._jdf.queryExecution().withCachedData().collectLeaves().size() == 1
    pop.release()


def test_landscape_lowers_redundant_dimensions(sold):
    pop = population(sold)
    inv = Investigation(sold, pop.spec)
    rows = {r["dimension"]: r for r in D.landscape(inv.contributions, inv.scores, D.stability(pop), D.redundancy(pop)).collect()}
    assert sorted(r["rank"] for r in rows.values()) == list(range(1, len(rows) + 1))
    pair = sorted((rows["region"], rows["twin"]), key=lambda r: r["rank"])
    assert pair[1]["redundancy"] == pytest.approx(1.0) and pair[1]["combined_score"] == pytest.approx(pair[0]["combined_score"] / 2, rel=0.5)
    assert all(r["unfavorable_impact"] <= 0 <= r["favorable_offset"] for r in rows.values())
    inv.release()


# Events on predicate sets


def daily_rows():
    rows = []
    for i in range(60):
        d, after = dt.date(2025, 1, 1) + dt.timedelta(days=i), i >= 30
        noise = (i % 3 - 1) * 2.0
        rows += [(d, "Affected", " a ", 100.0 + noise - (20.0 if after else 0.0), 100.0), (d, "Control", "a", 100.0 + noise, 100.0), (d, "Control", None, 50.0, 50.0)]
    return rows


@pytest.fixture(scope="module")
def dated(spark):
    return spark.createDataFrame(daily_rows(), "period_date date, region string, kind string, actual double, target double")


def test_cohorts_of_predicates_overlap(dated):
    day = dt.date(2025, 1, 31)
    affected, a = (("region", "Affected"),), (("kind", "a"),)
    events = [
        E.CohortEvent("did", day, affected, (("region", "Control"),), "unfavorable", 30, 29),
        E.CohortEvent("overlap", day, affected, a, None, 10, 7),
        E.CohortEvent("alone", day, (("region", "Control"), ("kind", "(missing)"))),
        E.CohortEvent("everything", day, (), affected),
        E.CohortEvent("sparse", dt.date(2025, 1, 3), affected, None, None, 1, 1),
        E.CohortEvent("nobody", day, (("region", "None"),), affected),
    ]
    got = {r["event_id"]: r for r in E.cohort_event_study(dated, "period_date", "actual", "target", events).collect()}
    did = got["did"]
    assert did["method"] == "difference_in_differences" and did["raw_effect"] == pytest.approx(-20.0) and did["impact_direction"] == "unfavorable"
    assert did["status"] == "supported" and did["affected_summary"]["pre_periods"] == 30 and did["control_summary"]["post_periods"] == 30 and did["shared_rows"] == 0
    assert did["affected_summary"]["pre_actual"] == pytest.approx(100.0) and did["affected_summary"]["post_actual"] == pytest.approx(80.0, abs=0.2)
    # The control holds the affected rows too, so it moves as far.
    assert got["overlap"]["raw_effect"] == pytest.approx(0.0, abs=1.0) and got["overlap"]["shared_rows"] == 18 and got["overlap"]["pre_periods"] == 10
    assert got["alone"]["method"] == "pre_post" and got["alone"]["shared_rows"] is None and list(got["alone"]["diagnostics"]) == ["no_control"]
    assert got["everything"]["shared_rows"] == 60 and got["everything"]["control_summary"]["residual_change"] == pytest.approx(-20.0, abs=0.2)
    assert (got["sparse"]["status"], got["sparse"]["confidence"]) == ("insufficient", "low") and "too_few_periods" in got["sparse"]["diagnostics"]
    assert got["nobody"]["status"] == "insufficient" and got["nobody"]["pre_periods"] == 0


def test_many_cohorts_of_one_scan_match_one_by_one(spark, dated):
    rng = random.Random(4)
    pool = [("region", "Affected"), ("region", "Control"), ("kind", "a"), ("kind", "(missing)")]
    events = []
    for i in range(70):  # more cohorts than one mask holds
        sets = [tuple(rng.sample(pool, rng.randint(0, 2))) for _ in range(2)]
        events.append(E.CohortEvent(f"e{i}", dt.date(2025, 1, 20) + dt.timedelta(days=rng.randint(0, 20)), sets[0] + (("actual", str(i)),) * (i % 9 == 0), sets[1] if i % 4 else None, "favorable", rng.randint(3, 25), 12))
    together = {r["event_id"]: r for r in E.cohort_event_study(dated, "period_date", "actual", None, events).collect()}
    assert len(together) == 70
    for e in events[::23]:
        assert E.cohort_event_study(dated, "period_date", "actual", None, [e]).first() == together[e.event_id]


def test_cohort_studies_without_events_or_rows(dated):
    assert E.cohort_event_study(dated, "period_date", "actual", "target", []).count() == 0
    row = E.cohort_event_study(dated.limit(0), "period_date", "actual", "target", [E.CohortEvent("x", dt.date(2025, 1, 1), ())]).first()
    assert row["status"] == "insufficient" and row["raw_effect"] == 0.0
    with pytest.raises(ValueError):
        E.cohort_event_study(dated, "period_date", "actual", "target", [E.CohortEvent("x", dt.date(2025, 1, 1), ())] * 2)


def test_cohort_days_reach_the_scan(spark):
    df = fact(spark, "/root/testdata/sf0.001", ["period_date", "actual", "target", "region", "segment"])
    masks = E.cohort_masks(df, "period_date", "actual", "target", [(("region", "ASIA"),), (("segment", "BUILDING"),)], dt.date(1995, 1, 1), dt.date(1995, 3, 1))
    plan = masks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem") <= 1 and "GreaterThanOrEqual(l_shipdate" in plan
