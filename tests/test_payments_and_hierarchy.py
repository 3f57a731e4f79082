from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from variscope.operators import concentration as P
from variscope.operators import hierarchy as H
from variscope.operators.cohort import scope_filter


def payments(spark, amounts, dims=None):
    """One row per month and category; ``amounts`` maps a category to its monthly amounts."""
    rows = []
    for category, values in amounts.items():
        for i, v in enumerate(values):
            d = dt.date(2025 + i // 12, i % 12 + 1, 28 if i % 12 == 1 else 30)
            if i == len(values) - 1:  # the last month is complete
                d = (d.replace(day=28) + dt.timedelta(days=4)).replace(day=1) - dt.timedelta(days=1)
            rows.append((float(v), d, 2025 + i // 12, i % 12 + 1, category))
    return spark.createDataFrame(rows, "dollar_amount double, transaction_date date, fiscal_year int, fiscal_month_number int, category string")


def test_spike_is_unfavorable(spark):
    df = payments(spark, {"A": [100, 98, 101, 99, 102, 100, 103, 180]})
    last = P.monthly_benchmark(P.monthly_totals(df)).orderBy(F.desc("period_start")).first()
    assert 95 < last["expected"] < 110 and last["business_impact"] < -70
    assert last["alert_severity"] in ("watch", "critical") and not last["partial_period"]


def test_open_month_is_prorated(spark):
    df = payments(spark, {"A": [90] * 6}).unionByName(
        spark.createDataFrame([(30.0, dt.date(2025, 7, 10), 2025, 7, "A")], payments(spark, {"A": [1]}).schema)
    )
    last = P.monthly_benchmark(P.monthly_totals(df)).orderBy(F.desc("period_start")).first()
    assert last["partial_period"] and last["expected"] == pytest.approx(90 * 10 / 31)


def test_matrix_reconciles_exactly(spark):
    df = payments(spark, {"A": [50, 50, 50, 130], "B": [30, 30, 30, 30], "C": [20, 20, 20, 20]})
    matrix = P.dimension_matrix(df, "category", k=2)
    assert matrix.count() == 12
    latest = {r["category"]: r for r in P.latest_contributions(matrix).collect()}
    assert latest["A"]["expected"] == pytest.approx(50.0) and latest["A"]["business_impact"] == pytest.approx(-80.0)
    row = P.reconciliation(matrix, P.monthly_benchmark(P.monthly_totals(df))).first()
    assert row["reconciles"] and row["matrix_impact"] == pytest.approx(row["scope_impact"])
    bars = P.waterfall(P.latest_contributions(matrix)).orderBy("step").collect()
    assert bars[-1]["category"] == "Net impact" and bars[-1]["end"] == pytest.approx(bars[-2]["end"])


def test_scope_cutoff_and_blocked_filter(spark):
    rows = [(1.0, dt.date(2026, 7, 28), 2027), (1.0, dt.date(2024, 8, 1), 2025), (1.0, dt.date(2024, 7, 31), 2025), (None, dt.date(2026, 7, 1), 2027)]
    df = spark.createDataFrame(rows, "amount double, d date, fy int")
    kept = scope_filter(df, "24m", "amount", "d", "fy", allowed=["fund"], where=("drop table", "x"))
    assert sorted(str(r["d"]) for r in kept.collect()) == ["2024-08-01", "2026-07-28"]
    assert scope_filter(df, "current_fy", "amount", "d", "fy").count() == 1


def test_children_keep_the_rest_as_other(spark):
    df = payments(spark, {c: [v] for c, v in zip("ABCDEFGHIJ", [100, 90, 80, 70, 60, 50, 40, 30, 20, 10])})
    got = P.hierarchy_children(df, [], "category", ["category"]).collect()
    other = [r for r in got if not r["drillable"]]
    assert len(got) == 8 and other[0]["value"] == "Other categories" and other[0]["amount"] == 60.0
    assert sum(r["share_of_parent"] for r in got) == pytest.approx(1.0)
    assert P.hierarchy_children(df, [], "category", ["category"], 9, other=False).count() == 9


def test_tree_ids_chain_and_subtrees_are_intervals(spark):
    rows = [("A", "x", "1", 5.0), ("A", "x", "2", 7.0), ("A", "y", None, 1.0), ("A", None, "1", 2.0), (None, "x", "1", 4.0), ("B", "x", "1", 3.0), ("B", "x", "1", 3.0), ("A", "y", "1", None), ("B", "", "é", 1.0)]
    df = spark.createDataFrame(rows, "a string, b string, c string, dollar_amount double")
    tree = P.hierarchy_tree(df, ["a", "b", "c"])
    got = {r["node_id"]: r for r in tree.collect()}
    paths = {}
    for r in got.values():
        path, at = [], r
        while at["parent_node_id"] is not None:
            path.insert(0, at["value"])
            assert got[at["parent_node_id"]]["level_index"] == at["level_index"] - 1
            at = got[at["parent_node_id"]]
        paths[tuple(path)] = r
    kept = [(tuple(list(x[:3])[: next((i for i, v in enumerate(x[:3]) if v is None), 3)]), x[3]) for x in rows if x[3] is not None]
    assert set(paths) == {p[:i] for p, _ in kept for i in range(len(p) + 1)} and len(got) == len(paths)
    leaves = sorted({p for p, _ in kept})
    for path, r in paths.items():
        below = [v for p, v in kept if p[: len(path)] == path]
        assert (r["amount"], r["transactions"]) == (sum(below), len(below))
        inside = [i for i, p in enumerate(leaves) if p[: len(path)] == path]
        assert (r["first_leaf"], r["end_leaf"]) == (inside[0], inside[-1] + 1) and len(inside) == r["end_leaf"] - r["first_leaf"]
        assert {x["node_id"] for x in P.subtree(tree, r["node_id"]).collect()} == {x["node_id"] for p, x in paths.items() if p[: len(path)] == path}
        if path:
            assert r["share_of_parent"] == pytest.approx(r["amount"] / paths[path[:-1]]["amount"])
    child = P.hierarchy_children(df, [("a", "A"), ("b", "x")], "c", ["a", "b", "c"]).collect()
    assert {(r["node_id"], r["parent_node_id"]) for r in child if r["drillable"]} == {(paths["A", "x", c]["node_id"], paths["A", "x"]["node_id"]) for c in "12"}
    assert P.hierarchy_tree(df.limit(0), ["a"]).count() == 0 and P.subtree(tree, "no such node").count() == 0


def chain(spark, n=10):
    rows = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(n)]
    return spark.createDataFrame(rows, "node_id string, parent_id string")


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 33])
def test_chain_depths(spark, n):
    got = {r["node_id"]: r for r in H.hierarchy_depth(chain(spark, n)).collect()}
    assert [got[f"n{i}"]["depth"] for i in range(n)] == list(range(1, n + 1))
    assert {r["root"] for r in got.values()} == {"n0"}


def test_orphans_cycles_and_self_parents(spark):
    rows = [("a", None), ("b", "gone"), ("c", "d"), ("d", "c"), ("e", "d"), ("f", "f"), ("g", "f"), ("h", "b")]
    nodes = spark.createDataFrame(rows, "node_id string, parent_id string")
    got = {r["node_id"]: r for r in H.hierarchy_depth(nodes).collect()}
    assert got["b"]["orphan"] and got["b"]["depth"] == 1 and got["h"]["depth"] == 2
    assert {k for k, r in got.items() if r["cycle"]} == {"c", "d", "e"}
    assert got["f"]["self_parent"] and got["g"]["depth"] == 2
    issues = {(r["node_id"], r["issue"]) for r in H.hierarchy_parent_check(nodes).collect()}
    assert issues == {("b", "orphan"), ("f", "self_parent")}
    totals = H.hierarchy_cycles(H.hierarchy_depth(nodes)).first()
    assert (totals["cycle_nodes"], totals["roots"], totals["valid"]) == (3, 3, False)


def test_long_chain_beside_a_cycle(spark):
    rows = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(40)] + [("x", "y"), ("y", "x")]
    got = {r["node_id"]: r for r in H.hierarchy_depth(spark.createDataFrame(rows, "node_id string, parent_id string")).collect()}
    assert got["n39"]["depth"] == 40 and got["x"]["cycle"] and not got["n39"]["cycle"]


def test_duplicate_nodes_fold_and_aliases_resolve(spark):
    df = spark.createDataFrame(
        [(0, "a", "", "Alpha", "$1,000", None), (1, "a", "z", "Other", "500", "20")],
        "i int, `Node Key` string, `Parent ID` string, Name string, Amount string, Plan string",
    )
    row = H.hierarchy_normalize(df, "i").first()
    assert (row["node_id"], row["parent_id"], row["label"], row["actual"], row["plan"], row["row_count"]) == ("a", None, "Alpha", 1500.0, 20.0, 2)
    with pytest.raises(ValueError, match="node_id"):
        H.resolve_columns(["x"])


def test_paths_stop_at_the_first_gap(spark):
    df = spark.createDataFrame([("a", "b", "c"), ("a", None, "c"), (None, "b", "c"), ("a", "NULL", "z")], "l1 string, l2 string, l3 string")
    paths = {r["path"]: r["rows"] for r in H.hierarchy_path(df, ["l1", "l2", "l3"]).collect()}
    assert paths == {"l1=a&l2=b&l3=c": 1, "l1=a": 2, "root": 1}
    edges = H.distinct_edges(H.hierarchy_edges(df, ["l1", "l2", "l3"])).collect()
    assert [(e["depth"], e["hierarchy_parent"], e["hierarchy_child"]) for e in edges] == [(1, "All data", "a"), (2, "a", "b"), (3, "b", "c")]


def test_node_insight_confidence(spark):
    df = spark.createDataFrame(
        [(90.0, 100.0, 5, 300.0), (1.0, None, 20, None), (1.0, 1.0, 1, None)],
        "amount double, expected double, transactions int, parent_amount double",
    )
    got = [(r["direction"], r["confidence"]) for r in H.node_insight(df).collect()]
    assert got == [("unfavorable", "high"), ("unknown", "medium"), ("neutral", "low")]
