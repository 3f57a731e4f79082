"""Cases in which cells, rows or patterns were once lost."""

from __future__ import annotations

import pytest

from variscope.operators import articles as T
from variscope.operators import hierarchy as H
from variscope.operators import quality as Q
from variscope.operators.attribution import Population
from variscope.operators.cohort import CohortSpec, drill, search_preview
from variscope.sources.files import evidence_rows, ingest_table, read_csv, read_json, rejected_cells, typed_table


def test_mixed_columns_keep_their_text(spark):
    rows = [(f"{10000 + i}", f"{i}.5") for i in range(97)] + [("00042", "N/A"), ("00043", "pending"), ("00044", "7")]
    df = typed_table(spark.createDataFrame(rows, "code string, amount string"))
    assert dict(df.dtypes)["code"] == dict(df.dtypes)["amount"] == "double"
    assert {r[0] for r in df.select("code_text").collect()} == {None, "00042", "00043", "00044"}
    assert {r[0] for r in df.select("amount_text").collect()} == {None, "N/A", "pending"}
    assert {tuple(r) for r in rejected_cells(df).collect()} == {("code", 3), ("amount", 2)}


def test_metadata_of_a_long_file_is_kept(spark, tmp_path):
    lines = ["period_date,metric_id,scenario,value,metric_polarity,aggregation_method"]
    lines += [f"2024-0{m}-01,cost,{s},{m * 10 + len(s)},lower_is_better,average" for m in range(1, 5) for s in ("actual", "plan")]
    (tmp_path / "long.csv").write_text("\n".join(lines))
    rows = ingest_table(spark, str(tmp_path / "long.csv"), "csv").collect()
    assert len(rows) == 4 and {(r["metric_polarity"], r["aggregation_method"]) for r in rows} == {("lower_is_better", "average")}


def test_files_of_a_folder_need_one_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("x,y\n3,4\n")
    assert {(r["x"], r["y"]) for r in read_csv(spark, str(tmp_path)).collect()} == {("1", "2"), ("3", "4")}
    (tmp_path / "c.csv").write_text("y,x\n5,6\n")
    with pytest.raises(Exception, match="header"):
        read_csv(spark, str(tmp_path)).collect()


def test_broken_json_lines_raise(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1}\n{"a": 2, "b": 3}\n')
    assert read_json(spark, str(path), lines=True).count() == 2
    path.write_text('{"a": 1}\n{"a": 2,\n')
    with pytest.raises(ValueError, match="malformed"):
        read_json(spark, str(path), lines=True)


def test_union_puts_the_active_search_first(spark):
    schema = "row_idx int, title string, url string"
    active = spark.createDataFrame([(5, "t", "u1"), (6, "t", "u2")], schema)
    passive = spark.createDataFrame([(1, "t", "u1"), (5, "t", "u9")], schema)
    assert [(r["row_idx"], r["url"]) for r in T.union_all(active, passive).collect()] == [(5, "u1"), (6, "u2"), (5, "u9")]
    many = spark.createDataFrame([(i, "t", f"u{i}") for i in range(60)], schema)
    assert T.union_all(many, passive).count() == 60 and T.union_all(many, passive, 40).count() == 40


def test_dates_keep_their_zone(spark):
    rows = spark.createDataFrame([("2024-01-05T08:30:00Z",), ("2024-01-05T08:30:00+02:00",), ("20240105083000",), (None,)], "d string")
    assert [r[0] for r in rows.select(T.normalize_date(rows["d"])).collect()] == ["2024-01-05 08:30:00", "2024-01-05 08:30:00+02:00", "2024-01-05", ""]


def test_paths_are_escaped_and_levels_unlimited(spark):
    df = spark.createDataFrame([("a&n=b", "c"), ("a", "b&n=c"), ("x y", "(é)")], "m string, n string")
    paths = {r["path"]: r["rows"] for r in H.hierarchy_path(df, ["m", "n"]).collect()}
    assert paths == {"m=a%26n%3Db&n=c": 1, "m=a&n=b%26n%3Dc": 1, "m=x%20y&n=(%C3%A9)": 1}
    names = [f"l{i}" for i in range(12)]
    wide = spark.createDataFrame([tuple("v" + n for n in names)], ", ".join(f"{n} string" for n in names))
    assert H.hierarchy_edges(wide, names).count() == 12


def test_small_and_broken_amounts_of_nodes(spark):
    rows = [("n", None, "0.00004", 0), ("n", None, "NaN", 1), ("n", None, "$1,000", 2), ("m", "n", "1e30", 3)]
    df = spark.createDataFrame(rows, "node_id string, parent_id string, actual string, i int")
    got = {r["node_id"]: r["actual"] for r in H.hierarchy_normalize(df, "i").collect()}
    assert got["n"] == pytest.approx(1000.00004, abs=1e-9) and got["m"] == pytest.approx(1e30)


def test_patterns_are_told_apart_by_all_columns(spark):
    names = [f"c{i:02d}" for i in range(12)]
    gone = [set(names[:10]), set(names[:9]) | {names[11]}, set()]
    rows = [tuple(None if n in g else "x" for n in names) for g in gone for _ in range(3)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    assert [r["count"] for r in Q.missing_patterns(df).collect()] == [3, 3]


def test_search_reads_every_column(spark):
    names = [f"c{i:02d}" for i in range(20)]
    df = spark.createDataFrame([tuple(["x"] * 19 + ["needle"]), tuple(["x"] * 20)], ", ".join(f"{n} string" for n in names))
    found = search_preview(df, "NEEDLE", ["c00"])
    assert found.count() == 1 and len(found.columns) == 14


def test_correlations_of_more_than_fourteen_measures(spark):
    names = [f"m{i:02d}" for i in range(18)]
    df = spark.createDataFrame([tuple(float(i * (k + 1)) for k in range(18)) for i in range(30)], ", ".join(f"{n} double" for n in names))
    assert Q.correlations(df, names, None).count() == 18 * 17 // 2 and Q.correlations(df, names).count() == 20


def test_drill_outside_the_dimensions_starts_from_the_source(spark):
    df = spark.createDataFrame([("a", "p", 1.0, 2.0), ("b", "q", 3.0, 1.0)], "region string, colour string, actual double, target double")
    spec = CohortSpec(("region",), "actual", "target")
    child = drill(spec, [("colour", "q")])
    assert not Population(df, spec).holds(child) and Population(df, spec).holds(drill(spec, [("region", "a")]))


def test_evidence_limit_is_checked(spark):
    with pytest.raises(ValueError):
        evidence_rows(spark.range(3), [], ["id"], 501)
