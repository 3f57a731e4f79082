from __future__ import annotations

import datetime as dt
import hashlib
import json
import re
import time

import pytest
from pyspark.sql import functions as F

from variscope.operators import quality as Q
from variscope.operators import semantics as M
from variscope.operators.cohort import CohortSpec
from variscope.plans.investigation import Investigation
from variscope.session import DROP_SHUFFLES
from variscope.sources import files as R
from variscope.sources import sinks as K
from variscope.sources.coerce import coerce_values, coerced, coercion_report
from variscope.sources.warehouse import fact

OPTIONS = Q.QualityOptions(dt.date(2026, 1, 1), required=("actual", "gone"), keys=("id",), freshness_days=10)


def test_sparse_records_are_ragged(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"actual": 1, "region": "W"}\n{"actual": 2, "region": "E", "optionalField": "x"}\n')
    df = R.read_json(spark, str(path), lines=True)
    assert "optionalField" in df.columns
    assert Q.missing_cells(df).first()["ragged_rows"] == 1


def test_duplicates_treat_missing_as_equal(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, ""), (2.0, "x")], "actual double, region string")
    assert Q.duplicate_rows(df).first()["duplicate_rows"] == 1


def test_email_columns_are_sensitive(spark):
    df = spark.createDataFrame([(1.0, "a@b.co", "W"), (2.0, "c@d.co", "E")], "actual double, customerEmail string, region string")
    got = {r["column"]: r for r in Q.sensitive_scan(Q.Profiler(df, OPTIONS)).collect()}
    assert got["customerEmail"]["sensitive_reasons"] == "name,email" and not got["region"]["potential_sensitive"]


def messy(spark):
    rows = [
        (i, "West" if i % 3 else " west ", str(100 + i) if i % 10 else "n/a", "2025-12-01" if i % 2 else "2025-12-2x", None if i % 4 else "c")
        for i in range(60)
    ]
    return spark.createDataFrame(rows, "id long, market string, actual string, day string, note string")


def test_profile_of_messy_rows(spark):
    p = Q.Profiler(messy(spark), OPTIONS)
    got = {r["column"]: r for r in p.profile.collect()}
    assert got["id"]["analysis_role"] == "identifier"
    assert got["market"]["collision_rows"] == 60 and got["market"]["whitespace_count"] == 20
    assert got["actual"]["type_consistency"] == pytest.approx(0.9) and got["actual"]["inferred_kind"] == "categorical"
    assert got["note"]["null_rate"] == 0.75 and got["note"]["constant"]
    assert got["day"]["has_dates"] and got["day"]["invalid_dates"] == 30
    issues = {(r["column"], r["title"], r["severity"]) for r in Q.quality_issues(p).collect()}
    assert ("note", "High missingness", "critical") in issues
    assert ("gone", "Required column missing", "critical") in issues
    assert ("day", "Invalid date values", "critical") in issues
    assert (None, "Freshness SLA missed", "critical") in issues
    assert ("actual", "Mixed runtime types", "warning") in issues
    scores = {r["dimension"]: r for r in Q.quality_dimensions(p).collect()}
    assert len(scores) == 13 and scores["accuracy"]["status"] == "not-configured" and not scores["overall"]["analysis_ready"]
    assert scores["timeliness"]["score"] == pytest.approx(100 * (1 - 21 / 30))
    p.release()


def test_functional_dependency_and_correlation(spark):
    rows = [(f"c{i % 6}", f"r{i % 6 // 2}", "k" if i % 2 else None, float(i), i * 2.0, float(i * i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "city string, region string, flag string, a double, b double, c double")
    got = {(r["determinant"], r["dependent"]): r for r in Q.functional_dependencies(df, ["city", "region", "flag"]).collect()}
    assert got[("city", "region")]["confidence"] == 1.0 and ("region", "city") not in got
    assert got[("city", "flag")]["rows"] == 30
    pairs = {(r["left"], r["right"]) for r in Q.correlations(df, ["a", "b", "c"]).collect()}
    assert pairs == {("a", "b")}


@pytest.mark.parametrize(
    ("text", "number", "boolean"),
    [
        ("$1,234.50", 1234.5, None), ("(€200)", -200.0, None), ("12.5%", 0.125, None), ("-5", -5.0, None), ("TRUE", None, True),
        ("false", None, False), ("007", None, None), ("1234567890123456", None, None), ("abc", None, None), ("", None, None), (" 3 ", 3.0, None),
        ("1.2.3", None, None),
    ],
)
def test_coercion(spark, text, number, boolean):
    row = coerce_values(spark.createDataFrame([(text,)], "v string")).first()
    assert (row["v_number"], row["v_boolean"]) == (number, boolean)


def test_coercion_report(spark):
    df = spark.createDataFrame([("1", "x"), ("true", None), ("a", "")], "p string, q string")
    got = {r["column"]: r for r in coercion_report(df).collect()}
    assert (got["p"]["number_cells"], got["p"]["boolean_cells"], got["p"]["string_cells"]) == (1, 1, 1)
    assert got["q"]["missing_cells"] == 2


def test_csv_headers_blank_lines_and_broken_lines(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("﻿ a , b\n1,x\n\n , \n2,\"y, z\"\n3\n")
    df = R.read_csv(spark, str(path))
    assert df.columns[:2] == ["a", "b"] and df.count() == 3
    assert [r["b"] for r in df.orderBy("a").collect()][:2] == ["x", "y, z"]
    assert R.csv_errors(df.cache()).count() == 1
    with pytest.raises(ValueError, match="malformed"):
        R.ingest_table(spark, str(path), "csv")
    (tmp_path / "b.csv").write_text("a,a\n1,2\n")
    with pytest.raises(ValueError, match="duplicate header"):
        R.read_csv(spark, str(tmp_path / "b.csv"))


def test_json_documents_and_flattening(spark, tmp_path):
    record = {"a": 1, "b": {"c": {"d": {"e": 2}, "f": "x"}}, "g": [1, 2]}
    (tmp_path / "list.json").write_text(json.dumps([record]))
    (tmp_path / "data.json").write_text(json.dumps({"data": [record, record]}))
    df = R.read_json(spark, str(tmp_path / "list.json"))
    flat = R.flatten_records(df)
    assert flat.columns == ["a", "b.c.d", "b.c.f", "g"]
    assert list(flat.first()) == [1, '{"e":2}', "x", "[1,2]"]
    assert R.read_json(spark, str(tmp_path / "data.json")).count() == 2


def test_wide_contract(spark, tmp_path):
    (tmp_path / "w.csv").write_text("period_date,actual_value,plan_value,metric_name,dim_region,dim_product\n2026-01-31,120,100,Revenue,West,Phone\n")
    row = R.ingest_table(spark, str(tmp_path / "w.csv"), "csv").first()
    assert (row["actual"], row["target"], row["region"], row["product"]) == (120.0, 100.0, "West", "Phone")
    (tmp_path / "x.csv").write_text("period_date,actual_value,metric_name\n2026-01-31,1,A\n2026-01-31,2,B\n")
    with pytest.raises(ValueError, match="several_metrics"):
        R.ingest_table(spark, str(tmp_path / "x.csv"), "csv")


def test_long_contract(spark):
    rows = [("2026-01-31", s, v, "Revenue", "West") for s, v in (("actual", 120.0), ("Plan", 100.0), ("Outlook", 110.0))]
    df = spark.createDataFrame(rows, "period_date string, scenario string, value double, metric_name string, dim_region string")
    row = M.apply_contract(df).first()
    assert (row["actual"], row["target"], row["forecast"], row["region"]) == (120.0, 100.0, 110.0, "West")
    with pytest.raises(ValueError, match="no_actual_scenario"):
        M.apply_contract(df.filter("scenario <> 'actual'"))
    other = df.drop("scenario")
    assert M.apply_contract(other).columns == other.columns
    kept = M.normalize_long(df.withColumn("i", F.lit(1)).withColumn("currency", F.lit("EUR")), "i").first()
    assert kept["currency"] == "EUR"


def test_metric_definition(spark):
    rows = [(1, "m1", "Revenue", "Money in", "FP&A", "certified", "sum", "higher_is_better", "USD", 2, "opex"), (2, "m2", None, None, None, None, "ratio", None, None, None, None)]
    df = spark.createDataFrame(
        rows,
        "i int, metric_id string, metric_name string, metric_definition string, metric_owner string, metric_certification string,"
        "aggregation_method string, metric_polarity string, currency string, fiscal_year_start_month int, planning_lens string",
    )
    got = {r["metric_id"]: r for r in M.infer_metric_definition(df, "actual", "target", "i").collect()}
    assert got["m1"]["semantic_completeness"] == 100 and got["m1"]["attribution_supported"]
    assert not got["m2"]["attribution_supported"] and got["m2"]["semantic_completeness"] == 17
    table = df.withColumns({"actual": F.lit(1.0), "target": F.lit(1.0), "forecast": F.lit(1.0)})
    defaults = {r["metric_id"]: r for r in M.infer_defaults(table, ["actual", "target", "forecast"], "i").collect()}
    assert (defaults["m1"]["planning_lens"], defaults["m1"]["fiscal_year_start_month"], defaults["m1"]["expected_key"]) == ("opex", 2, "target")


def test_lens_from_the_metric_name(spark):
    df = spark.createDataFrame([(1, "m", "Average headcount", "Ending Balance")], "i int, metric_id string, metric_name string, aggregation_method string")
    row = M.infer_defaults(df, ["headcount"], "i").first()
    assert (row["planning_lens"], row["aggregation"], row["actual_key"]) == ("workforce", "period_end", "headcount")


def test_snapshot_round_trip_and_audit(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    K.write_snapshot({"scope": df}, {"metric_id": "m"}, str(tmp_path / "s"), "run-1")
    K.write_snapshot({"scope": df}, {"metric_id": "m"}, str(tmp_path / "s"), "run-2")
    assert K.read_snapshot(spark, str(tmp_path / "s"), "scope", "run-1").count() == 1
    assert spark.read.json(str(tmp_path / "s/manifest")).count() == 2
    good = ("s1", K.SCHEMA_VERSION, "d", "h", "m", "r", "l", "r")
    bad = ("s2", "v0", None, "h", "", "r", "l", "other")
    headers = spark.createDataFrame([good, bad], "snapshot_id string, schema_version string, session_id string, content_hash string, metric_id string, run_id string, ledger_id string, ledger_run_id string")
    items = spark.createDataFrame([("s1", "e1"), ("s1", "e2")], "snapshot_id string, evidence_id string")
    errors = {(r["snapshot_id"], r["error"]) for r in K.validate_snapshot(headers, items, items.filter("evidence_id = 'e1'")).collect()}
    assert errors == {
        ("s1", "evidence_not_allowed"), ("s2", "unsupported_schema"), ("s2", "dataset_identity_missing"), ("s2", "metric_missing"), ("s2", "run_mismatch"),
    }


def test_fingerprint_ignores_order_and_sees_copies(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    h = lambda d: R.content_fingerprint(d).first()["content_hash"]
    assert h(df) == h(df.orderBy(F.desc("x")).select("y", "x"))
    assert h(df) != h(df.unionAll(df)) and h(df) != h(df.unionAll(df.filter("x = 1")))


FREE_DATES = {
    "January 5, 2024": "2024-01-05 00:00", "5 Jan 2024": "2024-01-05 00:00", "Jan 2024": "2024-01-01 00:00", "2024/01/05 10:00": "2024-01-05 10:00",
    "jan 5 2024": "2024-01-05 00:00", "5-JAN-2024": "2024-01-05 00:00", "Fri, 5 Jan 2024 22:15:30 GMT": "2024-01-05 22:15", "Friday January 5, 2024": "2024-01-05 00:00",
    "Sept. 9, 2023 3:07 pm": "2023-09-09 15:07", "12/31/1999 11:59:59 PM": "1999-12-31 23:59", "1-2-2024": "2024-01-02 00:00", "2024/1/5 7:05:09": "2024-01-05 07:05",
    "  5   Jan, 2024 ": "2024-01-05 00:00", "May 2024": "2024-05-01 00:00", "2024-03-04T05:06:07Z": "2024-03-04 05:06", "3/7/2024": "2024-03-07 00:00", "Mar 7, 2024": "2024-03-07 00:00",
}
NO_DATES = ["", "Jan", "January", "5 Foo 2024", "32 Jan 2024", "Jan 5, 20245", "13/45/2024", "5/2024/1", "Jan 5, 1492", "2024/01/05 25:00", "hello 2024", "12:30", "Jan 5"]


def test_free_form_dates_by_their_shape(spark):
    from variscope.functions.timeparse import parse_time_value

    df = spark.createDataFrame([(t,) for t in [*FREE_DATES, *NO_DATES, None]], "t string")
    got = {r["t"]: r["d"] for r in df.select("t", F.date_format(parse_time_value(df, "t")["ts"], "yyyy-MM-dd HH:mm").alias("d")).collect()}
    assert {t: got[t] for t in FREE_DATES} == FREE_DATES
    assert [t for t in [*NO_DATES, None] if got[t] is not None] == []


def test_fingerprints_of_parts_merge(spark):
    rows = [(i % 3, i % 7, None if i % 5 == 0 else f"t{i % 4}", i / 4) for i in range(200)]
    df = spark.createDataFrame(rows, "part int, x int, y string, z double")
    whole = R.content_fingerprint(df.drop("part")).first()
    merged = R.merge_fingerprints(R.fingerprint_parts(df, ["part"]), ["x", "y", "z"]).first()
    assert merged == whole
    h = [int(hashlib.md5("\x1f".join(["x=" + str(x), "y=" + ("\x00" if y is None else y), "z=" + repr(z)]).encode()).hexdigest()[:15], 16) for _, x, y, z in rows]
    xor = 0
    for v in h:
        xor ^= v
    assert whole["row_count"] == 200 and whole["digest"] == f"{sum(h)}-{xor}"
    assert R.content_fingerprint(df.limit(0)).first()["digest"] == "0-0"
    other = R.content_fingerprint(df.drop("part").withColumn("x", F.when(F.col("z") == 3.0, 99).otherwise(F.col("x")))).first()
    assert other["content_hash"] != whole["content_hash"]


def test_stored_snapshots_are_audited(spark, tmp_path):
    folder = str(tmp_path / "s")
    data = spark.createDataFrame([(i, i * 2.0) for i in range(20)], "k int, v double")
    ledger = spark.createDataFrame([("e1", "run-1"), ("e2", "run-1")], "evidence_id string, run_id string")
    save = lambda run, led: K.save_investigation(data, {"scope": data, "none": data.limit(0)}, led, folder, run, "m", {"grain": "month"}, [("region", "A")])
    first, second = save("run-1", ledger), save("run-2", ledger.withColumn("run_id", F.lit("run-2")))
    assert first != second and K.audit_snapshots(spark, folder, {"run-1": data, "run-2": data.orderBy(F.desc("k"))}).count() == 0
    row = spark.read.json(f"{folder}/manifest").filter("run_id = 'run-1'").first()
    assert row["ledger_run_id"] == "run-1" and row["configuration"] == '{"grain": "month"}' and row["predicates"] == '[["region", "A"]]' and len(row["content_hash"]) == 64
    # One changed row, one lost table row, one piece of evidence that nobody allowed, another run's ledger.
    K.write_run(data.withColumn("v", F.when(F.col("k") == 7, -1.0).otherwise(F.col("v"))), f"{folder}/scope", "run-1")
    K.write_run(spark.createDataFrame([("e1", "run-2"), ("e9", "run-2")], "evidence_id string, ledger_run_id string"), f"{folder}/ledger", "run-2")
    third = save("run-3", ledger)
    K.write_run(data.filter("k > 0"), f"{folder}/scope", "run-3")
    errors = {tuple(r) for r in K.audit_snapshots(spark, folder, {"run-2": data.filter("k <> 3")}).collect()}
    assert errors == {
        (first, "content_mismatch", "scope"), (second, "content_mismatch", "ledger"), (second, "evidence_not_allowed", "e9"), (second, "dataset_changed", "run-2"),
        (third, "run_mismatch", None), (third, "content_mismatch", "scope"),
    }
    with pytest.raises(ValueError):
        K.save_investigation(data, {"ledger": data}, ledger, folder, "run-4", "m", {})


def test_evidence_rows_are_redacted(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(600)], "i int, phone string")
    got = R.evidence_rows(df, ["phone"], ["i"], 500).collect()
    assert len(got) == 500 and {r["phone"] for r in got} == {"[redacted]"}


def test_nested_records_reach_the_investigation(spark, tmp_path):
    path = tmp_path / "nested.jsonl"
    rows = [
        {"who": {"region": "West" if i % 2 else "East", "tier": {"name": "ab"[i % 3 == 0]}}, "money": {"actual": f"${80 + i % 2 * 30 + i % 3}", "target": 100}}
        for i in range(90)
    ]
    path.write_text("\n".join(json.dumps(r) for r in rows))
    df = R.ingest_table(spark, str(path), "jsonl")
    assert sorted(df.columns) == ["money.actual", "money.target", "who.region", "who.tier.name"]
    assert dict(df.dtypes)["money.actual"] == "double"
    spec = CohortSpec(("who.region", "who.tier.name"), "money.actual", "money.target", predicates=())
    inv = Investigation(df, spec)
    assert inv.best_dimensions[0] == "who.region" and inv.scope.first()["valid_row_count"] == 90
    assert {r["segment"] for r in inv.interactions.collect()} >= {"who.region=East|who.tier.name=a"}
    assert inv.drill([("who.region", "West")]).scope.first()["row_count"] == 45
    p = Q.Profiler(df, OPTIONS)
    roles = {r["column"]: r["analysis_role"] for r in p.profile.collect()}
    assert roles["who.region"] == "dimension" and roles["money.actual"] == "measure"
    assert Q.duplicate_rows(df).first()["row_count"] == 90
    assert Q.missing_patterns(df).count() == 0
    assert Q.functional_dependencies(df, ["who.region", "who.tier.name"]).count() == 0
    assert [r["field"] for r in Q.detect_time_fields(df).collect()] == []
    assert R.content_fingerprint(df).first()["row_count"] == 90


def test_counts_and_ingested_rows_are_stored_once(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "name string, n int")
    assert Q.Profiler(df, Q.QualityOptions(as_of=dt.date(2024, 1, 1))).frequencies.inputFiles()
    path = str(tmp_path / "csv")
    spark.sql("SELECT '2024-01-01' AS period_date, '1' AS actual_value, '$2' AS plan_value, 'x' AS dim_Region").write.option("header", True).csv(path)
    got = R.ingest_table(spark, path, "csv")
    assert all(f.endswith(".parquet") for f in got.inputFiles()) and got.select("actual", "target", "region").first()[:] == (1.0, 2.0, "x")


def test_typing_is_compiled_and_matches_each_cell_once(spark, tmp_path, capsys):
    lines = [f"2024-01-0{i},{i}00.5,$1{i}.25,x" + ",7%" * 14 for i in range(1, 10)]
    (tmp_path / "a.csv").write_text("\n".join(["period_date,actual_value,plan_value,dim_Region," + ",".join(f"v{i}" for i in range(14)), *lines]))
    typed = R.typed_table(R.read_csv(spark, str(tmp_path / "a.csv")).drop(R.BAD_RECORD))
    typed.explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000  # the virtual machine interprets longer methods
    assert [r["plan_value"] for r in typed.orderBy("period_date").collect()] == [10.25 + i for i in range(1, 10)]


def test_numbers_by_one_pattern(spark):
    numbers = {
        "7": 7.0, " 7\t": 7.0, "-.5": -0.5, "5.": 5.0, "$ 1,234.50": 1234.5, "(1,234.5)": -1234.5, "(-5)": -5.0, "(5%)": -0.05, "12.5%": 0.125,
        "+€3": 3.0, "1" * 15: float("1" * 15), "(0123)": -123.0, "0": 0.0, "0.5": 0.5, ",5": 5.0, "$" + "9" * 305: float("9" * 305),
    }
    others = ["0123", "-007", "1" * 16, "1.2.3", "..5", "-", ",.", "%", "$", "1e5", "NaN", "5 $", "--5", "2024-01-01", "12\x85", "$" + "9" * 310, "yes"]
    cells = [(c, "number", v) for c, v in numbers.items()] + [(c, "string", None) for c in others] + [("True", "boolean", None), ("", "missing", None), (None, "missing", None)]
    df = spark.createDataFrame(cells, "v string, kind string, expected double")
    assert [(r["v_number"], r["v_boolean"]) for r in coerce_values(df, ["v"]).collect()] == [(v, True if k == "boolean" else None) for _, k, v in cells]
    report = coercion_report(df, ["v"]).first()
    assert [report[f"{k}_cells"] for k in ("missing", "number", "boolean", "string")] == [2, len(numbers), 1, len(others)]
    one = df.select(coerced(df, "v").alias("c")).select("c.kind", "c.number").collect()
    assert [tuple(r) for r in one] == [(k, v) for _, k, v in cells]


def test_mixed_booleans_and_empty_columns_are_typed(spark):
    rows = [("true", None, f"{i}%") for i in range(39)] + [("maybe", " ", "n/a")]
    df = R.typed_table(spark.createDataFrame(rows, "flag string, none string, `a.share` string"))
    assert dict(df.dtypes) == {"flag": "boolean", "none": "string", "a.share": "double", "flag_text": "string", "a.share_text": "string"}
    assert df.filter("flag").count() == 39 and df.filter("none is not null").count() == 0
    assert [tuple(r) for r in df.filter("flag is null").collect()] == [(None, None, None, "maybe", "n/a")]
    empty = R.typed_table(df.select("flag_text").limit(0))
    assert empty.dtypes == [("flag_text", "string")] and empty.count() == 0


def test_copies_travel_as_hashes(spark):
    """However wide a row is, 128 bits of it are shuffled; missing cells of different columns differ."""
    rows = [("x", None, 1.0), (None, "x", 1.0), ("x", " ", 1.0), ("x", None, float("nan")), ("x", "", float("nan")), (None, None, 0.0), ("", " ", -0.0), ("x" * 500, "x", 1.0)]
    df = spark.createDataFrame(rows, "a string, b string, c double")
    found = Q.duplicate_rows(df)
    assert found.first()[:2] == (8, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"hashpartitioning\(([^)]*), \d+\)", plan)[0].count("#") == 2 and "hashpartitioning(_h0#" in plan
    mapped = df.withColumn("m", F.create_map(F.lit("k"), "c"))
    assert Q.duplicate_rows(mapped).first()["duplicate_rows"] == 3


def test_counted_values_are_read_as_they_were_typed(spark):
    """What a number or a text makes plain is not stored beside it."""
    texts = [" A  b ", "a B", "1,200", "1200", "0123", "TRUE", " ", None, "2024-01-05", "(5%)"]
    df = spark.createDataFrame([(t, n) for t, n in zip(texts, [1.0, 1.0, 2.5, -0.0, 0.0, float("nan"), None, 1e20, 3.0, 3.0])], "t string, n double")
    p = Q.Profiler(df.withColumn("none", F.lit(None)), OPTIONS)
    got = sorted((tuple(r) for r in p.frequencies.select("column", "kind", "text", "number", "count", "value_number", F.col("value_date").cast("string"), "blank_edge", "norm").collect()), key=str)
    number = lambda c, t, v, n: (c, "number", t, v, n, v, None, None, None)
    text = lambda t, norm, edge, v=None, d=None: ("t", "string", t, None, 1, v, d, edge, norm)
    none = (None,) * 4
    expected = [
        text(" A  b ", "a b", True), text("a B", "a b", False), number("t", "1200", 1200.0, 2), text("0123", "0123", False, 123.0),
        ("t", "boolean", "true", None, 1, *none), ("t", "missing", None, None, 2, *none), text("2024-01-05", "2024-01-05", False, None, "2024-01-05"),
        number("t", "-0.05", -0.05, 1), number("n", "1", 1.0, 2), number("n", "2.5", 2.5, 1), number("n", "0", 0.0, 2), number("n", "3", 3.0, 2),
        number("n", "1.0E20", 1e20, 1), ("none", "missing", None, None, 10, *none),
    ]
    missing = [x for x in got if x[0] == "n" and x[1] == "missing"]
    assert sum(x[4] for x in missing) == 2 and sorted((x for x in got if x not in missing), key=str) == sorted(expected, key=str)
    assert "number" not in p._counts.columns and "norm" not in p._counts.columns
    assert p._counts.filter("kind = 'number' AND text IS NOT NULL").count() == 0


def test_scores_read_the_rows_once_and_drop_the_shuffles(spark):
    """The rows behind scores are stored; the shuffles that made them go when they are written."""
    files = lambda: [str(f) for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if "shuffle_" in str(f)]
    before = set(files())
    df = spark.range(500).repartition(7, "id").select("id", (F.col("id") % 5).cast("string").alias("group"))
    p = Q.Profiler(df, OPTIONS)
    assert p.rows.inputFiles() and sorted(p.rows.dtypes) == sorted(df.dtypes)
    for _ in range(50):
        if not set(files()) - before:
            break
        time.sleep(0.2)
    assert not set(files()) - before
    assert spark.conf.get(DROP_SHUFFLES) == "false" and p.rows.count() == 500
    scores = {r["dimension"]: r["score"] for r in Q.quality_dimensions(p).collect()}
    assert scores["uniqueness"] == 100 and scores["completeness"] == 100
    assert "repartition" not in p.summary._jdf.queryExecution().analyzed().toString().lower()


def test_lines_move_for_parts_and_orders_only(spark, tmp_path):
    """What hangs on an order is joined to the orders; keys that repeat, are null or meet nothing keep their rows."""
    day = dt.datetime(2024, 1, 5)
    tables = {
        "lineitem": ([(1, 1, 1, 2.0, 10.0, 0.1, "R", "F", day), (1, 2, 9, 1.0, 20.0, 0.0, "A", "O", day), (2, 9, 1, 1.0, 30.0, 0.0, "A", "O", day), (None, None, None, 1.0, 40.0, 0.0, "N", "O", day), (7, 1, 1, 1.0, 50.0, 0.0, "N", "O", day)], "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
        "orders": ([(1, 5, "P", "1-URGENT", day), (1, 6, "F", "2-HIGH", day), (2, None, "O", "3-MEDIUM", day), (None, 5, "O", "5-LOW", day)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate timestamp"),
        "customer": ([(5, 3, "AUTO"), (5, 4, "HOME"), (6, None, "TOYS")], "c_custkey long, c_nationkey long, c_mktsegment string"),
        "nation": ([(3, "PERU", 1), (4, "CHAD", 2)], "n_nationkey long, n_name string, n_regionkey long"),
        "region": ([(1, "AMERICA")], "r_regionkey long, r_name string"),
        "part": ([(1, "B1", "T1"), (2, "B2", None)], "p_partkey long, p_brand string, p_type string"),
        "supplier": ([(1, "S1")], "s_suppkey long, s_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = fact(spark, str(tmp_path), ["extended_price", "region", "nation", "segment", "priority", "brand", "supplier"])
        got = sorted((tuple([float(r[0]), *r[1:]]) for r in df.collect()), key=str)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    orders = [("AMERICA", "PERU", "AUTO", "1-URGENT"), (None, "CHAD", "HOME", "1-URGENT"), (None, None, "TOYS", "2-HIGH")]
    expected = [(10.0, *o, "B1", "S1") for o in orders] + [(20.0, *o, "B2", None) for o in orders]
    expected += [(30.0, None, None, None, "3-MEDIUM", None, "S1"), (40.0, *[None] * 6), (50.0, None, None, None, None, "B1", "S1")]
    assert got == sorted(expected, key=str)
    assert plan.index("hashpartitioning(l_orderkey") < plan.index("hashpartitioning(o_custkey")
