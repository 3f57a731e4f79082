"""Snapshots of a run and exports, and the audit of stored snapshots."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variscope.sources.files import content_fingerprint

SCHEMA_VERSION = "investigation-snapshot-v1"


def write_snapshot(results: Mapping[str, DataFrame], manifest: Mapping[str, str], folder: str, run_id: str) -> str:
    """Write each result table below ``folder`` and, last of all, the manifest.

    A snapshot counts as complete once its manifest exists, so a job that dies half-way leaves none.
    Results are partitioned by run, one folder per table, so a run is read by partition pruning.
    """
    spark = next(iter(results.values())).sparkSession
    for name, df in results.items():
        write_run(df, f"{folder}/{name}", run_id)
    row = {"schema_version": SCHEMA_VERSION, "run_id": run_id, "tables": ",".join(sorted(results)), **manifest}
    _write_manifest(spark, row, folder)
    return f"{folder}/manifest"


def write_run(df: DataFrame, path: str, run_id: str) -> None:
    clean = df if "run_id" not in df.columns else df.drop("run_id")
    clean.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def _write_manifest(spark: SparkSession, row: Mapping[str, str], folder: str) -> None:
    """A run that is written again replaces its manifest row."""
    header = spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in row.items()])
    header.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").json(f"{folder}/manifest")


def save_investigation(
    dataset: DataFrame,
    results: Mapping[str, DataFrame],
    ledger: DataFrame,
    folder: str,
    run_id: str,
    metric_id: str,
    configuration: Mapping[str, str],
    predicates: Sequence[tuple[str, str]] = (),
    session_id: str = "session",
) -> str:
    """Write a snapshot that can be audited later and return its id.

    Next to the results goes the evidence ledger, as table ``ledger``. The manifest, written last, holds the
    identity of the data (``content_hash``, the order-free fingerprint of ``dataset``), the configuration and
    predicates, the ledger's id and run, the evidence that may be cited, and the fingerprint of each stored table.
    """
    if "ledger" in results or "manifest" in results:
        raise ValueError("ledger and manifest are tables of the snapshot itself")
    spark = dataset.sparkSession
    tables = {**results, "ledger": ledger.withColumn("ledger_run_id", F.col("run_id"))}
    prints = {}
    for name, df in tables.items():
        write_run(df, f"{folder}/{name}", run_id)
        prints[name] = content_fingerprint(read_snapshot(spark, folder, name, run_id, df.schema).drop("run_id")).first()["content_hash"]
    stored = read_snapshot(spark, folder, "ledger", run_id, tables["ledger"].schema)
    runs = stored.select(F.max("ledger_run_id").alias("r")).first()["r"]
    identity = "|".join([session_id, run_id, prints["ledger"], json.dumps(sorted(predicates))])
    snapshot_id = "snapshot-" + hashlib.sha256(identity.encode()).hexdigest()[:16]
    row = {
        "schema_version": SCHEMA_VERSION,
        "run_id": run_id,
        "snapshot_id": snapshot_id,
        "session_id": session_id,
        "content_hash": content_fingerprint(dataset).first()["content_hash"],
        "metric_id": metric_id,
        "configuration": json.dumps(dict(configuration), sort_keys=True),
        "predicates": json.dumps(sorted(predicates)),
        "ledger_id": "ledger-" + prints["ledger"][:16],
        "ledger_run_id": runs or "",
        "tables": ",".join(sorted(tables)),
        "fingerprints": json.dumps(prints, sort_keys=True),
        "schemas": json.dumps({name: df.schema.json() for name, df in tables.items()}, sort_keys=True),
    }
    # The evidence that may be cited grows with the ledger, so it is a table and no field of the manifest.
    write_run(stored.select("evidence_id").distinct(), f"{folder}/allowed_evidence", run_id)
    _write_manifest(spark, row, folder)
    return snapshot_id


def audit_snapshots(spark: SparkSession, folder: str, datasets: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Errors of the snapshots stored in a folder: snapshot_id, error and what it is about (evidence id or table).

    Manifests are checked by the rules of ``validate_snapshot``, the stored ledgers' evidence against what may
    be cited, and every stored table against its fingerprint: ``content_mismatch`` if rows were changed, added
    or lost. All runs of a table are one pass. ``datasets`` gives the present data by run: ``dataset_changed``
    says that it is no longer the data of the snapshot.
    """
    headers = spark.read.json(f"{folder}/manifest")
    own = headers.select("run_id", "snapshot_id")
    texts = "map<string, string>"
    wanted = headers.select("run_id", "snapshot_id", F.from_json("schemas", texts).alias("s"), F.explode(F.from_json("fingerprints", texts)).alias("name", "wanted"))
    wanted = wanted.select("run_id", "snapshot_id", "name", "wanted", F.try_element_at("s", F.col("name")).alias("schema"))
    kinds = [(r["name"], r["schema"]) for r in wanted.select("name", "schema").distinct().collect()]  # tables that the library writes
    read = {k: stored_table(spark, folder, k[0], T.StructType.fromJson(json.loads(k[1]))) for k in kinds}
    evidence = [df.select("run_id", "evidence_id") for (name, _), df in read.items() if name == "ledger"]
    listed = reduce(DataFrame.unionByName, evidence, spark.createDataFrame([], "run_id string, evidence_id string")).join(own, "run_id")
    allowed = stored_table(spark, folder, "allowed_evidence", T.StructType([T.StructField("evidence_id", T.StringType())])).join(own, "run_id")
    errors = validate_snapshot(headers, listed, allowed).withColumnRenamed("evidence_id", "about")
    found = spark.createDataFrame([], "run_id string, name string, schema string, content_hash string")
    nothing = spark.createDataFrame([], "name string, schema string, _empty string")
    for (name, schema), df in read.items():
        of = lambda x, *by: content_fingerprint(x, by).select(*by, F.lit(name).alias("name"), F.lit(schema).alias("schema"), "content_hash")  # noqa: B023, E731
        found = found.unionByName(of(df, "run_id"))
        nothing = nothing.unionByName(of(df.drop("run_id").limit(0)).withColumnRenamed("content_hash", "_empty"))
    both = wanted.join(found, ["run_id", "name", "schema"], "left").join(nothing, ["name", "schema"], "left")
    # A run without rows in a table has the fingerprint of no rows.
    compared = both.filter(~F.col("wanted").eqNullSafe(F.coalesce("content_hash", "_empty")))
    errors = errors.unionByName(compared.select("snapshot_id", F.lit("content_mismatch").alias("error"), F.col("name").alias("about")))
    for run, df in (datasets or {}).items():
        now = content_fingerprint(df).first()["content_hash"]
        changed = headers.filter((F.col("run_id") == run) & (F.col("content_hash") != now))
        errors = errors.unionByName(changed.select("snapshot_id", F.lit("dataset_changed").alias("error"), F.lit(run).alias("about")))
    return errors


def stored_table(spark: SparkSession, folder: str, table: str, schema: T.StructType | None = None) -> DataFrame:
    """A table of all runs; without rows there are no files that could tell its schema."""
    reader = spark.read if schema is None else spark.read.schema(T.StructType([*(f for f in schema.fields if f.name != "run_id"), T.StructField("run_id", T.StringType())]))
    return reader.parquet(f"{folder}/{table}")


def read_snapshot(spark: SparkSession, folder: str, table: str, run_id: str, schema: T.StructType | None = None) -> DataFrame:
    return stored_table(spark, folder, table, schema).filter(F.col("run_id") == run_id)


def export_report(df: DataFrame, path: str) -> None:
    """A quality report (or any result) as JSON lines."""
    df.write.mode("overwrite").json(path)


def validate_snapshot(headers: DataFrame, items: DataFrame, allowed: DataFrame) -> DataFrame:
    """Errors of all stored snapshots: version, missing identities, mismatched runs and evidence
    outside the allowed list. One row per snapshot and error."""
    absent = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rules = [
        ("unsupported_schema", ~F.coalesce(F.col("schema_version") == SCHEMA_VERSION, F.lit(False))),
        ("snapshot_id_missing", absent("snapshot_id")),
        ("dataset_identity_missing", absent("session_id") | absent("content_hash")),
        ("metric_missing", absent("metric_id")),
        ("run_missing", absent("run_id")),
        ("ledger_missing", absent("ledger_id")),
        ("run_mismatch", ~absent("run_id") & ~absent("ledger_run_id") & (F.col("run_id") != F.col("ledger_run_id"))),
    ]
    listed = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())
    own = headers.select("snapshot_id", F.explode(listed).alias("error"), F.lit(None).cast("string").alias("evidence_id"))
    outside = (
        items.select("snapshot_id", "evidence_id")
        .distinct()
        .join(allowed.select("snapshot_id", "evidence_id"), ["snapshot_id", "evidence_id"], "left_anti")
        .select("snapshot_id", F.lit("evidence_not_allowed").alias("error"), "evidence_id")
    )
    return own.unionByName(outside)
