"""Reading delimited and JSON files into flat, typed tables."""

from __future__ import annotations

from collections.abc import Sequence

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variscope.functions.values import BLANKS, all_of, cell, is_missing, quoted
from variscope.operators.semantics import apply_contract
from variscope.session import shared_table
from variscope.sources.coerce import coercion_report, text_columns, typed_cells

BAD_RECORD = "_corrupt_record"
PRESENT = "_present_fields"
FLATTEN_DEPTH = 2


def csv_header(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Trimmed names of the first line. Repeated or empty headers are refused here, because the
    reader would rename them silently."""
    line = spark.read.text(path).first()
    if line is None:
        raise ValueError("the file needs a header row")
    names = [n.lstrip("﻿").strip() for n in next(csv.reader([line[0]], delimiter=sep))]
    if not any(names):
        raise ValueError("the header row needs at least one named column")
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"duplicate header names: {', '.join(repeated)}")
    return names


def read_csv(spark: SparkSession, path: str, sep: str = ",", multi_line: bool = False) -> DataFrame:
    """All columns as text plus ``_corrupt_record`` for lines with too few or too many fields.

    Blank lines and lines of blank fields are skipped. Files split across tasks unless quoted fields
    span lines (``multi_line``).
    """
    names = csv_header(spark, path, sep)
    spelled = next(csv.reader([spark.read.text(path).first()[0].lstrip("\ufeff")], delimiter=sep))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*spelled, BAD_RECORD]])
    raw = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)  # every file must have the header of the first
        .option("sep", sep)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD_RECORD)
        .csv(path)
        .toDF(*names, BAD_RECORD)
    )
    return raw.filter(~all_of(is_missing(raw, n) for n in names))


def csv_errors(df: DataFrame) -> DataFrame:
    """The lines that did not fit the header. The read is not pruned to the error column alone."""
    names = [c for c in df.columns if c != BAD_RECORD]
    return df.filter(F.col(BAD_RECORD).isNotNull()).select(BAD_RECORD, F.struct(*[quoted(n) for n in names]).alias("fields"))


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Records of ``[...]`` or ``{"data": [...]}`` documents, or of one object per line.

    Line files split across tasks and keep the number of fields each record has
    (``_present_fields``), which tells ragged records from null cells.
    """
    if lines:
        schema = spark.read.json(path).schema
        if BAD_RECORD in schema.names:
            broken = spark.read.text(path).filter((F.btrim("value", F.lit(BLANKS)) != "") & F.json_object_keys("value").isNull()).limit(3).collect()
            raise ValueError("malformed lines: " + "; ".join(r["value"] for r in broken))
        text = spark.read.text(path).filter(F.btrim("value", F.lit(BLANKS)) != "")
        return text.select(
            F.from_json("value", schema).alias("r"), F.size(F.json_object_keys("value")).alias(PRESENT)
        ).select("r.*", PRESENT)
    df = spark.read.option("multiLine", True).json(path)
    if df.columns == ["data"] and isinstance(df.schema["data"].dataType, T.ArrayType):
        return df.select(F.explode("data").alias("r")).select("r.*")
    return df


def flatten_records(df: DataFrame, depth: int = FLATTEN_DEPTH) -> DataFrame:
    """Nested structs as dotted columns, two levels below the top; arrays and deeper structs as JSON
    text. Only the schema is walked."""
    out: list[Column] = []

    def walk(field: T.StructField, value: Column, path: str, level: int) -> None:
        if isinstance(field.dataType, T.StructType) and level < depth:
            for f in field.dataType.fields:
                name = f.name.lstrip("﻿").strip()
                if name:
                    walk(f, value[f.name], f"{path}.{name}", level + 1)
        elif isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
            out.append(F.to_json(value).alias(path))
        else:
            out.append(value.alias(path))

    for f in df.schema.fields:
        name = f.name.lstrip("﻿").strip()
        if name:
            walk(f, F.col(f"`{f.name}`"), name, 0)
    return df.select(*out)


def typed_table(df: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Text columns whose present cells are numbers (or booleans) to at least ``threshold`` take that
    type; the others keep clean text. One pass counts the kinds of all columns.

    No cell is lost: a typed column that also holds other cells gets a companion ``<name>_text`` with
    the text of those cells, which is null for the rest."""
    names = text_columns(df)
    if not names:
        return df
    kinds = {r["column"]: r for r in coercion_report(df, names).collect()}  # a row per column
    chosen, mixed = {}, []
    for c in names:
        n = {k: kinds[c][f"{k}_cells"] if c in kinds else 0 for k in ("number", "boolean", "string")}
        present = sum(n.values())
        best = max(n, key=n.get)
        chosen[c] = best if present and best != "string" and n[best] / present >= threshold else "text"
        if chosen[c] != "text" and n[best] < present:
            mixed.append(c)
    clash = [f"{c}_text" for c in mixed if f"{c}_text" in df.columns]
    if clash:
        raise ValueError(f"columns of rejected cells would repeat {clash}")
    kept = [(c, f"no {chosen[c]}", f"{c}_text") for c in mixed]
    return typed_cells(df, [(c, chosen.get(c), c) for c in df.columns] + kept)


def rejected_cells(df: DataFrame) -> DataFrame:
    """``column``, ``rejected``: how many cells of each typed column are kept as text beside it."""
    names = [c for c in df.columns if c.endswith("_text") and c.removesuffix("_text") in df.columns]
    counts = df.agg(*[F.count(quoted(c)).alias(c) for c in names]) if names else None
    if counts is None:
        return df.sparkSession.createDataFrame([], "column string, rejected bigint")
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c.removesuffix("_text")).alias("column"), F.col(quoted(c)).alias("rejected")) for c in names])))


def ingest_table(spark: SparkSession, path: str, file_format: str) -> DataFrame:
    """Read, flatten, type and apply the data contract. Broken lines and contract errors raise."""
    if file_format == "csv":
        df = read_csv(spark, path)
        broken = csv_errors(df).limit(3).collect()  # enough for the message
        if broken:
            raise ValueError("malformed lines: " + "; ".join(r[BAD_RECORD] for r in broken))
        df = df.drop(BAD_RECORD)
    elif file_format in ("json", "jsonl"):
        df = flatten_records(read_json(spark, path, lines=file_format == "jsonl")).drop(PRESENT)
    else:
        raise ValueError("file_format is csv, json or jsonl")
    # Stored once: the contract's rules and the caller read typed columns, not the files again.
    return apply_contract(shared_table(typed_table(df), "typed"))


def fingerprint_parts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows and order-free digests of the rows of each group: their number, and the sum and the exclusive or of row hashes.

    Parts of a table (its files, days or runs) merge by adding, adding and exclusive or, so a table that
    grows is not read again. The sum tells copies of a row, which cancel out in the other one. A row's hash
    is 60 bits of the MD5 of its cells as text under their names, in the order of the names.
    """
    cells = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(quoted(c)).cast("string"), F.lit("\x00"))) for c in sorted(set(df.columns) - set(by))]
    h = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *cells)), 1, 15), 16, 10).cast("bigint")
    hashed = df.select(*[F.col(quoted(c)).alias(c) for c in by], h.alias("_h"))
    return hashed.groupBy(*by).agg(F.count("*").alias("row_count"), F.sum(F.col("_h").cast("decimal(20,0)")).alias("sum"), F.bit_xor("_h").alias("xor"))


def merge_fingerprints(parts: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The fingerprint of what the parts make up together: row_count, digest and content_hash, for each group."""
    nothing = F.lit(0)
    merged = parts.groupBy(*by).agg(
        F.coalesce(F.sum("row_count"), nothing).cast("bigint").alias("row_count"),
        F.concat_ws("-", F.coalesce(F.sum("sum"), nothing).cast("decimal(38,0)").cast("string"), F.coalesce(F.bit_xor("xor"), nothing).cast("string")).alias("digest"),
    )
    named = F.lit(",".join(sorted(set(columns) - set(by))))
    return merged.withColumn("content_hash", F.sha2(F.concat_ws("|", F.col("row_count").cast("string"), "digest", named), 256))


def content_fingerprint(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Row count, digest and hash of all rows (of each group), whatever their order."""
    return merge_fingerprints(fingerprint_parts(df, by), df.columns, by)


def evidence_rows(df: DataFrame, sensitive: list[str], order_by: list[str], limit: int = 100) -> DataFrame:
    """Supporting rows of a cohort, 1 to 500 in a stated order, with sensitive columns redacted."""
    if not 1 <= limit <= 500:
        raise ValueError("evidence is limited to 1 to 500 rows")
    shown = [F.lit("[redacted]").alias(c) if c in sensitive else F.col(quoted(c)) for c in df.columns]
    return df.orderBy(*order_by).limit(limit).select(*shown)


