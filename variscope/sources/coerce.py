"""Typing of text columns: currency, percent, accounting negatives, booleans and codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variscope.functions.values import NUMBER_PATTERN, cell, let, plain_text, trimmed

# What counts as a boolean, a code that stays text, a number and a percentage, and
# the characters removed before a number is read.
BOOLEAN_PATTERN = r"(?i)^(true|false)$"
CODE_PATTERN = r"^[+-]?(0\d+|\d{16,})$"
PERCENT_PATTERN = r"^\(?[-+]?[$€£¥]?\s*[\d,.]+(\.\d+)?%\)?$"
FORMATTED_PATTERN = r"^\(?[-+]?[$€£¥]?\s*[\d,.]+(\.\d+)?\)?$"
DECORATION_PATTERN = r"[()$€£¥,%\s]"
# All of these in one: no code, formatted or a percentage, and a number once the decoration is removed.
NUMERIC_PATTERN = r"^(?![+-]?(?:0\d+|\d{16,})\z)\(?[-+]?[$€£¥]?\s*(?=[,.]*\d)[\d,]*+(?:\.[\d,]*+)?%?\)?\z"
FINITE_LENGTH = 300  # digits of a double's largest value: 309


def _numeric(t: Column) -> Column:
    """Whether trimmed text is a number: one pattern; only a very long one is read to see that it is finite."""
    short = F.length(t) < FINITE_LENGTH
    return t.rlike(NUMERIC_PATTERN) & (short | F.coalesce(F.abs(_bare_number(t)) < float("inf"), F.lit(False)))


def _bare_number(t: Column) -> Column:
    return F.regexp_replace(t, DECORATION_PATTERN, "").try_cast("double")


def _text_kind(t: Column) -> Column:
    return (
        F.when(t.isNull() | (t == ""), F.lit("missing"))
        .when(_numeric(t), "number")
        .when(t.rlike(BOOLEAN_PATTERN), "boolean")
        .otherwise("string")
    )


def _text_number(t: Column) -> Column:
    """The number in trimmed text, else null. Lambdas stay out of the code that is generated for all columns together."""

    def signed(n: Column) -> Column:
        value = F.when(t.startswith("(") & t.endswith(")"), -F.abs(n)).otherwise(n)
        return F.when(F.abs(n) < float("inf"), F.when(t.contains("%"), value / 100).otherwise(value))

    return let(F.when(t.rlike(NUMERIC_PATTERN), _bare_number(t)), signed)


def _text_value(c: Column) -> Column:
    t = trimmed(c)
    return F.struct(
        _text_kind(t).alias("kind"),
        F.when(t != "", t).alias("text"),
        _text_number(t).alias("number"),
        F.when(t.rlike(BOOLEAN_PATTERN), F.lower(t) == "true").alias("boolean"),
    )


def cell_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, source, raw, number, count)``: how often each raw value occurs in each column.

    Cells are unpivoted as they are and counted with partial aggregation, so the typing rules that
    follow run once per distinct value and not once per cell. A column is counted under its number, and only the
    forms that the columns have, text or numbers, are shuffled.
    """
    cells, sources = [], []
    for i, name in enumerate(columns):
        dtype = df.schema[name].dataType
        c = cell(df, name)
        numeric = isinstance(dtype, T.NumericType)
        sources.append(
            "number" if numeric
            else "text" if isinstance(dtype, T.StringType)
            else "boolean" if isinstance(dtype, T.BooleanType)
            else "time"
        )
        cells.append(
            F.struct(
                F.lit(i).alias("_at"),
                (F.lit(None) if numeric else c).cast("string").alias("raw"),
                (c if numeric else F.lit(None)).cast("double").alias("number"),
            )
        )
    forms = [form for form, kept in (("raw", set(sources) != {"number"}), ("number", "number" in sources)) if kept]
    counted = df.select(F.inline(F.array(*cells))).groupBy("_at", *forms).agg(F.count("*").alias("count"))
    named = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_at") + 1)
    form = lambda name, kind: (F.col(name) if name in forms else F.lit(None).cast(kind)).alias(name)
    return counted.select(
        named(columns).alias("column"), named(sources).alias("source"), form("raw", "string"), form("number", "double"), "count"
    )


def spelled(number: Column) -> Column:
    """The one spelling of a number."""
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(whole, number.cast("bigint").cast("string")).otherwise(number.cast("string"))


def typed_counts(counted: DataFrame) -> DataFrame:
    """``column, source, kind, text, number, count`` of the counted raw values. ``text`` is the value
    as the source holds it for strings, and one spelling per number. The steps are separate
    projections, so each pattern is matched once per value."""
    t, bare = F.col("_t"), F.col("_bare")
    steps = counted.withColumn("_t", F.when(F.col("source") == "text", trimmed(F.col("raw"))))
    steps = steps.withColumns(
        {
            "_percent": t.rlike(PERCENT_PATTERN),
            "_shaped": t.rlike(PERCENT_PATTERN) | (t.rlike(FORMATTED_PATTERN) & ~t.rlike(CODE_PATTERN)),
            "_bare": F.regexp_replace(t, DECORATION_PATTERN, ""),
        }
    )
    read = F.when(F.col("_shaped") & bare.rlike(NUMBER_PATTERN), bare.try_cast("double"))
    steps = steps.withColumn("_read", F.when(F.abs(read) < float("inf"), read))
    signed = F.when(t.startswith("(") & t.endswith(")"), -F.abs("_read")).otherwise(F.col("_read"))
    number = F.coalesce("number", F.when(F.col("_percent"), signed / 100).otherwise(signed))
    steps = steps.withColumn("number", F.when(F.abs(number) < float("inf"), number))
    text_kind = (
        F.when(F.coalesce(t, F.lit("")) == "", "missing")
        .when(t.rlike(BOOLEAN_PATTERN), "boolean")
        .when(F.col("number").isNotNull(), "number")
        .otherwise("string")
    )
    other_kind = F.when(F.col("raw").isNull() & F.col("number").isNull(), "missing").otherwise(
        F.when(F.col("source") == "time", "string").otherwise(F.col("source"))
    )
    steps = steps.withColumn("kind", F.when(F.col("source") == "text", text_kind).otherwise(other_kind))
    text = (
        F.when(F.col("kind") == "number", spelled(F.col("number")))
        .when(F.col("kind") == "boolean", F.lower(trimmed(F.col("raw"))))
        .when(F.col("kind") == "string", F.col("raw"))
    )
    return steps.select("column", "source", "kind", text.alias("text"), F.when(F.col("kind") == "number", F.col("number")).alias("number"), "count")


def coerced(df: DataFrame, name: str) -> Column:
    """``struct(kind, text, number, boolean)`` of one cell; ``kind`` is its runtime type."""
    dtype = df.schema[name].dataType
    c = cell(df, name)
    if isinstance(dtype, T.StringType):
        return _text_value(c)
    none = F.lit(None)
    if isinstance(dtype, T.BooleanType):
        kind, number, boolean = "boolean", none.cast("double"), c
    elif isinstance(dtype, T.NumericType):
        kind, number, boolean = "number", c.cast("double"), none.cast("boolean")
    else:
        kind, number, boolean = "string", none.cast("double"), none.cast("boolean")
    return F.struct(
        F.when(c.isNull(), F.lit("missing")).otherwise(F.lit(kind)).alias("kind"),
        plain_text(df, name).alias("text"),
        number.alias("number"),
        boolean.alias("boolean"),
    )


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def typed_cells(df: DataFrame, wanted: Sequence[tuple[str, str | None, str]]) -> DataFrame:
    """One column per ``(column, form, name)``: its ``text``, ``number`` or ``boolean``, the text of its
    cells that are ``no number`` or ``no boolean``, or with None the column as it is.

    The steps are separate projections, so a cell is trimmed, matched and read once however many forms
    are wanted, and the generated code stays short enough to be compiled to machine code."""
    forms: dict[str, set] = {}
    for c, form, _ in wanted:
        forms.setdefault(c, set()).add(form)
    at = {c: f"_{i}" for i, c in enumerate(forms)}
    text = {c for c in forms if forms[c] != {None} and isinstance(df.schema[c].dataType, T.StringType)}

    def source(c: str) -> Column:
        return trimmed(cell(df, c)) if c in text else cell(df, c) if forms[c] == {None} else coerced(df, c)

    def form_of(c: str, form: str | None) -> Column:
        t, number = F.col(at[c]), F.col(f"{at[c]}n")
        if form is None:
            return t
        if c not in text:
            return t[form]
        return {
            "text": lambda: F.when(t != "", t),
            "number": lambda: number,
            "boolean": lambda: F.when(t.rlike(BOOLEAN_PATTERN), F.lower(t) == "true"),
            "no number": lambda: F.when((t != "") & number.isNull(), t),
            "no boolean": lambda: F.when((t != "") & ~t.rlike(BOOLEAN_PATTERN), t),
        }[form]()

    steps = df.select(*[source(c).alias(at[c]) for c in forms])
    read = [c for c in forms if c in text and forms[c] & {"number", "no number"}]
    steps = steps.select("*", *[_text_number(F.col(at[c])).alias(f"{at[c]}n") for c in read])
    return steps.select(*[form_of(c, form).alias(name) for c, form, name in wanted])


def coerce_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The typed table: each text column becomes ``<name>`` (clean text), ``<name>_number`` and
    ``<name>_boolean``."""
    names = set(columns or text_columns(df))
    wanted = []
    for c in df.columns:
        if c in names:
            wanted += [(c, "text", c), (c, "number", f"{c}_number"), (c, "boolean", f"{c}_boolean")]
        else:
            wanted.append((c, None, c))
    return typed_cells(df, wanted)


def coercion_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Cells of each text column by runtime type; ``string`` cells took no other type.

    Cells are unpivoted as they are, so the typing rules are in the plan once and not once per column."""
    names = list(columns or text_columns(df))
    none = F.lit(None).cast("string")
    cells = []
    for c in names:
        text = isinstance(df.schema[c].dataType, T.StringType)
        raw, kind = (cell(df, c), none) if text else (none, coerced(df, c)["kind"])
        cells.append(F.struct(F.lit(c).alias("column"), raw.alias("raw"), kind.alias("given")))
    steps = df.select(F.inline(F.array(*cells))).select("column", "given", trimmed(F.col("raw")).alias("text"))
    return (
        steps.select("column", F.coalesce("given", _text_kind(F.col("text"))).alias("kind"))
        .groupBy("column")
        .agg(
            F.count("*").alias("cells"),
            *[F.count_if(F.col("kind") == k).alias(f"{k}_cells") for k in ("missing", "number", "boolean", "string")],
        )
    )
