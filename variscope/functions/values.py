"""Scalar rules for categories, numbers and impact, as built-in column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The label for null/blank categories, the blanks that trimming removes and the
# accepted spelling of a number.
MISSING = "(missing)"
BLANKS = " \t\n\x0b\f\r   　﻿"
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

POLARITIES = {"higher_is_better": 1, "lower_is_better": -1}


def quoted(name: str) -> str:
    """A column name as Spark must read it: flattened records have dots in their names."""
    return "`" + name.replace("`", "``") + "`"


def cell(df: DataFrame, name: str) -> Column:
    return df[quoted(name)]


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def plain_text(df: DataFrame, name: str) -> Column:
    """The text form of a column; whole doubles print as ``1`` and not ``1.0``."""
    dtype = df.schema[name].dataType
    c = cell(df, name)
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        d = c.cast("double")
        whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
        return F.when(whole, d.cast("bigint").cast("string")).otherwise(d.cast("string"))
    return c.cast("string")


def is_missing(df: DataFrame, name: str) -> Column:
    """True where the cell is null, or blank text."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return cell(df, name).isNull() | (trimmed(cell(df, name)) == "")
    return cell(df, name).isNull()


def canonical_category(df: DataFrame, name: str) -> Column:
    """Trimmed text of a category; null and blank become ``(missing)``."""
    return F.coalesce(F.nullif(trimmed(plain_text(df, name)), F.lit("")), F.lit(MISSING))


def category_equals(df: DataFrame, name: str, value: str) -> Column:
    """Canonical equality. For present text the trimmed comparison also implies ``contains``, which
    the scan can push down to the row groups; trimming alone would hide the column from it."""
    if value == MISSING:
        return canonical_category(df, name) == MISSING
    same = trimmed(plain_text(df, name)) == value
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.contains(cell(df, name), F.lit(value)) & same
    return same


def finite_number(df: DataFrame, name: str) -> Column:
    """The usable number in a cell, else null. Decimals stay decimal so their sums are exact."""
    dtype = df.schema[name].dataType
    c = cell(df, name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        d = c.cast("double")
        return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)
    if isinstance(dtype, T.NumericType):
        return c
    if isinstance(dtype, T.StringType):
        t = trimmed(c)
        number = F.when(t.rlike(NUMBER_PATTERN), t.try_cast("double"))
        return F.when(F.abs(number) < float("inf"), number)
    return F.lit(None).cast("double")


def multiplier(polarity: str) -> int:
    return POLARITIES[polarity]


def impact_direction(impact: Column) -> Column:
    return (
        F.when(impact > 0, "favorable").when(impact < 0, "unfavorable").when(impact == 0, "neutral")
    )


def ratio(num: Column, den: Column) -> Column:
    """Division that is null for a zero denominator (ANSI mode would raise)."""
    return num / F.nullif(den, F.lit(0).cast("double"))


def variance_pct(variance: Column, expected: Column) -> Column:
    return ratio(variance.cast("double"), F.abs(expected.cast("double")))


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also inside the lambdas of ``body``
    (a plain expression there would be computed again for every element)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def array_median(a: Column) -> Column:
    """Median of a short array of doubles; null when it is empty."""
    return array_percentile(a, 0.5)


def array_percentile(a: Column, p: float) -> Column:
    """Linear-interpolation percentile of a short array of doubles."""
    position = (F.size(a) - 1) * F.lit(float(p))
    low, high = F.floor(position).cast("int") + 1, F.ceil(position).cast("int") + 1

    def pick(s: Column) -> Column:
        below = F.try_element_at(s, low)
        return below + (F.try_element_at(s, high) - below) * (position - F.floor(position))

    return F.when(F.size(a) > 0, let(F.array_sort(a), pick))


def array_mean(a: Column) -> Column:
    total = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) > 0, total / F.size(a))


def array_std(a: Column) -> Column:
    """Population standard deviation of a short array, 0 below two values."""

    def deviation(m: Column) -> Column:
        return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(a))

    return F.when(F.size(a) >= 2, let(array_mean(a), deviation)).otherwise(F.lit(0.0))


def array_mad(a: Column) -> Column:
    """Median absolute deviation from the median."""
    return let(array_median(a), lambda m: array_median(F.transform(a, lambda x: F.abs(x - m))))


def array_robust_scale(a: Column) -> Column:
    """1.4826 x MAD, else the population deviation; 0 below two values (the time-series rule)."""
    return F.when(
        F.size(a) >= 2, F.coalesce(F.nullif(array_mad(a) * 1.4826, F.lit(0.0)), array_std(a))
    ).otherwise(F.lit(0.0))
