"""Period and fiscal-calendar arithmetic on date columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAINS = ("day", "week", "month", "quarter")
# Trailing length and the depth needed for seasonality, by grain.
TRAILING_PERIODS = {"day": 365, "week": 52, "month": 12, "quarter": 4}
SEASONALITY_PERIODS = {"day": 180, "week": 52, "month": 18, "quarter": 8}


def month_start(d: Column) -> Column:
    return F.trunc(d, "month")


def _shifted(d: Column, fiscal_start: int) -> Column:
    """The month moved so that the fiscal year begins in January."""
    return F.add_months(month_start(d), -(fiscal_start - 1))


def fiscal_year_start(d: Column, fiscal_start: int = 1) -> Column:
    return F.add_months(F.trunc(_shifted(d, fiscal_start), "year"), fiscal_start - 1)


def fiscal_quarter_start(d: Column, fiscal_start: int = 1) -> Column:
    return F.add_months(F.trunc(_shifted(d, fiscal_start), "quarter"), fiscal_start - 1)


def fiscal_year_label(d: Column, fiscal_start: int = 1) -> Column:
    """The start year when the fiscal year starts in January, else the year after it."""
    return F.year(_shifted(d, fiscal_start)) + (0 if fiscal_start == 1 else 1)


def fiscal_month_number(d: Column, fiscal_start: int = 1) -> Column:
    return F.month(_shifted(d, fiscal_start))


def period_start(d: Column, grain: str, fiscal_start: int = 1) -> Column:
    if grain == "day":
        return d
    if grain == "week":
        return F.trunc(d, "week")
    if grain == "month":
        return month_start(d)
    if grain == "quarter":
        return fiscal_quarter_start(d, fiscal_start)
    raise ValueError(f"grain must be one of {GRAINS}")


def period_end(start: Column, grain: str) -> Column:
    """Last day of the period that begins at ``start``."""
    if grain == "day":
        return start
    if grain == "week":
        return F.date_add(start, 6)
    return F.date_sub(F.add_months(start, 1 if grain == "month" else 3), 1)


def period_label(start: Column, grain: str, fiscal_start: int = 1) -> Column:
    if grain == "day":
        return F.date_format(start, "MMM d, yyyy")
    if grain == "week":
        return F.concat(F.lit("Week of "), F.date_format(start, "MMM d, yyyy"))
    if grain == "month":
        return F.date_format(start, "MMM yyyy")
    return F.concat(
        F.lit("FY"),
        fiscal_year_label(start, fiscal_start).cast("string"),
        F.lit(" Q"),
        F.quarter(_shifted(start, fiscal_start)).cast("string"),
    )


def prior_year(d: Column) -> Column:
    """Same day one year earlier; 29 February rolls forward to 1 March."""
    leap_day = (F.month(d) == 2) & (F.dayofmonth(d) == 29)
    return F.when(leap_day, F.make_date(F.year(d) - 1, F.lit(3), F.lit(1))).otherwise(
        F.add_months(d, -12)
    )


def window_cutoff(latest: Column, window: str, fiscal_start: int = 1) -> Column | None:
    """First day inside a named window that ends at ``latest``; None for ``all``."""
    cutoffs = {
        "90d": lambda: F.date_sub(latest, 89),
        "8w": lambda: F.date_sub(latest, 49),
        "13w": lambda: F.date_sub(latest, 84),
        "15m": lambda: F.add_months(month_start(latest), -14),
        "24m": lambda: F.add_months(month_start(latest), -23),
        "mtd": lambda: month_start(latest),
        "qtd": lambda: fiscal_quarter_start(latest, fiscal_start),
        "ytd": lambda: fiscal_year_start(latest, fiscal_start),
    }
    if window == "all":
        return None
    return cutoffs[window]()
