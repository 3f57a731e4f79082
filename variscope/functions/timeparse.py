"""Reading time values of several spellings into a timestamp and its precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variscope.functions.values import cell, let, quoted, trimmed

# Accepted spellings, first match wins, and the formats tried after them.
MONTH_PATTERN = r"^(19\d{2}|20\d{2}|21\d{2})[-/](0?[1-9]|1[0-2])$"
QUARTER_PATTERN = r"^(19\d{2}|20\d{2}|21\d{2})[- ]?[Qq]([1-4])$"
WEEK_PATTERN = r"^(19\d{2}|20\d{2}|21\d{2})[- ]?[Ww](\d{1,2})$"
YEAR_PATTERN = r"^(19\d{2}|20\d{2}|21\d{2})$"
DAY_PATTERN = r"^(19\d{2}|20\d{2}|21\d{2})[-/](0?[1-9]|1[0-2])[-/](0?[1-9]|[12]\d|3[01])$"
ISO_PATTERN = r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{2}"
MONTH_NAME = r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
WEEKDAY_NAME = r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+(?=\S)"
ZONE_NAME = r"(?i)\s*\b(gmt|utc)$"
SLASH_PATTERN = r"^\d{1,2}/\d{1,2}/\d{4}$"
# What no free-form spelling can do without: four digits.
FREE_PATTERN = r"(?<!\d)\d{4}(?!\d)"
FIRST_YEAR, LAST_YEAR = 1900, 2200
EPOCH_FLOOR = 1e10


def _part(t: Column, pattern: str, index: int) -> Column:
    return F.regexp_extract(t, pattern, index).try_cast("int")


def _iso_monday(y: Column, w: Column) -> Column:
    return F.date_add(F.trunc(F.make_date(y, F.lit(1), F.lit(4)), "week"), (w - 1) * 7)


def _in_range(ts: Column) -> Column:
    return F.when(F.year(ts).between(FIRST_YEAR, LAST_YEAR), ts)


def _shapes() -> dict[str, str]:
    """Shapes of free-form dates and their formats: A is a month's name, Y four digits, 9 one or two digits and P the half of a day.

    A date may have a time of hours and minutes, with seconds, with the half of the day.
    """
    dates = {"A 9 Y": "MMM d yyyy", "9 A Y": "d MMM yyyy", "9-A-Y": "d-MMM-yyyy", "A Y": "MMM yyyy", "9/9/Y": "M/d/yyyy", "9-9-Y": "M-d-yyyy", "Y/9/9": "yyyy/M/d"}
    times = {"": "", " 9:9": " H:mm", " 9:9:9": " H:mm:ss", " 9:9 P": " h:mm a", " 9:9:9 P": " h:mm:ss a"}
    return {d + t: f + g for d, f in dates.items() for t, g in times.items()}


SHAPES = _shapes()


def _from_shape(t: Column) -> Column:
    """The time of a free-form date. Its text is reduced to a shape, and the shape chooses the one format that reads it."""
    plain = F.regexp_replace(F.regexp_replace(t, WEEKDAY_NAME, ""), ZONE_NAME, "")
    plain = F.regexp_replace(F.regexp_replace(plain, MONTH_NAME, "$1"), r"[,\s]+", " ")
    halves = F.regexp_replace(plain, r"(?i) ?\b(am|pm)$", " P")
    shape = F.regexp_replace(F.regexp_replace(halves, r"(?<!\d)\d{4}(?!\d)", "Y"), r"(?<!\d)\d{1,2}(?!\d)", "9")
    shape = F.regexp_replace(shape, r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\b", "A")
    text = F.regexp_replace(plain, r"(?i) ?\b(am|pm)$", " $1")

    def read(s: Column) -> Column:
        return F.coalesce(*[F.when(s["shape"] == name, F.try_to_timestamp(s["text"], F.lit(f))) for name, f in SHAPES.items()])

    return let(F.struct(shape.alias("shape"), text.alias("text")), read)


def _from_text(c: Column) -> Column:
    t = trimmed(c)
    one = F.lit(1)
    week = _part(t, WEEK_PATTERN, 2)
    # "2024/3" and "2024-3-7" read as dates once the slashes are dashes; a day the calendar lacks is null.
    calendar = F.replace(t, F.lit("/"), F.lit("-")).try_cast("date")
    ts = (
        F.when(t.rlike(MONTH_PATTERN) | t.rlike(DAY_PATTERN), calendar.cast("timestamp"))
        .when(
            t.rlike(QUARTER_PATTERN),
            F.make_date(_part(t, QUARTER_PATTERN, 1), _part(t, QUARTER_PATTERN, 2) * 3 - 2, one).cast("timestamp"),
        )
        .when(
            t.rlike(WEEK_PATTERN),
            F.when(week.between(1, 53), _iso_monday(_part(t, WEEK_PATTERN, 1), week)).cast("timestamp"),
        )
        .when(t.rlike(YEAR_PATTERN), F.make_date(t.try_cast("int"), one, one).cast("timestamp"))
        .when(t.rlike(ISO_PATTERN), _in_range(t.try_cast("timestamp")))
        .when(t.rlike(FREE_PATTERN), _in_range(_from_shape(t)))
    )
    precision = (
        F.when(t.rlike(MONTH_PATTERN), "month")
        .when(t.rlike(QUARTER_PATTERN) | t.rlike(YEAR_PATTERN), "quarter")
        .when(t.rlike(WEEK_PATTERN), "week")
        .otherwise("day")
    )
    return F.struct(ts.alias("ts"), precision.alias("precision"))


def _from_number(c: Column) -> Column:
    d = c.cast("double")
    year = (d == F.floor(d)) & d.between(FIRST_YEAR, LAST_YEAR)
    ts = F.when(year, F.make_date(d.cast("int"), F.lit(1), F.lit(1)).cast("timestamp")).when(
        (d > EPOCH_FLOOR) & (d < 8.64e15), F.timestamp_millis(d.cast("bigint"))
    )
    return F.struct(ts.alias("ts"), F.when(year, "quarter").otherwise("day").alias("precision"))


def parse_time_value(df: DataFrame, name: str) -> Column:
    """``struct(ts, precision)`` for one column. ``ts`` is null where the value is no time, and the
    precision only has a meaning where it is not."""
    dtype = df.schema[name].dataType
    c = F.col(quoted(name))
    if isinstance(dtype, T.StringType):
        return _from_text(c)
    if isinstance(dtype, T.NumericType):
        return _from_number(c)
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.struct(c.cast("timestamp").alias("ts"), F.lit("day").alias("precision"))
    return F.lit(None).cast("struct<ts:timestamp,precision:string>")


def time_of(df: DataFrame, name: str) -> Column:
    """Only the timestamp. Typed date columns pass straight through, so filters stay pushable."""
    if isinstance(df.schema[name].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return cell(df, name).cast("timestamp")
    return parse_time_value(df, name)["ts"]


def date_of(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.DateType):
        return cell(df, name)
    return time_of(df, name).cast("date")
