"""Date functions: tolerant parsing, periods and Spanish labels.

Instants are TIMESTAMP_NTZ and period starts are DATE, so no result depends on a time zone.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulario.functions import fixed
from tabulario.functions.text import strip

# Shape of the text -> formats tried in order. Each value is parsed only by the formats of its shape.
_FORMATS = [
    (r"^\d{4}/\d{1,2}/\d{1,2}$", ["yyyy/M/d"]),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", ["d/M/yyyy H:mm:ss", "M/d/yyyy H:mm:ss"]),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", ["d/M/yyyy", "M/d/yyyy"]),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", ["d-M-yyyy", "M-d-yyyy"]),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", ["d.M.yyyy"]),
]
_SLASHES = r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\z"  # the third shape, with nothing around it
_BEGINS = r"(?U)^\s*[0-9]{1,4}[-/.]"  # as every shape does
_ISO = r"^\d{4}-\d{1,2}-\d{1,2}(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?$"


def to_datetime(c: Column) -> Column:
    """Text to TIMESTAMP_NTZ, day first when both orders are possible; null when unreadable."""
    def tried(text: Column, formats: list[str]) -> Column:
        return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats])

    raw = c.cast("string")
    s = strip(raw)
    parsed = F.when(s.rlike(_ISO), s.try_cast("timestamp_ntz"))
    for shape, formats in _FORMATS:
        parsed = parsed.when(s.rlike(shape), tried(s, formats))
    return F.when(raw.rlike(_SLASHES), tried(raw, ["d/M/yyyy", "M/d/yyyy"])).when(raw.rlike(_BEGINS), parsed)


def as_timestamp(c: Column, dtype: T.DataType) -> Column:
    """TIMESTAMP_NTZ view of a column of any type; numbers are never read as dates."""
    if isinstance(dtype, T.TimestampNTZType):
        return c
    if isinstance(dtype, (T.TimestampType, T.DateType)):
        return c.cast("timestamp_ntz")
    if isinstance(dtype, T.StringType):
        return to_datetime(c)
    return F.lit(None).cast("timestamp_ntz")


_TRUNC = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}


def period_start(ts: Column, unit: str) -> Column:
    """First day of the period (D, W from Monday, M, Q, Y) as DATE."""
    return F.trunc(ts.cast("date"), _TRUNC[unit]) if unit != "D" else ts.cast("date")


def next_period(start: Column, unit: str, n: int = 1) -> Column:
    if unit in ("D", "W"):
        return F.date_add(start, n * (1 if unit == "D" else 7))
    return F.add_months(start, n * {"M": 1, "Q": 3, "Y": 12}[unit])


def period_end(start: Column, unit: str) -> Column:
    """Last day of the period; weeks end on Sunday."""
    return F.date_sub(next_period(start, unit), 1)


def period_step(unit: str) -> Column:
    """Interval between two consecutive period starts, for `sequence`."""
    return F.expr({"D": "interval 1 day", "W": "interval 7 day", "M": "interval 1 month",
                   "Q": "interval 3 month", "Y": "interval 1 year"}[unit])


def seconds(ts: Column) -> Column:
    """Seconds since 1970 as double; exact to the microsecond within a few centuries."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts) / F.lit(1e6)


def from_seconds(sec: Column) -> Column:
    return F.timestamp_add(
        "MICROSECOND", F.round(sec * 1e6).cast("bigint"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    )


def _name_of(position: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), position)


def month_name(d: Column) -> Column:
    return _name_of(F.month(d), fixed.MONTHS)


def weekday_name(d: Column) -> Column:
    return _name_of(F.weekday(d) + 1, fixed.WEEKDAYS)


def period_label(d: Column, unit: str) -> Column:
    """Spanish name of the period that `d` stands for."""
    day, year = F.dayofmonth(d).cast("string"), F.year(d).cast("string")
    dated = F.concat(day, F.lit(" de "), month_name(d), F.lit(" de "), year)
    if unit == "D":
        return F.concat(dated, F.lit(" ("), weekday_name(d), F.lit(")"))
    if unit == "W":
        return F.concat(F.lit("la semana del "), dated)
    if unit == "Q":
        return F.concat(F.lit("el trimestre "), F.quarter(d).cast("string"), F.lit(" de "), year)
    return F.concat(month_name(d), F.lit(" de "), year)
