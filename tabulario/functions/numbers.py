"""Number functions: tolerant parsing and display."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulario.functions import fixed
from tabulario.functions.text import strip

# A value that reads as it stands once `$`, spaces and thousands are gone; and characters that no step takes away, so it is no number.
_PLAIN = r"^(?:\$ ?)?[+-]?(?:[0-9]+|[0-9]{1,3}(?:,[0-9]{3})+)(?:\.[0-9]+)?\z"
_FOREIGN = r"[@#/:;_&*!?|b-cf-kqtv-wy-zB-CF-KQTV-WY-Z]"
_NUMBER = r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)$"


def to_number(c: Column) -> Column:
    """Text to double: currency, percent, thousands, decimal comma, parentheses for negatives."""
    raw = c.cast("string")
    s = strip(raw)
    sign = F.when(s.rlike(r"(?s)^\(.*\)$"), F.lit(-1.0)).otherwise(F.lit(1.0))
    kept = F.when(~F.lower(s).isin(fixed.NULL_TOKENS), s)
    body = F.regexp_replace(kept, r"^[()]+|[()]+$", "")
    body = F.translate(F.regexp_replace(body, fixed.CURRENCY_PATTERN, ""), "%  ", "")
    no_commas = F.translate(body, ",", "")
    comma_is_point = F.translate(F.translate(body, ".", ""), ",", ".")
    plain = (
        F.when(~body.contains(","), body)
        .when(body.contains("."), F.when(body.rlike(r"\.[^,]*$"), no_commas).otherwise(comma_is_point))
        .when(body.rlike(r"^[^,].*,[^,]{3}$"), no_commas)
        .otherwise(comma_is_point)
    )
    found = F.regexp_extract(plain, _NUMBER, 1).try_cast("double") * sign
    return F.when(raw.rlike(_PLAIN), F.translate(raw, "$, ", "").try_cast("double")).when(~raw.rlike(_FOREIGN), found)


def as_double(c: Column, dtype: T.DataType) -> Column:
    """Numeric view of a column of any type; NaN is missing."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    if isinstance(dtype, T.NumericType):
        return c.cast("double")
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(dtype, T.StringType):
        return to_number(c)
    return F.lit(None).cast("double")


def safe_div(a: Column, b: Column) -> Column:
    """Null instead of an error when the divisor is zero or missing."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def human(v: Column) -> Column:
    """Short display: 1.20M, 34.5K, 1,234.56."""
    a = F.abs(v)
    sized = (
        F.when(a >= 1e9, F.concat(F.format_number(a / 1e9, 2), F.lit("B")))
        .when(a >= 1e6, F.concat(F.format_number(a / 1e6, 2), F.lit("M")))
        .when(a >= 1e4, F.concat(F.format_number(a / 1e3, 1), F.lit("K")))
        .when(a >= 1, F.format_number(a, 2))
        .when(a == 0, F.lit("0"))
        .otherwise(F.format_number(a, 4))
    )
    finite = v.isNotNull() & ~F.isnan(v) & (a != float("inf"))
    return F.when(finite, F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")), sized)).otherwise(F.lit("—"))


def percent(v: Column, decimals: int = 1) -> Column:
    return F.when(
        v.isNotNull() & ~F.isnan(v), F.concat(F.format_number(v * 100, decimals), F.lit("%"))
    ).otherwise(F.lit("—"))


def display(v: Column, fmt: Column, currency: str = "$") -> Column:
    """Value in the format named by `fmt`: moneda, porcentaje, entero or numero."""
    missing = v.isNull() | F.isnan(v)
    return (
        F.when(missing, F.lit("—"))
        .when(fmt == "moneda", F.concat(F.lit(currency), human(v)))
        .when(fmt == "porcentaje", percent(v))
        .when(fmt == "entero", F.format_number(F.bround(v, 0), 0))
        .otherwise(human(v))
    )
