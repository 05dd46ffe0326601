"""Typed views of a table and small helpers shared by the operators."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulario.functions.dates import as_timestamp
from tabulario.functions.numbers import as_double

_FLAT = (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def is_flat(dtype: T.DataType) -> bool:
    return isinstance(dtype, _FLAT)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StringType)


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_instant(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def dtype_of(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def col(name: str) -> Column:
    """Column by exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def number(df: DataFrame, column: str) -> Column:
    return as_double(col(column), dtype_of(df, column))


def instant(df: DataFrame, column: str) -> Column:
    return as_timestamp(col(column), dtype_of(df, column))


def present(df: DataFrame, column: str) -> Column:
    """True where the value is neither null nor NaN."""
    if isinstance(dtype_of(df, column), (T.DoubleType, T.FloatType)):
        return col(column).isNotNull() & ~F.isnan(col(column))
    return col(column).isNotNull()


def intake(df: DataFrame) -> DataFrame:
    """NaN becomes null, so that every operator has one kind of missing value."""
    return df.select(*[
        F.nanvl(col(f.name), F.lit(None)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else col(f.name)
        for f in df.schema
    ])


def rows(spark: SparkSession, data: list[tuple], schema: str) -> DataFrame:
    """A frame of a few result rows: one per column, KPI or rule, never one per input row."""
    return spark.createDataFrame(data, schema)
