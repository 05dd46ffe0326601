"""Value counts: the base that profiling and most quality rules share."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulario.operators.intake import col, is_flat


def text_form(name: str, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        # + 0.0 makes one zero of the two that floating point has
        return (F.nanvl(col(name), F.lit(None)) + F.lit(0.0)).cast("string")
    return col(name).cast("string")


ROWS = "(filas)"  # stands for a column that every row has


def value_counts(df: DataFrame, columns: list[str] | None = None, count_rows: bool = False) -> DataFrame:
    """(column, value, n): how often each value occurs, over all flat columns, missing left out.

    One shuffle for every column at once. Counts are combined before it, so a value that holds a
    large part of the rows travels once per task. With `count_rows` the column ROWS, with the one
    value ROWS, tells how many rows there are.
    """
    picked = [f for f in df.schema if is_flat(f.dataType) and (columns is None or f.name in columns)]
    long = df.select(
        F.explode(F.array(*[
            F.struct(F.lit(f.name).alias("column"), text_form(f.name, f.dataType).alias("value")) for f in picked
        ], *([F.struct(F.lit(ROWS).alias("column"), F.lit(ROWS).alias("value"))] if count_rows else []))).alias("x")
    ).select("x.column", "x.value")
    return long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def shares(df: DataFrame, column: str, missing: str | None = None) -> DataFrame:
    """(value, n, share) of one column; with `missing` the null rows form that category."""
    value = text_form(column, df.schema[column].dataType)
    counted = df.select((F.coalesce(value, F.lit(missing)) if missing else value).alias("value"))
    counted = counted.where(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n")).scalar()
    return counted.select("value", "n", (F.col("n") / total).alias("share"))


def top_values(counts: DataFrame, k: int = 15) -> DataFrame:
    """The k most frequent values of each column; ties go to the smallest value.

    Spark keeps only k rows per column and task before the shuffle (window group limit).
    """
    order = W.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def first_values(df: DataFrame, order_by: str, columns: list[str] | None = None, k: int = 5) -> DataFrame:
    """(column, position, value): the first k present values of each column in row order."""
    picked = [f for f in df.schema if is_flat(f.dataType) and (columns is None or f.name in columns)]
    long = df.select(col(order_by).alias("_o"), F.explode(F.array(*[
        F.struct(F.lit(f.name).alias("column"), text_form(f.name, f.dataType).alias("value")) for f in picked])).alias("x"))
    present_ = long.select("_o", "x.column", "x.value").where(F.col("value").isNotNull())
    # one scan for all columns; only k rows per column and task are shuffled (window group limit)
    position = F.row_number().over(W.partitionBy("column").orderBy("_o", "value"))
    return present_.withColumn("position", position).where(F.col("position") <= k).select("column", "position", "value")


def mode(counts: DataFrame) -> DataFrame:
    """(column, moda, freq_moda); ties go to the smallest value."""
    return counts.groupBy("column").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("moda"), F.max("n").alias("freq_moda")
    )
