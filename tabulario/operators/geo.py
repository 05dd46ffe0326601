"""Mexican states: recognise them however they are spelled, add up their totals, place them on a map."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulario.functions import fixed
from tabulario.functions.text import plain_place
from tabulario.operators.intake import rows

PREFIXES = ["estado de", "edo de", "edo"]


def state_names(spark: SparkSession) -> DataFrame:
    """(name, state): every plain spelling that stands for a state; under 200 rows by construction."""
    names = {f"{prefix} {state}": state for state in fixed.STATE_CENTRES for prefix in PREFIXES}
    names.update(fixed.STATE_ALIASES)
    names.update({state: state for state in fixed.STATE_CENTRES})
    return rows(spark, sorted(names.items()), "name string, state string")


def state_places(spark: SparkSession) -> DataFrame:
    """(state, label, lat, lon) of the 32 states."""
    data = [(k, fixed.STATE_DISPLAY.get(k, k.title()), lat, lon) for k, (lat, lon) in fixed.STATE_CENTRES.items()]
    return rows(spark, data, "state string, label string, lat double, lon double")


def with_state(df: DataFrame, column: str) -> DataFrame:
    """Add `state`, null where the place is not one. The lookup has a fixed, small size, so it is broadcast."""
    names = state_names(df.sparkSession).withColumnRenamed("name", "_plain")
    return df.withColumn("_plain", plain_place(F.col(column))).join(F.broadcast(names), "_plain", "left").drop("_plain")


def recognition(values: DataFrame, column: str) -> DataFrame:
    """One row about the distinct values of a column: how many, how many are states, and the verdict."""
    distinct = values.select(F.col(column).cast("string").alias("v")).where(
        "trim(v) <> '' and lower(v) <> 'nan'").distinct()
    counted = with_state(distinct, "v").agg(F.count(F.lit(1)).alias("distintos"), F.count("state").alias("reconocidos"))
    return counted.withColumn(
        "es_de_estados", (F.col("distintos") >= 3) & (F.try_divide("reconocidos", "distintos") >= 0.6))


def state_totals(totals: DataFrame) -> DataFrame:
    """(state, label, lat, lon, value) from (k, v): spellings of a state added up, highest first."""
    per = with_state(totals.where("v is not null"), "k").where("state is not null").groupBy("state").agg(F.sum("v").alias("value"))
    return per.join(F.broadcast(state_places(totals.sparkSession)), "state").select(
        "state", "label", "lat", "lon", "value").orderBy(F.desc("value"), "state")
