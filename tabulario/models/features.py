"""Which columns can feed a model, what task the target asks for, and leakage checks."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulario.functions.text import as_category
from tabulario.operators.intake import col, dtype_of, number, present, rows
from tabulario.operators.profile import Profiles

CLASSIFICATION, REGRESSION = "clasificación", "regresión"
PARTS = ("anio", "mes", "dia_semana")


@dataclass(frozen=True)
class Features:
    """Columns by how they enter the model."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    dates: tuple[str, ...]
    excluded: tuple[tuple[str, str], ...]

    @property
    def columns(self) -> list[str]:
        return [*self.numeric, *self.categorical, *self.dates]


def usable_features(profiles: Profiles, target: str | None = None, with_dates: bool = True) -> Features:
    """Numbers, categories of at most 50 values and dates; everything else is left out with its reason."""
    numeric, categorical, dates, excluded = [], [], [], []
    for p in profiles.values():
        if p.name == target or p.semantic == "no_soportado":
            continue
        if p.semantic in ("vacia", "constante"):
            excluded.append((p.name, "sin variación"))
        elif "identificador" in (p.semantic, p.role):
            excluded.append((p.name, "identificador"))
        elif p.semantic == "texto":
            excluded.append((p.name, "texto libre"))
        elif p.semantic == "fecha":
            readable = p.text_stored is None or p.convertible_datetime * p.n_present / max(p.n, 1) >= 0.5
            if with_dates and readable and p.pct_missing <= 0.5:
                dates.append(p.name)
            else:
                excluded.append((p.name, "fecha"))
        elif p.semantic == "numerico":
            numeric.append(p.name)
        elif p.n_unique > 50:
            excluded.append((p.name, f"{p.n_unique} categorías"))
        else:
            categorical.append(p.name)
    return Features(tuple(numeric), tuple(categorical), tuple(dates), tuple(excluded))


def features_frame(df: DataFrame, features: Features) -> DataFrame:
    data = [(c, kind, "") for kind, names in (("numerica", features.numeric), ("categorica", features.categorical),
                                              ("fecha", features.dates)) for c in names]
    return rows(df.sparkSession, data + [(c, "excluida", why) for c, why in features.excluded],
                "column string, uso string, motivo string")


def infer_task(df: DataFrame, target: str, distinct: int) -> str:
    """Regression for numbers of more than 20 values (more than 10 when they are fractional by type)."""
    kind = dtype_of(df, target).typeName()
    if kind in ("double", "float", "decimal"):
        return REGRESSION if distinct > 10 else CLASSIFICATION
    if kind in ("byte", "short", "integer", "long"):
        return REGRESSION if distinct > 20 else CLASSIFICATION
    return CLASSIFICATION


def cross_table(df: DataFrame, c: str, y: str) -> DataFrame:
    """(c, y, n): rows per pair of values; a missing value is the category `nan`."""
    return df.groupBy(as_category(col(c)).alias("c"), as_category(col(y)).alias("y")).agg(F.count(F.lit(1)).alias("n"))


_LEAK = "column string, motivo string, valor double"


def category_leaks(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(column, purity, categories, leaks): share of categories that fall in a single class, all columns in one shuffle."""
    long = df.select(as_category(col(target)).alias("y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), as_category(col(c)).alias("value"), present(df, c).alias("here")) for c in columns
    ])).alias("x")).groupBy("x.column", "x.value", "y").agg(F.max("x.here").alias("here"))
    per = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("classes"), F.max("here").alias("here"))
    out = per.groupBy("column").agg(
        F.avg((F.col("classes") == 1).cast("double")).alias("purity"), F.count(F.lit(1)).alias("categories"),
        F.count_if("here").alias("present"))
    leaks = (F.col("categories") >= 2) & (F.col("purity") > 0.98) & (F.col("present") > 2)
    return out.withColumn("leaks", leaks).drop("present")


def range_leaks(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(column, classes, separated): whether the value ranges of the classes (of three rows or more) never overlap."""
    per = df.groupBy(as_category(col(target)).alias("y")).agg(
        F.count(F.lit(1)).alias("n"), *[F.min(number(df, c)).alias(f"lo{i}") for i, c in enumerate(columns)],
        *[F.max(number(df, c)).alias(f"hi{i}") for i, c in enumerate(columns)]).where("n > 2")
    long = per.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi"))
        for i, c in enumerate(columns)])).alias("x")).select("x.*").where("lo is not null")
    # one row per class and column: windows stay small
    before = F.max("hi").over(W.partitionBy("column").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1))
    return long.withColumn("apart", F.coalesce(before < F.col("lo"), F.lit(True))).groupBy("column").agg(
        F.count(F.lit(1)).alias("classes"), F.bool_and("apart").alias("apart")).select(
        "column", "classes", (F.col("apart") & (F.col("classes") > 1)).alias("separated"))


def target_correlations(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(column, r, leaks): correlation of every number with a numeric target, in one aggregation."""
    y = number(df, target)
    ok = [number(df, c).isNotNull() & y.isNotNull() for c in columns]
    one = df.agg(*[
        F.struct(F.lit(c).alias("column"), F.corr(F.when(k, number(df, c)), F.when(k, y)).alias("r")).alias(f"c{i}")
        for i, (c, k) in enumerate(zip(columns, ok))])
    return one.select(F.explode(F.array(*one.columns)).alias("x")).select("x.*").withColumn("leaks", F.coalesce(F.abs("r") > 0.98, F.lit(False)))


def detect_leakage(df: DataFrame, target: str, features: Features, task: str) -> DataFrame:
    """Predictors that hold the answer: (column, motivo, valor)."""
    found: list[tuple] = []
    if task == CLASSIFICATION:
        if features.categorical:
            found += [(r["column"], "determina la clase", r["purity"])
                      for r in category_leaks(df, list(features.categorical), target).where("leaks").collect()]
        if features.numeric:
            found += [(r["column"], "separa las clases", 1.0)
                      for r in range_leaks(df, list(features.numeric), target).where("separated").collect()]
    elif features.numeric:
        found += [(r["column"], "equivale al objetivo", r["r"])
                  for r in target_correlations(df, list(features.numeric), target).where("leaks").collect()]
    return rows(df.sparkSession, found, _LEAK)


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """(y, n, usable): rows per class; classes of fewer than five rows cannot be checked."""
    return df.where(present(df, target)).groupBy(as_category(col(target)).alias("y")).agg(
        F.count(F.lit(1)).alias("n")).withColumn("usable", F.col("n") >= 5)
