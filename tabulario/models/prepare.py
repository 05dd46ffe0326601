"""Stages that turn raw columns into a feature vector. They live inside the saved model, so new data may come raw."""
from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulario.functions.text import as_category
from tabulario.models.features import PARTS, Features
from tabulario.operators.intake import col, instant, number

RARE = "(otras)"


class ColumnCoercer(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Numbers out of text such as money, and year, month and weekday out of dates, as new DOUBLE columns."""

    numeric = Param(Params._dummy(), "numeric", "columns read as numbers", TypeConverters.toListString)
    dates = Param(Params._dummy(), "dates", "columns read as dates", TypeConverters.toListString)

    @keyword_only
    def __init__(self, numeric=None, dates=None):
        super().__init__()
        self._setDefault(numeric=[], dates=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def outputs(self) -> list[str]:
        names = [f"num__{c}" for c in self.getOrDefault(self.numeric)]
        return names + [f"{c}__{part}" for c in self.getOrDefault(self.dates) for part in PARTS]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        made = {f"num__{c}": number(dataset, c) for c in self.getOrDefault(self.numeric)}
        for c in self.getOrDefault(self.dates):
            d = instant(dataset, c)
            for part, f in zip(PARTS, (F.year, F.month, F.weekday)):
                made[f"{c}__{part}"] = f(d).cast("double")
        return dataset.withColumns(made) if made else dataset


class CategoryFolder(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Fills missing categories with the training mode and folds those not kept into one bucket."""

    kept = Param(Params._dummy(), "kept", "JSON: column -> [mode, kept values]", TypeConverters.toString)

    @keyword_only
    def __init__(self, kept=None):
        super().__init__()
        self._setDefault(kept="{}")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        made = {}
        for c, (mode, values) in json.loads(self.getOrDefault(self.kept)).items():
            v = F.coalesce(col(c).cast("string"), F.lit(mode))
            made[f"cat__{c}"] = F.when(v.isin(values), v).otherwise(F.lit(RARE))
        return dataset.withColumns(made) if made else dataset


def _categories(df: DataFrame, columns: tuple[str, ...]) -> dict[str, list]:
    """Mode and values of at least 1 % of the rows, per column. Features have at most 50 values each."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), as_category(col(c)).alias("v"), col(c).isNotNull().alias("here")) for c in columns
    ])).alias("x")).select("x.*").groupBy("c", "v", "here").agg(F.count(F.lit(1)).alias("n"))
    per: dict[str, list] = {c: [] for c in columns}
    for r in long.collect():
        per[r["c"]].append((r["n"], r["v"], r["here"]))
    out = {}
    for c, found in per.items():
        total = sum(n for n, *_ in found)
        real = [(-n, v) for n, v, here in found if here]
        mode = min(real)[1] if real else "nan"
        missing = total + sum(n for n, _ in real)
        size = {v: -n + (missing if v == mode else 0) for n, v in real}
        out[c] = [mode, sorted(v for v, n in size.items() if n >= 0.01 * total)]
    return out


def fit_features(train: DataFrame, features: Features) -> PipelineModel:
    """Median filling and scaling for numbers, folding and one-hot for categories, one vector named `features`."""
    coercer = ColumnCoercer(numeric=list(features.numeric), dates=list(features.dates))
    stages: list = [coercer]
    df = coercer.transform(train)
    parts = []
    numbers = coercer.outputs()
    if numbers:
        filled = [f"fill__{i}" for i in range(len(numbers))]
        imputer = Imputer(strategy="median", inputCols=numbers, outputCols=filled).fit(df)
        gather = VectorAssembler(inputCols=filled, outputCol="_numbers", handleInvalid="keep")
        df = gather.transform(imputer.transform(df))
        scaler = StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True).fit(df)
        stages += [imputer, gather, scaler]
        parts.append("_scaled")
    if features.categorical:
        folder = CategoryFolder(kept=json.dumps(_categories(train, features.categorical)))
        df = folder.transform(df)
        names = [f"cat__{c}" for c in features.categorical]
        indexer = StringIndexer(inputCols=names, outputCols=[f"idx__{i}" for i in range(len(names))],
                                handleInvalid="keep", stringOrderType="frequencyDesc").fit(df)
        df = indexer.transform(df)
        encoder = OneHotEncoder(inputCols=[f"idx__{i}" for i in range(len(names))],
                                outputCols=[f"hot__{i}" for i in range(len(names))], dropLast=True).fit(df)
        stages += [folder, indexer, encoder]
        parts += [f"hot__{i}" for i in range(len(names))]
    stages.append(VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="keep"))
    return PipelineModel(stages)


def working_columns(df: DataFrame) -> list[str]:
    """Columns the stages add on the way to the vector."""
    made = ("num__", "fill__", "cat__", "idx__", "hot__")
    return [c for c in df.columns if c.startswith(made) or c in ("_numbers", "_scaled") or c.endswith(tuple(f"__{p}" for p in PARTS))]
