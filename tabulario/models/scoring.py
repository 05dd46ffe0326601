"""Save a trained model with what is needed to use it, load it, and score new data."""
from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulario.models.features import CLASSIFICATION
from tabulario.models.prepare import working_columns
from tabulario.models.supervised import Report


@dataclass
class SavedModel:
    model: PipelineModel
    task: str
    target: str
    features: list[str]
    classes: list[str]
    metrics: dict[str, float]
    baseline: dict[str, float]
    beats_baseline: bool
    source: str


def save_model(report: Report, path: str, spark: SparkSession, source: str = "") -> None:
    """Write the pipeline and a one-row description under `path`, which may be on any file system Spark reaches."""
    report.model.write().overwrite().save(f"{path}/pipeline")
    about = {
        "task": report.task, "target": report.target, "features": report.features.columns, "classes": report.classes,
        "metrics": report.metrics, "baseline": report.baseline, "beats_baseline": bool(report.beats_baseline), "source": source,
    }
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def load_model(path: str, spark: SparkSession) -> SavedModel:
    about = json.loads(spark.read.parquet(f"{path}/about").head()[0])
    return SavedModel(PipelineModel.load(f"{path}/pipeline"), **about)


def score(saved: SavedModel, df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows with `_prediccion` and, for classes with probabilities, `_confianza` and `_prob_<class>`; and notes.

    Missing columns are refused; extra ones pass through unused. Works on streams too, row by row.
    """
    missing = [c for c in saved.features if c not in df.columns]
    if missing:
        raise ValueError("faltan columnas que el modelo necesita: " + ", ".join(missing))
    extra = [c for c in df.columns if c not in saved.features]
    out = saved.model.transform(df)
    keep = list(df.columns)
    if saved.task == CLASSIFICATION:
        keep.append("_prediccion")
        if "probability" in out.columns:
            p = vector_to_array("probability")
            out = out.withColumn("_confianza", F.array_max(p))
            keep.append("_confianza")
            if len(saved.classes) == 2:
                out = out.withColumn(f"_prob_{saved.classes[1]}", p[1])
                keep.append(f"_prob_{saved.classes[1]}")
    else:
        out = out.withColumnRenamed("prediction", "_prediccion")
        keep.append("_prediccion")
    out = out.drop(*[c for c in working_columns(out) if c not in df.columns]).select(*keep)
    return out, [f"{len(extra)} columnas no se usan"] if extra else []
