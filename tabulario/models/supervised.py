"""Supervised learning with guards: leakage check, baseline, cross-validated choice, honest verdict."""
from __future__ import annotations

import math
from dataclasses import dataclass, field
from statistics import fmean, pstdev

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulario.functions.text import as_category
from tabulario.models import evaluate as M
from tabulario.models.features import CLASSIFICATION, Features, class_counts, detect_leakage, infer_task, usable_features
from tabulario.models.prepare import fit_features, working_columns
from tabulario.models.trees import Effort, Grower, TreeModel
from tabulario.operators import quantiles as Q
from tabulario.operators.intake import col, number, present, rows
from tabulario.operators.profile import Profiles
from tabulario.session import materialize


@dataclass(frozen=True)
class Settings:
    """Effort and seed of a training run. Every model learns from all rows."""

    test_share: float = 0.25
    seed: int = 42
    folds: int = 5
    trees: int = 250
    forest_depth: int = 12
    rounds: int = 100
    parallelism: int = 5
    repeats: int = 8


@dataclass
class Report:
    """Result of a training run. `ok` is false when the data were refused, with the reason in `headline`."""

    task: str
    ok: bool
    headline: str
    metrics: dict[str, float] = field(default_factory=dict)
    baseline: dict[str, float] = field(default_factory=dict)
    candidates: dict[str, tuple[float, float]] = field(default_factory=dict)
    verdict: str = ""
    beats_baseline: bool | None = None
    warnings: list[str] = field(default_factory=list)
    leaks: list[str] = field(default_factory=list)
    features: Features | None = None
    classes: list[str] = field(default_factory=list)
    target: str | None = None
    model: PipelineModel | None = None
    predictions: DataFrame | None = None

    def frame(self, df: DataFrame) -> DataFrame:
        """(metrica, valor, baseline)."""
        return rows(df.sparkSession, [(k, float(v), self.baseline.get(k)) for k, v in self.metrics.items()],
                    "metrica string, valor double, baseline double")


def split(df: DataFrame, stratum: Column | None, settings: Settings) -> DataFrame:
    """Add `_train` and `_fold`: a seeded split with exact shares within each class (or overall), and folds of the training rows.

    Rows are placed by a hash of all their values and their position, so that many copies of a row are
    shared out like others. The cuts are exact quantiles of that hash per class; nothing is sorted in one place.
    """
    numbered = materialize(df.withColumn("_row", F.monotonically_increasing_id()))
    hashed = numbered.withColumns({
        "_class": F.lit("") if stratum is None else stratum,
        "_h": F.pmod(F.xxhash64(F.lit(settings.seed), *[col(c) for c in numbered.columns]), F.lit(2 ** 40)).cast("double"),
    }).drop("_row")
    share = 1.0 - settings.test_share
    probs = {f"_q{i}": share * i / settings.folds for i in range(1, settings.folds + 1)}
    if stratum is None:
        placed = hashed.withColumns({q: F.lit(cut) for q, cut in zip(probs, Q.quantiles(hashed, "_h", list(probs.values())))})
    else:
        placed = hashed.join(Q.grouped_quantiles(hashed, ["_class"], "_h", probs), "_class")
    fold = sum((F.when(F.col("_h") > F.col(f"_q{i}"), 1).otherwise(0) for i in range(1, settings.folds)), F.lit(0))
    last = F.col(f"_q{settings.folds}")
    return placed.withColumns({"_train": F.col("_h") <= last, "_fold": fold.cast("int")}).drop(*probs, "_h")


LINEAR = {CLASSIFICATION: "Regresión logística"}
FOREST, BOOSTED = "Random Forest", "Gradient Boosting"


def _linear(task: str):
    if task == CLASSIFICATION:
        return LogisticRegression(labelCol="label", weightCol="_w", maxIter=100, regParam=0.001)
    return LinearRegression(labelCol="label", elasticNetParam=0.0, regParam=1e-4)


def _fitted(ready: DataFrame, task: str, classes: int, evaluator, s: Settings, wanted: list[str] | None) -> dict[str, tuple]:
    """Per candidate the mean and spread of its scores over the folds, and the stage fitted on all rows."""
    linear = LINEAR.get(task, "Regresión Ridge")
    out = {}
    if wanted is None or linear in wanted:
        cv = CrossValidator(estimator=_linear(task), estimatorParamMaps=[{}], evaluator=evaluator, numFolds=s.folds,
                            foldCol="_fold", parallelism=s.parallelism).fit(ready)
        out[linear] = float(cv.avgMetrics[0]), float(cv.stdMetrics[0]), cv.bestModel
    trees = [name for name in (FOREST, BOOSTED) if wanted is None or name in wanted]
    if trees:
        effort = Effort(trees=s.trees, depth=s.forest_depth, rounds=s.rounds, seed=s.seed)
        grower = Grower(ready, classes, s.folds, effort)
        for name in trees:
            grown = grower.boosted() if name == BOOSTED else grower.forest()
            stage = lambda fit: TreeModel(trees=grower.model(grown, fit, name == BOOSTED).dump())  # noqa: B023,E731
            scores = [evaluator.evaluate(stage(j).transform(ready.where(F.col("_fold") == j))) for j in range(s.folds)]
            out[name] = fmean(scores), pstdev(scores), stage(s.folds)
    return out


def run_supervised(df: DataFrame, profiles: Profiles, target: str, settings: Settings | None = None,
                   candidates: list[str] | None = None) -> Report:
    """Train the candidates, keep the best by cross-validation, and judge it against a baseline on held-out rows."""
    s = settings or Settings()
    data = df.where(present(df, target))
    n = profiles[target].n_present
    if n < 30:
        return Report(CLASSIFICATION, False, f"hacen falta 30 registros con objetivo; hay {n}", target=target)
    task = infer_task(df, target, profiles[target].n_unique)
    features = usable_features(profiles, target)
    if not features.columns:
        return Report(task, False, "ninguna columna sirve para predecir", target=target, features=features)
    warnings = [f"{c}: {why}" for c, why in features.excluded]
    classes: list[str] = []
    folds = s.folds
    if task == CLASSIFICATION:
        usable = class_counts(data, target)
        rare = usable.where("not usable").count()
        if rare:
            data = data.join(usable.where("usable").select("y"), as_category(col(target)) == F.col("y"), "left_semi")
            warnings.append(f"{rare} clases con menos de 5 casos quedaron fuera")
        kept_classes = usable.where("usable")
        k, n, least, most = kept_classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.min("n"), F.max("n")).head()
        if k < 2:
            return Report(task, False, "el objetivo tiene una sola clase utilizable", target=target, features=features)
        if most / n > 0.9:
            warnings.append("una clase reúne más del 90 % de los casos")
        folds = max(2, min(s.folds, int(least * (1 - s.test_share))))
        weights = kept_classes.select(F.col("y").alias("_y"), (F.lit(float(n)) / (F.lit(k) * F.col("n"))).alias("_w"))
        data = data.withColumn("_y", as_category(col(target))).join(weights, "_y")
        stratum = F.col("_y")
    else:
        data = data.withColumns({"label": number(df, target), "_w": F.lit(1.0)}).where("label is not null")
        stratum = None
    if n < 200:
        warnings.append(f"solo {n} registros: cualquier métrica es tentativa")
    leaks = detect_leakage(data, target, features, task).collect()
    kept = data.select(*[col(c) for c in dict.fromkeys([*features.columns, target, "_w", "_y" if task == CLASSIFICATION else "label"])])
    s = Settings(**{**s.__dict__, "folds": folds})
    # every fit reads these rows again, so they are written once
    placed = materialize(split(kept, stratum, s))
    train, test = placed.where("_train"), placed.where("not _train")
    prepare = fit_features(train, features)
    labeller = None
    if task == CLASSIFICATION:
        labeller = StringIndexer(inputCol="_y", outputCol="label", stringOrderType="alphabetAsc").fit(train)
        classes = list(labeller.labels)
        train, test = labeller.transform(train), labeller.transform(test)
    ready = prepare.transform(train).select("features", "label", "_w", "_fold").persist()
    evaluator = (
        # recall weighted so that every class counts the same is balanced accuracy
        MulticlassClassificationEvaluator(labelCol="label", weightCol="_w", metricName="weightedRecall")
        if task == CLASSIFICATION else RegressionEvaluator(labelCol="label", metricName="r2"))
    found = _fitted(ready, task, len(classes), evaluator, s, candidates)
    ready.unpersist()
    scores = {name: (mean, spread) for name, (mean, spread, _) in found.items()}
    best = max(scores, key=lambda k: scores[k][0])
    mean, spread = scores[best]
    if mean > 0 and spread > 0.5 * abs(mean):
        warnings.append("el desempeño cambia mucho entre particiones")
    stages = [*prepare.stages, found[best][2]]
    if task == CLASSIFICATION:
        stages.append(IndexToString(inputCol="prediction", outputCol="_prediccion", labels=classes))
    model = PipelineModel(stages)
    # the metrics and the report read them again, so they are written once
    predicted = materialize(model.transform(test).drop("features"))
    report = Report(task, True, best, candidates=scores, warnings=warnings, features=features, classes=classes,
                    target=target, model=model, leaks=[r["column"] for r in leaks])
    if task == CLASSIFICATION:
        _judge_classes(report, predicted, train)
    else:
        _judge_numbers(report, predicted, train)
    report.predictions = predicted.drop(*working_columns(predicted))
    return report


def _finish(report: Report, score: float, base: float, df: DataFrame) -> None:
    row = rows(df.sparkSession, [(score, base, len(report.leaks))], "s double, b double, l int").select(
        M.verdict(report.task, F.col("s"), F.col("b"), F.col("l")).alias("v"), M.beats_baseline(report.task, F.col("s"), F.col("b")).alias("w")).head()
    report.verdict, report.beats_baseline = row["v"], row["w"]


def _judge_classes(report: Report, predicted: DataFrame, train: DataFrame) -> None:
    held = predicted.withColumn("_base", M.baseline_class(train, "_y"))
    names = ("exactitud", "exactitud_balanceada", "f1_macro")
    report.metrics = dict(zip(names, M.classification_metrics(M.confusion(held, "_y", "_prediccion")).select(*names).head()))
    report.baseline = dict(zip(names, M.classification_metrics(M.confusion(held, "_y", "_base")).select(*names).head()))
    if len(report.classes) == 2 and "rawPrediction" in predicted.columns:
        report.metrics["roc_auc"] = BinaryClassificationEvaluator(labelCol="label").evaluate(predicted)
    _finish(report, report.metrics["exactitud_balanceada"], report.baseline["exactitud_balanceada"], predicted)


def _judge_numbers(report: Report, predicted: DataFrame, train: DataFrame) -> None:
    held = predicted.withColumn("_base", M.baseline_mean(train, "label"))
    names = ("r2", "mae", "rmse", "mape")
    found = dict(zip(names, M.regression_metrics(held, "label", "prediction").select(*names).head()))
    report.metrics = {k: v for k, v in found.items() if v is not None}
    base = dict(zip(names, M.regression_metrics(held, "label", "_base").select(*names).head()))
    report.baseline = {k: base[k] for k in ("r2", "mae", "rmse")}
    _finish(report, report.metrics["r2"], report.baseline["r2"], predicted)


# --- permutation importance --------------------------------------------------------------

MIXES, WALKS = 5, 16


def shuffled(place: Column, n: int, *key: Column) -> Column:
    """Where the row at `place` of n goes: for each key one permutation of 0 to n - 1, without sorting.

    A place is a pair of coordinates in a rectangle of a rows and b columns, a * b < n + a; rounds of hashes turn each
    coordinate by what the other says, which can be undone. What falls beyond n walks on; that takes a place past WALKS
    steps with probability below n^(-WALKS / 2).
    """
    a = math.isqrt(max(n - 1, 0)) + 1
    b = max(1, -(-n // a))
    turn = lambda x, size, *by: F.pmod(x + F.pmod(F.xxhash64(*key, *by), F.lit(size)), F.lit(size)).cast("long")

    def once(x: Column) -> Column:
        start = F.struct(((x - F.pmod(x, F.lit(b))) / F.lit(b)).cast("long").alias("i"), F.pmod(x, F.lit(b)).cast("long").alias("j"))

        def mix(s: Column, k: Column) -> Column:
            i = turn(s["i"], a, F.lit("i"), k, s["j"])
            return F.struct(i.alias("i"), turn(s["j"], b, F.lit("j"), k, i).alias("j"))

        return F.aggregate(F.array(*map(F.lit, range(MIXES))), start, mix, lambda s: s["i"] * F.lit(b) + s["j"])

    return F.aggregate(F.array(*map(F.lit, range(WALKS))), once(place.cast("long")), lambda x, _: F.when(x >= n, once(x)).otherwise(x))


def numbered(df: DataFrame, into: str) -> tuple[DataFrame, int]:
    """`df` written down with the numbers 0 to n - 1 in `into`, and n; partitions are numbered where they lie."""
    kept = materialize(df).withColumn("_m", F.monotonically_increasing_id())
    held = kept.groupBy(F.shiftright("_m", 33).alias("_p")).count().orderBy("_p").collect()  # a row per partition
    starts, total = [], 0
    for r in held:
        starts.append((r["_p"], total))
        total += r["count"]
    offsets = F.broadcast(rows(df.sparkSession, starts, "_p long, _start long"))
    out = kept.withColumn("_p", F.shiftright("_m", 33)).join(offsets, "_p").withColumn(
        into, F.col("_start") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    return out.drop("_m", "_p", "_start"), total


def permutation_importance(report: Report, settings: Settings | None = None, top: int = 15) -> DataFrame:
    """(variable, importancia): loss of score when a column's values are dealt out among the rows anew.

    Every repeat is one permutation of the held-out rows, computed from their numbers: each row meets its donor by one
    join, and one column at a time takes the donor's value. All columns and repeats go through the model in one pass.
    """
    s = settings or Settings()
    features = report.features
    outcome = ["label", *(["_y"] if report.task == CLASSIFICATION else [])]
    test, n = numbered(report.predictions.select(*[col(c) for c in dict.fromkeys([*features.columns, *outcome])]), "_place")
    donors = test.select(F.col("_place").alias("_from"), F.struct(*[col(c) for c in features.columns]).alias("_d"))
    repeated = test.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(s.repeats - 1))))
    paired = repeated.withColumn("_from", shuffled(F.col("_place"), n, F.lit(s.seed), F.col("rep"))).join(donors, "_from").select(
        "*", F.explode(F.array(*map(F.lit, features.columns))).alias("variable"))
    swapped = paired.withColumns({
        c: F.when(F.col("variable") == c, F.col("_d").getField(c)).otherwise(col(c)) for c in features.columns})
    scored = report.model.transform(swapped)
    by = ["variable", "rep"]
    if report.task == CLASSIFICATION:
        per = M.classification_metrics(M.confusion(scored, "_y", "_prediccion", by), by).withColumnRenamed("exactitud_balanceada", "score")
        base = report.metrics["exactitud_balanceada"]
    else:
        per = M.regression_metrics(scored, "label", "prediction", by).withColumnRenamed("r2", "score")
        base = report.metrics["r2"]
    return per.groupBy("variable").agg((F.lit(base) - F.avg("score")).alias("importancia")).orderBy(
        F.desc("importancia"), "variable").limit(top)
