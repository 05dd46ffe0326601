import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulario.models import features as FT
from tabulario.models import forecast as FC
from tabulario.models import scoring
from tabulario.models import supervised as SV
from tabulario.models import unsupervised as U
from tabulario.operators import profile as P

QUICK = SV.Settings(folds=3, trees=10, forest_depth=4, rounds=5, repeats=2)


@pytest.fixture(scope="module")
def sales(spark):
    rng = np.random.default_rng(3)
    n = 600
    x, seg = rng.normal(size=n), rng.choice(["n", "s", "e"], n)
    pdf = pd.DataFrame({
        "gasto": x, "seg": seg, "ruido": rng.normal(size=n), "objetivo": 3 * x + (seg == "n") * 2 + rng.normal(scale=0.3, size=n),
        "monto_texto": [f"$ {v:,.2f}" for v in 1000 + 100 * x], "fecha": pd.date_range("2024-01-01", periods=n).strftime("%d/%m/%Y")})
    pdf["clase"] = np.where(x + 0.2 * rng.normal(size=n) > 0, "alto", "bajo")
    pdf["azar"] = rng.normal(size=n)
    return spark.createDataFrame(pdf)


def test_regression_beats_baseline_and_ranks_features(sales):
    df = sales.select("gasto", "seg", "ruido", "objetivo")
    r = SV.run_supervised(df, P.profile(df), "objetivo", QUICK, ["Regresión Ridge"])
    assert r.ok and r.metrics["r2"] > 0.9 and r.verdict == "claro" and abs(r.baseline["r2"]) < 0.1
    top = SV.permutation_importance(r, QUICK).collect()
    assert top[0]["variable"] == "gasto" and top[0]["importancia"] > 0.5


def test_noise_does_not_beat_the_baseline(sales):
    df = sales.select("seg", "ruido", "azar")
    r = SV.run_supervised(df, P.profile(df), "azar", QUICK, ["Regresión Ridge"])
    assert r.ok and not r.beats_baseline and r.verdict == "no_supera"


def test_leaks_are_found(sales):
    df = sales.select("gasto", "objetivo").withColumn("copia", F.col("objetivo") * 1.16)
    r = SV.run_supervised(df, P.profile(df), "objetivo", QUICK, ["Regresión Ridge"])
    assert r.leaks == ["copia"] and r.verdict == "fuga"
    derived = sales.select("clase", "ruido", "seg").withColumn("derivada", F.concat("clase", F.lit("-"), F.pmod(F.hash("ruido"), F.lit(9))))
    found = FT.detect_leakage(derived, "clase", FT.usable_features(P.profile(derived), "clase"), FT.CLASSIFICATION)
    assert [x["column"] for x in found.collect()] == ["derivada"]


def test_classification_with_all_candidates_then_save_and_score(spark, sales, tmp_path):
    df = sales.select("monto_texto", "seg", "fecha", "ruido", "clase")
    r = SV.run_supervised(df, P.profile(df), "clase", QUICK)
    assert set(r.candidates) == {"Regresión logística", "Random Forest", "Gradient Boosting"}
    assert r.ok and r.metrics["exactitud_balanceada"] > 0.8 and r.metrics["roc_auc"] > 0.85 and r.features.dates == ("fecha",)
    scoring.save_model(r, str(tmp_path / "m"), spark, "pruebas")
    saved = scoring.load_model(str(tmp_path / "m"), spark)
    fresh = df.drop("clase").withColumn("extra", F.lit(1))
    out, notes = scoring.score(saved, fresh)
    assert out.columns == [*fresh.columns, "_prediccion", "_confianza", "_prob_bajo"] and len(notes) == 1
    hits = out.join(df, ["monto_texto", "seg", "fecha", "ruido"]).where(F.col("_prediccion") == F.col("clase")).count()
    assert hits / df.count() > 0.8
    with pytest.raises(ValueError, match="seg"):
        scoring.score(saved, fresh.drop("seg"))


def test_too_few_rows_are_refused(spark, sales):
    df = sales.limit(10)
    assert not SV.run_supervised(df, P.profile(df), "clase", QUICK).ok
    one = sales.select("ruido").withColumn("clase", F.when(F.col("ruido").isNotNull(), "a"))
    assert not SV.run_supervised(one, P.profile(one), "clase", QUICK).ok


def test_split_is_exact_within_classes(sales):
    placed = SV.split(sales.select("clase", "ruido"), F.col("clase"), SV.Settings(folds=4))
    for r in placed.groupBy("clase").agg(F.count("*").alias("n"), F.count_if("_train").alias("t"), F.count_distinct("_fold").alias("f")).collect():
        assert abs(r["t"] - 0.75 * r["n"]) <= 1 and r["f"] == 4


def test_clusters_and_anomalies(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(np.vstack([rng.normal(c, 0.3, (120, 2)) for c in (0, 6)]), columns=["a", "b"])
    pdf.loc[len(pdf)] = [40.0, -40.0]
    pdf["i"] = [f"K{j}" for j in range(len(pdf))]
    df = spark.createDataFrame(pdf)
    profiles = P.profile(df)
    rare = U.run_anomalies(df, profiles, 0.01, trees=40)
    assert rare.ok and rare.rows.head()["i"] == "K240" and rare.n <= 3
    seg = U.run_clustering(df.where("a < 20"), profiles, seed=1)
    assert seg.ok and seg.k == 2 and seg.verdict == "claro" and sorted(r["registros"] for r in seg.summary.collect()) == [120, 120]


def test_forecast_follows_trend_and_season(spark):
    months = pd.date_range("2018-01-01", periods=48, freq="MS")
    value = 100 + 2 * np.arange(48) + 30 * np.sin(2 * np.pi * np.arange(48) / 12)
    df = spark.createDataFrame(pd.DataFrame({"f": months.strftime("%Y-%m-%d"), "v": value, "g": "x"}))
    out = FC.forecast(FC.monthly_series(df, "f", "v", ["g"])).toPandas()
    future = out[out.tipo == "futuro"].sort_values("month")
    real = 100 + 2 * np.arange(48, 54) + 30 * np.sin(2 * np.pi * np.arange(48, 54) / 12)
    assert out.beats.all() and out.mape.max() < 0.05 and np.abs(future.value.to_numpy() / real - 1).max() < 0.1
    short = FC.forecast(FC.monthly_series(df.limit(5), "f", "v")).collect()
    assert [r["tipo"] for r in short] == ["corta"]


def test_segments_leave_input_columns_alone(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame(np.vstack([rng.normal(c, 0.2, (60, 2)) for c in (0, 5)]), columns=["a", "b"])
    pdf["segmento_kmeans"], pdf["segmento"] = np.where(pdf.index < 60, "x", "y"), "s"
    df = spark.createDataFrame(pdf)
    seg = U.run_clustering(df, P.profile(df), k=2, seed=1)
    assert seg.rows.columns == [*df.columns, "segmento_kmeans_"]
    found = {r["segmento_kmeans"]: r["registros"] for r in seg.summary.collect()}
    assert found == {"x": 60, "y": 60} and seg.summary.columns[0] == "segmento_kmeans_"


def test_trees_are_bounded_with_many_equal_rows(spark):
    vectors = spark.range(20_000).select(
        F.array(F.when(F.col("id") < 19_600, 1.0).otherwise(F.col("id") / 1000.0), F.lit(2.0)).alias("_v"), F.col("id").alias("_n"))
    forest = U.grow_forest(vectors, 20_000, 50, 1).persist()
    nodes = forest.groupBy("tree").agg(F.count("*").alias("n"), F.max("depth").alias("d")).collect()
    assert len(nodes) == 50 and all(r["n"] <= 2 * U.SAMPLE - 1 and r["d"] > 0 for r in nodes)
    scored = U.score_forest(vectors, forest)
    assert "Python" not in scored._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    rare = scored.orderBy("score").limit(300).collect()
    assert all(r["_n"] >= 19_600 for r in rare)


def test_series_with_missing_and_odd_keys_stay_apart(spark):
    rows = [("2024-01-01", "a", None, 1.0), ("2024-01-02", None, "a", 2.0), ("2024-01-03", "a | b", "c", 4.0), ("2024-01-04", "a", "b | c", 8.0), ("2024-01-05", None, None, 16.0)]
    got = FC.monthly_series(spark.createDataFrame(rows, "f string, g string, h string, v double"), "f", "v", ["g", "h"]).collect()
    assert sorted(r["value"] for r in got) == [1, 2, 4, 8, 16] and len({r["serie"] for r in got}) == 5


def test_many_classes_are_no_reason_to_refuse(spark):
    df = spark.range(12_000).select((F.col("id") % 1200).cast("string").alias("clase"), (F.col("id") % 1200 + F.rand(1)).alias("x"), F.rand(2).alias("y"))
    counted = FT.class_counts(df, "clase")
    assert counted.count() == 1200
    one = SV.split(df.withColumn("x", F.lit(1.0)).withColumn("y", F.lit(1.0)).withColumn("clase", F.lit("a")), F.col("clase"), SV.Settings())
    assert abs(one.where("_train").count() - 9000) <= 1  # copies of one row are shared out too


def test_scores_equal_a_walk_by_hand(spark):
    vectors = spark.range(400).select(F.array(F.sqrt("id"), (F.col("id") % 17).cast("double"), F.rand(4)).alias("_v"), F.col("id").alias("_n")).persist()
    forest = U.grow_forest(vectors, 400, 20, 3).persist()
    trees = {}
    for r in forest.collect():
        trees.setdefault(r["tree"], {})[r["node"]] = r
    for row in U.score_forest(vectors, forest).orderBy("_n").limit(25).collect():
        depth = 0.0
        for t in trees.values():
            at = t[0]
            while at["feature"] >= 0:
                at = t[at["left"] if row["_v"][at["feature"]] < at["cut"] else at["right"]]
            depth += at["depth"]
        assert abs(row["score"] + 2 ** (-depth / len(trees) / U._path_correction(U.SAMPLE))) < 1e-12


def test_silhouettes_equal_all_pairs(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(c, 0.6, (30, 3)) for c in (0, 5, 10)])
    df = spark.createDataFrame([(v.tolist(),) for v in x], "_v array<double>").repartition(3)
    centres = U.fit_clusters(df, [2, 3, 5], 1)
    found = U.silhouettes(df, centres)
    for k, c in centres.items():
        label = U.nearest_centre(x, c)
        assert all(np.allclose(x[label == j].mean(0), c[j], atol=1e-3) for j in np.unique(label))
        far = ((x[:, None] - x[None]) ** 2).sum(2)
        widths = []
        for i in range(len(x)):
            own = (label == label[i]).sum() - 1
            inside = far[i][label == label[i]].sum() / max(own, 1)
            other = min(far[i][label == j].mean() for j in np.unique(label) if j != label[i])
            widths.append((other - inside) / max(inside, other) if own else 0.0)
        assert abs(found[k] - np.mean(widths)) < 1e-9
    assert max(found, key=found.get) == 3


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 101, 1000, 4097])
def test_shuffled_places_are_a_permutation(spark, n):
    df = spark.range(n).withColumn("rep", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    got = df.select("rep", "id", SV.shuffled(F.col("id"), n, F.lit(5), F.col("rep")).alias("to")).toPandas()
    for _, part in got.groupby("rep"):
        assert sorted(part["to"]) == list(range(n))
    if n > 100:
        assert (got["id"] == got["to"]).mean() < 0.1 and abs(np.corrcoef(got["id"], got["to"])[0, 1]) < 0.2
        wide = got.pivot(index="id", columns="rep", values="to")
        assert (wide[0] == wide[1]).mean() < 0.1


def test_rows_are_numbered_without_gaps(spark):
    df, n = SV.numbered(spark.range(1000).repartition(7).where("id % 3 > 0"), "place")
    assert n == 666 and sorted(r["place"] for r in df.collect()) == list(range(666))


def test_depths_of_a_batch():
    split = (np.array([1, 0, 0]), np.array([2.5, np.nan, np.nan]), np.array([1, 1, 2]), np.array([0.0, 1.0, 4.0]))
    alone = (np.array([0]), np.array([np.nan]), np.array([0]), np.array([7.0]))
    x = np.array([[0.0, 2.4], [np.inf, 2.5], [9.0, np.nan], [0.0, np.inf], [np.nan, -np.inf]])
    assert U.leaf_depths(x, [split, alone]).tolist() == [8.0, 11.0, 11.0, 11.0, 8.0]


def test_rows_alike_grow_the_same_tree_and_are_asked_for_once():
    from tabulario.models import trees as T
    rng = np.random.default_rng(0)
    n = 5_000
    bins = np.c_[rng.integers(0, 9, n), rng.integers(0, 3, n)].astype(np.uint8)
    y, fold, none = bins[:, 0] * 2.0 + rng.normal(size=n), rng.integers(0, 5, n), np.zeros(n, np.int64)
    some, group, count, weight, amount = T.alike(bins, none, fold, 5, np.ones(n), y - y.mean())
    assert len(some) == 27 and count.sum() == n and np.allclose(count.sum(0), np.bincount(fold))
    plain, at = T.grow(bins, np.ones(n), y - y.mean(), none, 1, 6, 2, 2, np.random.default_rng(1))
    merged, _ = T.grow(some, weight.sum(1), amount.sum(1), group, 1, 6, 2, 2, np.random.default_rng(1), count.sum(1))
    assert (plain.feature, plain.cut, plain.child) == (merged.feature, merged.cut, merged.child)
    total = np.bincount(at)
    entries = T.leaves(len(plain.feature), at, none, y / total[at], 1)
    arrays = [np.array(a) for a in (plain.feature, plain.cut, plain.child)]
    model = T.Trees([np.arange(8.0), np.arange(2.0)], 1, np.zeros(1), np.array([0]), *arrays, *[entries[k] for k in ("start", "size", "slot", "share")])
    asked = []
    whole = model.outcome
    model.outcome = lambda b: (asked.append(len(b)), whole(b))[1]
    predict, x = model.remembering(), bins.astype(float)
    assert all((predict(part) == whole(model.bins(part))).all() for part in (x, x[:70], x[::3]))
    assert asked == [27]


def test_batches_score_as_column_functions_do(spark):
    vectors = spark.range(400).select(F.array(F.sqrt("id"), (F.col("id") % 17).cast("double"), F.rand(4)).alias("_v"), F.col("id").alias("_n")).persist()
    forest = U.grow_forest(vectors, 400, 20, 3).persist()
    both = U.score_batches(U.score_forest(vectors, forest, "a"), forest, "b")
    assert both.where("abs(a - b) > 1e-12 or b is null").isEmpty()


@pytest.mark.parametrize("classes", [0, 2])
def test_every_row_is_learned_from_however_many(spark, classes):
    """A split that needs 110 000 rows on each side, and the mean a boosted model starts from, take all 260 000 rows."""
    from pyspark.ml.functions import array_to_vector

    from tabulario.models import trees as T
    n = 260_000
    half = (F.col("id") % 2).cast("double")
    label = half if classes else half * 10 + F.col("id") % 7
    ready = spark.range(n).select(array_to_vector(F.array(half)).alias("features"), label.alias("label"), F.lit(1.0).alias("_w"), F.lit(0).alias("_fold"))
    grower = T.Grower(ready, classes, 2, T.Effort(trees=3, depth=2, rounds=2, boost_depth=1, leaf=110_000))
    forest = grower.model(grower.forest(), 2, False)
    assert len(forest.root) == 3 and (forest.feature[forest.root] == 0).all() and len(forest.feature) == 9
    boosted = grower.model(grower.boosted(), 2, True)
    mean = ready.agg(F.avg("label")).head()[0]
    assert boosted.base[0] == pytest.approx(np.log(mean / (1 - mean)) if classes else mean, abs=1e-12)
    assert len(boosted.feature) == 6
    i = np.arange(n)
    want = [0.0, 1.0] if classes else [(i % 7)[i % 2 == h].mean() + 10 * h for h in (0, 1)]
    got = forest.predict(np.array([[0.0], [1.0]]))
    assert (got[:, 1] if classes else got[:, 0]) == pytest.approx(want, abs=0.05)
