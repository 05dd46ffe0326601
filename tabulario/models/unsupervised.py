"""Segments by k-means and rare rows by an isolation forest."""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from tabulario.models.features import usable_features
from tabulario.models.prepare import fit_features
from tabulario.operators import quantiles as Q
from tabulario.operators.intake import col, number, present
from tabulario.operators.profile import Profiles
from tabulario.session import materialize


#: Name of the label column of segments.
SEGMENT = "segmento_kmeans"


@dataclass
class Segments:
    """Rows with their segment, the segment profiles and the silhouette of each number of segments tried."""

    ok: bool
    headline: str
    k: int = 0
    silhouettes: dict[int, float] | None = None
    rows: DataFrame | None = None
    summary: DataFrame | None = None
    verdict: str = ""


SEEDS = 2_000  # vectors that the first centres are chosen from
ROUNDS = 50
STILL = 1e-4  # a centre that moves less, in standard deviations, stands still


def first_centres(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of the sampled vectors, each next one drawn in proportion to its squared distance from those before."""
    picked = [sample[rng.integers(len(sample))]]
    far = ((sample - picked[0]) ** 2).sum(1)
    while len(picked) < k and far.sum() > 0:
        picked.append(sample[rng.choice(len(sample), p=far / far.sum())])
        far = np.minimum(far, ((sample - picked[-1]) ** 2).sum(1))
    return np.array(picked)


def settled(sample: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centres after rounds over the sampled vectors alone, so that fewer rounds over all vectors are left."""
    for _ in range(ROUNDS):
        label = nearest_centre(sample, centres)
        new = np.array([sample[label == j].mean(0) if (label == j).any() else c for j, c in enumerate(centres)])
        still = np.abs(new - centres).max() <= STILL
        centres = new
        if still:
            break
    return centres


def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The vectors of each batch as the rows of a matrix, without a Python object per row."""
    for batch in batches:
        if batch.num_rows:
            yield batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (((centres * centres).sum(1) - 2 * x @ centres.T)).argmin(1)


def cluster_sums(vectors: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per number of clusters: rows, sums and sums of squared lengths of every cluster, for all of them in one pass.

    Each task sends one row per cluster; they are summed by element, so what is shuffled depends on the clusters alone.
    """
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for x in matrices(batches):
            row = np.concatenate([np.ones((len(x), 1)), (x * x).sum(1, keepdims=True), x], 1)
            for k, c in centres.items():
                member = np.zeros((len(x), len(c)))
                member[np.arange(len(x)), nearest_centre(x, c)] = 1.0
                held[k] = held.get(k, 0.0) + member.T @ row
        found = [(k, j, v) for k, s in held.items() for j, v in enumerate(s.tolist()) if v[0]]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], ["k", "j", "s"])

    kinds = [pa.int32(), pa.int32(), pa.list_(pa.float64())]
    parts = vectors.select("_v").mapInArrow(summed, "k int, j int, s array<double>").select("k", "j", F.posexplode("s").alias("i", "x"))
    whole = parts.groupBy("k", "j", "i").agg(F.sum("x").alias("x")).groupBy("k", "j").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
    out = {k: (np.zeros(len(c)), np.zeros_like(c), np.zeros(len(c))) for k, c in centres.items()}
    for r in whole.collect():  # a row per cluster
        s = np.array([p["x"] for p in r["s"]])
        n, sums, squares = out[r["k"]]
        n[r["j"]], squares[r["j"]], sums[r["j"]] = s[0], s[1], s[2:]
    return out


def fit_clusters(vectors: DataFrame, ks: list[int], seed: int) -> dict[int, np.ndarray]:
    """Centres for every number of clusters in `ks`. A round moves the centres of all that still move, by one job."""
    sample = np.array([r[0] for r in vectors.select("_v").orderBy(F.xxhash64(F.lit(seed), "_v"), "_v").limit(SEEDS).collect()])
    centres = {k: settled(sample, first_centres(sample, k, np.random.default_rng((seed, k)))) for k in ks}
    moving = dict(centres)
    for _ in range(ROUNDS):
        for k, (n, sums, _) in cluster_sums(vectors, moving).items():
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres[k])
            if np.abs(new - centres[k]).max() <= STILL:
                moving.pop(k)
            else:
                moving[k] = new
            centres[k] = new
        if not moving:
            break
    return centres


def silhouettes(vectors: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, float]:
    """Mean silhouette by squared Euclidean distance for every number of clusters; two passes for all of them.

    The mean squared distance of a row to a cluster follows from the cluster's size, sum and sum of squared lengths.
    """
    sums = cluster_sums(vectors, centres)
    ks = [k for k in centres if (sums[k][0] > 0).sum() > 1]

    def widths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = dict.fromkeys(ks, 0.0)
        for x in matrices(batches):
            length = (x * x).sum(1, keepdims=True)
            for k in ks:
                n, s, q = sums[k]
                full = np.flatnonzero(n > 0)
                label = nearest_centre(x, centres[k])
                own = np.searchsorted(full, label)
                n, s, q = n[full], s[full], q[full]
                far = np.maximum(length * n - 2 * x @ s.T + q, 0)  # summed over the cluster's rows
                rows = np.arange(len(x))
                inside = far[rows, own] / np.maximum(n[own] - 1, 1)
                far = far / n
                far[rows, own] = np.inf
                other = far.min(1)
                top = np.maximum(inside, other)
                total[k] += float(np.where((n[own] > 1) & (top > 0), (other - inside) / np.maximum(top, 1e-300), 0.0).sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.float64())], ["k", "s"])

    if not ks:
        return {}
    n = sum(sums[ks[0]][0])
    return {r["k"]: r["s"] / n for r in vectors.select("_v").mapInArrow(widths, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()}


def run_clustering(df: DataFrame, profiles: Profiles, k: int | None = None, seed: int = 42) -> Segments:
    """Segments of the rows; without k, the best silhouette among 2 to 8 (squared Euclidean distance).

    The label column is `SEGMENT`, lengthened where the table has such a column; input columns stay as they are.
    """
    features = usable_features(profiles, with_dates=False)
    if len(features.columns) < 2:
        return Segments(False, "hacen falta al menos dos columnas utilizables")
    some = F.lit(False)
    for c in features.columns:
        some = some | present(df, c)
    data = df.where(some)
    n = data.count()
    if n < 20:
        return Segments(False, f"hacen falta 20 registros; hay {n}")
    # every round reads the vectors again, so they are written once
    ready = materialize(fit_features(data, features).transform(data).select(*[col(c) for c in df.columns], vector_to_array("features").alias("_v")))
    centres = fit_clusters(ready, [k] if k else list(range(2, min(9, max(3, n // 10)))), seed)
    tried = silhouettes(ready, centres)
    if not tried:
        return Segments(False, "no se formaron grupos distinguibles")
    best = max(tried, key=lambda kk: (tried[kk], -kk))
    label = SEGMENT
    while label.lower() in {c.lower() for c in df.columns}:
        label += "_"
    chosen = centres[best]

    @pandas_udf("int")
    def placed(v: pd.Series) -> pd.Series:
        return pd.Series(nearest_centre(np.stack(v.to_list()), chosen) + 1)

    out = ready.withColumn(label, F.concat(F.lit("Segmento "), placed("_v").cast("string"))).drop("_v")
    means = [F.avg(number(df, c)).alias(c) for c in features.numeric]
    first = features.categorical[0] if features.categorical else None
    mode = [F.mode(col(first), True).alias(first)] if first else []  # at most 50 values
    summary = out.groupBy(label).agg(F.count(F.lit(1)).alias("registros"), *means, *mode).orderBy(label)
    score = tried[best]
    verdict = "claro" if score >= 0.5 else "moderado" if score >= 0.25 else "sin_grupos"
    return Segments(True, f"{best} segmentos, silueta {score:.2f}", best, tried, out, summary, verdict)


SAMPLE = 256  # rows of one tree, as the method has it
_NODES = "tree int, node int, feature int, cut double, left int, right int, depth double"


def _path_correction(n: int) -> float:
    """Mean depth of an unsuccessful search in a random tree of n leaves."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def _grow(tree: int, points: np.ndarray, seed: int) -> list[tuple]:
    """One isolation tree over at most SAMPLE points, as node rows; leaves carry their depth."""
    rng = np.random.default_rng(seed * 100_003 + tree)
    limit = math.ceil(math.log2(max(len(points), 2)))
    nodes: list[list] = [[tree, 0, -1, 0.0, -1, -1, 0.0]]
    todo = [(0, points, 0)]
    while todo:
        at, here, depth = todo.pop()
        low, high = (here.min(axis=0), here.max(axis=0)) if len(here) else (np.zeros(1), np.zeros(1))
        able = np.flatnonzero(high > low)
        if depth >= limit or len(here) <= 1 or not len(able):
            nodes[at][6] = depth + _path_correction(len(here))
            continue
        f = int(rng.choice(able))
        cut = float(rng.uniform(low[f], high[f]))
        sides = here[:, f] < cut
        left, right = len(nodes), len(nodes) + 1
        nodes[at][2:6] = [f, cut, left, right]
        nodes += [[tree, left, -1, 0.0, -1, -1, 0.0], [tree, right, -1, 0.0, -1, -1, 0.0]]
        todo += [(left, here[sides], depth + 1), (right, here[~sides], depth + 1)]
    return [tuple(x) for x in nodes]


def grow_forest(vectors: DataFrame, n: int, trees: int, seed: int) -> DataFrame:
    """Node rows of every tree, from rows (`_v`, `_n`) whose number `_n` tells copies of a vector apart.

    A row serves as many trees as it takes for each tree to get somewhat over SAMPLE rows: the whole part
    of that number for certain, one more with the chance of its fraction. Which trees is drawn by a hash of
    the row's number, and each tree takes the first SAMPLE of its rows, so no group is larger.
    """
    drawn = lambda *parts: F.xxhash64(F.lit(seed), "_n", *parts)
    each = min(float(trees), 1.25 * SAMPLE * trees / n)
    more = F.pmod(drawn(F.lit("more")), F.lit(1 << 31)) < F.lit(int((each - int(each)) * (1 << 31)))
    uses = F.lit(int(each)) + more.cast("int")
    served = vectors.withColumn("_uses", uses).where("_uses > 0").select(
        "_v", "_n", F.explode(F.sequence(F.lit(1), F.col("_uses"))).alias("_use"))
    dealt = served.select("_v", F.pmod(drawn(F.col("_use")), F.lit(trees)).cast("int").alias("tree"), drawn(F.lit("rank"), F.col("_use")).alias("_h"))
    assigned = dealt.withColumn("_k", F.row_number().over(W.partitionBy("tree").orderBy("_h"))).where(F.col("_k") <= SAMPLE).select("tree", "_v")

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        points = np.stack(pdf["_v"].to_numpy())
        points = points[np.lexsort(points.T)]  # Spark gives rows of a group in no fixed order
        return pd.DataFrame(_grow(int(key[0]), points, seed), columns=[c.split()[0] for c in _NODES.split(", ")])

    return assigned.groupBy("tree").applyInPandas(grow, _NODES)


def leaf_depths(x: np.ndarray, forest: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """Sum over all trees of the depth at which each row of `x` ends."""
    total, flat = np.zeros(len(x)), np.where(np.isnan(x), np.inf, x).ravel()  # what is no number goes right
    first = np.arange(len(x)) * x.shape[1]
    for feature, cut, left, depth in forest:
        at = np.zeros(len(x), np.int64)
        for _ in range(math.ceil(math.log2(SAMPLE))):  # leaves lead to themselves: nothing reaches their cut
            at = left[at] + (flat[first + feature[at]] >= cut[at])
        total += depth[at]
    return total


def score_forest(vectors: DataFrame, nodes: DataFrame, column: str = "score") -> DataFrame:
    """Add the anomaly score of each row: nearer to -1 the rarer. The forest, at most trees * (2 * SAMPLE - 1) nodes, is one
    row of arrays that every row is walked through by column functions."""
    order = F.array_sort(F.collect_list(F.struct("node", "feature", "cut", "left", "depth")))
    packed = nodes.groupBy("tree").agg(order.alias("_t")).agg(F.array_agg(F.struct(
        *[F.col(f"_t.{f}").alias(f) for f in ("feature", "cut", "left", "depth")])).alias("_forest"))
    norm = _path_correction(SAMPLE)
    steps = F.array(*map(F.lit, range(math.ceil(math.log2(SAMPLE)))))

    def leaf(tree: Column) -> Column:
        """Where a row ends in one tree; sides of a split lie next to each other."""
        return F.aggregate(steps, F.lit(0), lambda at, _: F.when(F.get(tree["feature"], at) < 0, at).otherwise(
            F.get(tree["left"], at) + F.when(F.get("_v", F.get(tree["feature"], at)) < F.get(tree["cut"], at), 0).otherwise(1)))

    total = F.aggregate("_forest", F.lit(0.0), lambda sum_, tree: sum_ + F.get(tree["depth"], leaf(tree)))
    return vectors.crossJoin(F.broadcast(packed)).withColumn(column, -F.pow(F.lit(2.0), -(total / F.size("_forest")) / norm)).drop("_forest")


def score_batches(vectors: DataFrame, nodes: DataFrame, column: str = "score") -> DataFrame:
    """`score_forest` for large tables: rows walk through the broadcast forest in batches, all of a batch one level at a time.

    A step of a row is a few numbers of an array here, and a dozen interpreted expressions there.
    """
    forest = []
    for _, t in nodes.toPandas().sort_values(["tree", "node"]).groupby("tree"):
        inner = t["feature"].to_numpy() >= 0
        forest.append((np.where(inner, t["feature"], 0), np.where(inner, t["cut"], np.nan), np.where(inner, t["left"], t["node"]), t["depth"].to_numpy()))
    shared = vectors.sparkSession.sparkContext.broadcast(forest)
    norm = _path_correction(SAMPLE)

    @pandas_udf("double")
    def scored(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=float)
        return pd.Series(-2.0 ** (-(leaf_depths(np.stack(v.to_list()), shared.value) / len(shared.value)) / norm))

    return vectors.withColumn(column, scored("_v"))


@dataclass
class Anomalies:
    """Rare rows with their score, rarest first, and the threshold that set them apart."""

    ok: bool
    headline: str
    n: int = 0
    threshold: float | None = None
    rows: DataFrame | None = None
    scored: DataFrame | None = None


def run_anomalies(df: DataFrame, profiles: Profiles, contamination: float = 0.02, trees: int = 200, seed: int = 42) -> Anomalies:
    """Rows that are rare over all columns together: the `contamination` share with the lowest score."""
    features = usable_features(profiles, with_dates=False)
    if len(features.numeric) < 2:
        return Anomalies(False, "hacen falta al menos dos columnas numéricas")
    n = df.count()
    if n < 50:
        return Anomalies(False, f"hacen falta 50 registros; hay {n}")
    # written once: the forest, the threshold and the rows read it
    vectors = materialize(fit_features(df, features).transform(df).select(
        *[col(c) for c in df.columns], vector_to_array("features").alias("_v"), F.monotonically_increasing_id().alias("_n")))
    nodes = materialize(grow_forest(vectors.select("_v", "_n"), n, trees, seed))  # at most trees * 511 rows
    scored = materialize(score_batches(vectors, nodes).drop("_v", "_n"))
    (cut,) = Q.quantiles(scored, "score", [contamination])
    rare = scored.where(F.col("score") < F.lit(cut))
    found = rare.count()
    return Anomalies(True, f"{found} registros atípicos ({found / n:.1%})", found, cut, rare.orderBy("score"), scored)
