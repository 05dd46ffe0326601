"""Forests and boosted trees whose folds are grown together.

Features are put into bins once, and rows that agree in all bins, the label and the fold become one row with their number.
Each tree of a forest draws from all rows with replacement, in the tasks that hold them, and one task grows that tree for
every fold and for the final model, each without the rows of its fold; boosted models are grown one per task on all rows.
So a candidate with all its folds takes one shuffle, whatever the number of trees, levels and rounds. A task that grows
holds what its tree has drawn, summed by bins. Fitted trees predict in batches inside the saved pipeline.
"""
from __future__ import annotations

import base64
import io
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext, keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from tabulario.session import materialize

BINS = 32
CELLS = 1 << 22  # cells of the histograms that are held at once
MEMO = 1 << 18  # numbers of predictions that a task remembers
DRAWN = 1 << 21  # draws that are held at once


@dataclass(frozen=True)
class Effort:
    """What is grown: number of trees or rounds, depth and least rows of a leaf. Models, predictions and scores cover all rows."""

    trees: int = 250
    depth: int = 12
    rounds: int = 100
    boost_depth: int = 3
    step: float = 0.1
    leaf: int = 2
    seed: int = 42


@dataclass
class Trees:
    """Trees one after the other: a node splits `feature` after bin `cut` into `child` and `child` + 1, or is a leaf
    (feature -1) with the entries `start` to `start` + `size` of (`slot`, `share`). Bins follow from `edges`, per feature."""

    edges: list[np.ndarray]
    slots: int
    base: np.ndarray
    root: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    start: np.ndarray
    size: np.ndarray
    slot: np.ndarray
    share: np.ndarray
    meaning: str = "mean"  # or boosted_number, boosted_classes

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], 1).astype(np.uint8)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        """Sums over all trees, per row and slot."""
        out = np.zeros((len(bins), self.slots))
        rows = np.arange(len(bins))
        for root in self.root.tolist():
            at = np.full(len(bins), root)
            open_ = rows
            while len(open_):
                f = self.feature[at[open_]]
                open_ = open_[f >= 0]
                here = at[open_]
                at[open_] = self.child[here] + (bins[open_, self.feature[here]] > self.cut[here])
            many = self.size[at]
            entry = np.repeat(self.start[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            np.add.at(out, (np.repeat(rows, many), self.slot[entry]), self.share[entry])
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """A number per row, or probabilities per class."""
        return self.outcome(self.bins(x))

    def outcome(self, bins: np.ndarray) -> np.ndarray:
        raw = self.raw(bins)
        if self.meaning == "mean":
            return raw / len(self.root)
        raw = raw + self.base
        if self.meaning == "boosted_number":
            return raw
        if self.slots == 1:  # log odds of the second class
            p = 1 / (1 + np.exp(-np.clip(raw, -500, 500)))
            return np.concatenate([1 - p, p], 1)
        e = np.exp(raw - raw.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def remembering(self) -> Callable[[np.ndarray], np.ndarray]:
        """`predict` for batch after batch: what a row of bins gives is kept, up to MEMO numbers, and asked for once."""
        seen: dict[bytes, int] = {}
        kept: list[np.ndarray] = []

        def predict(x: np.ndarray) -> np.ndarray:
            bins = np.ascontiguousarray(self.bins(x))
            keys, first, place = np.unique(bins.view(f"V{bins.shape[1]}").ravel(), return_index=True, return_inverse=True)
            names = [k.tobytes() for k in keys]
            if (len(seen) + len(names)) * max(1, self.slots) > MEMO:
                seen.clear()
                kept.clear()
            new = [i for i, k in enumerate(names) if k not in seen]
            if new:
                kept.extend(self.outcome(bins[first[new]]))
                seen.update({names[i]: len(seen) + j for j, i in enumerate(new)})
            return np.array([kept[seen[k]] for k in names])[place.ravel()]

        return predict

    def dump(self) -> str:
        held = io.BytesIO()
        width = np.array([len(e) for e in self.edges])
        np.savez_compressed(held, edges=np.concatenate([*self.edges, np.zeros(0)]), width=width, slots=self.slots, meaning=self.meaning,
                            **{k: getattr(self, k) for k in ("base", *ARRAYS)})
        return base64.b64encode(held.getvalue()).decode()

    @staticmethod
    def load(text: str) -> Trees:
        z = np.load(io.BytesIO(base64.b64decode(text)))
        edges = np.split(z["edges"], np.cumsum(z["width"])[:-1])
        return Trees(edges, int(z["slots"]), z["base"], meaning=str(z["meaning"]), **{k: z[k] for k in ARRAYS})


ARRAYS = ("root", "feature", "cut", "child", "start", "size", "slot", "share")
_DEALT = "tree int, part int, turn int, b binary, g binary, fold binary, n binary, w binary, s binary"
_TREE = "fit int, tree int, base array<double>, feature binary, cut binary, child binary, start binary, size binary, slot binary, share binary"
_TYPES = {"feature": np.int16, "cut": np.uint8, "child": np.int32, "start": np.int32, "size": np.int32, "slot": np.int32, "share": np.float64}


@dataclass
class Growing:
    """One tree while it grows."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    child: list[int] = field(default_factory=list)

    def add(self) -> int:
        self.feature.append(-1)
        self.cut.append(0)
        self.child.append(-1)
        return len(self.feature) - 1


def grow(bins: np.ndarray, weight: np.ndarray, amount: np.ndarray, group: np.ndarray, groups: int, depth: int, leaf: int,
         features: int, rng: np.random.Generator, copies: np.ndarray | None = None) -> tuple[Growing, np.ndarray]:
    """A tree of greatest loss of squares, level by level over histograms, and the node of each row.

    `amount` is summed per `group` (the class of a row, or 0) and `weight` over all; a split gains the sum over groups of
    amount² / weight on both sides. Each node looks at `features` of them, drawn anew. With class weights as amounts this
    is Gini impurity, with weighted targets it is variance, with gradients and curvatures it is a Newton step. A row may
    stand for several `copies`, with their summed weights and amounts.
    """
    copies = np.ones(len(bins)) if copies is None else copies
    tree = Growing()
    node = np.zeros(len(bins), np.int64)
    tree.add()
    active = np.array([0])
    for _ in range(depth):
        place = np.full(len(tree.feature), -1)
        place[active] = np.arange(len(active))
        rows = np.flatnonzero(place[node] >= 0)
        rows = rows[np.argsort(place[node[rows]], kind="stable")]
        local = place[node[rows]]
        picks = np.argsort(rng.random((len(active), bins.shape[1])), axis=1)[:, :features]
        step = max(1, CELLS // (features * BINS * groups))
        opened = []
        for low in range(0, len(active), step):
            high = min(low + step, len(active))
            part = slice(*np.searchsorted(local, [low, high]))
            r, k = rows[part], local[part] - low
            n = high - low
            cell = (k[:, None] * features + np.arange(features)) * BINS + bins[r[:, None], picks[local[part]]]
            shape, size = (n, features, BINS), n * features * BINS
            spread = lambda v: np.repeat(v[r], features)
            count = np.cumsum(np.bincount(cell.ravel(), spread(copies), minlength=size).reshape(shape), 2)
            w = np.cumsum(np.bincount(cell.ravel(), spread(weight), minlength=size).reshape(shape), 2)
            s = np.cumsum(np.bincount((cell * groups + group[r][:, None]).ravel(), spread(amount), minlength=size * groups).reshape(*shape, groups), 2)
            rest_w, rest_s = w[:, :, -1:] - w, s[:, :, -1:] - s
            gain = (s * s).sum(3) / np.maximum(w, 1e-12) + (rest_s * rest_s).sum(3) / np.maximum(rest_w, 1e-12)
            gain -= gain[:, :, -1:]
            gain[(count < leaf) | (count[:, :, -1:] - count < leaf)] = -np.inf
            best = gain.reshape(n, -1).argmax(1)
            good = gain.reshape(n, -1)[np.arange(n), best] > 1e-9
            for i in np.flatnonzero(good).tolist():
                at = int(active[low + i])
                tree.feature[at], tree.cut[at], tree.child[at] = int(picks[low + i, best[i] // BINS]), int(best[i] % BINS), tree.add()
                tree.add()
                opened.append(at)
        if not opened:
            break
        split = np.array(tree.feature)[node] >= 0
        split &= place[node] >= 0 if len(place) == len(tree.feature) else np.r_[place, np.full(len(tree.feature) - len(place), -1)][node] >= 0
        moved = np.flatnonzero(split)
        f, c, d = np.array(tree.feature), np.array(tree.cut), np.array(tree.child)
        here = node[moved]
        node[moved] = d[here] + (bins[moved, f[here]] > c[here])
        active = np.concatenate([[d[a], d[a] + 1] for a in opened])
    return tree, node


def leaves(nodes: int, node: np.ndarray, slot: np.ndarray, value: np.ndarray, slots: int) -> dict[str, np.ndarray]:
    """Entries of each node: the summed `value` of its rows per slot, in order, none that is zero."""
    key, inverse = np.unique(node * slots + slot, return_inverse=True)
    total = np.bincount(inverse, value, minlength=len(key))
    size = np.bincount(key // slots, minlength=nodes)
    return {"start": np.cumsum(size) - size, "size": size, "slot": key % slots, "share": total}


def packed(fit: int, number: int, base: np.ndarray, tree: Growing, entries: dict[str, np.ndarray]) -> tuple:
    arrays = {"feature": tree.feature, "cut": tree.cut, "child": tree.child, **entries}
    return (fit, number, list(map(float, base)), *[np.asarray(arrays[k]).astype(t).tobytes() for k, t in _TYPES.items()])


def in_order(pdf: pd.DataFrame, *by: str) -> pd.DataFrame:
    """Spark gives the rows of a group in no fixed order."""
    return pdf.sort_values(list(by), kind="stable", ignore_index=True)


def alike(bins: np.ndarray, group: np.ndarray, fold: np.ndarray, folds: int, *amounts: np.ndarray,
          copies: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Rows of the same bins and group as one: bins, group, and per fold how many they are and each of `amounts` summed.

    Growing a tree asks for nothing else, and there are at most as many of them as bins can be combined.
    """
    wide = np.ascontiguousarray(np.concatenate([bins, group.astype(np.int32)[:, None].view(np.uint8)], 1))
    _, first, place = np.unique(wide.view(f"V{wide.shape[1]}").ravel(), return_index=True, return_inverse=True)
    cell, size = place.ravel() * folds + fold, len(first) * folds
    sums = [np.bincount(cell, a, minlength=size).reshape(-1, folds) for a in (np.ones(len(bins)) if copies is None else copies, *amounts)]
    return (bins[first], group[first], *sums)


class Grower:
    """The candidates of one training over binned rows."""

    def __init__(self, ready: DataFrame, classes: int, folds: int, effort: Effort):
        """`ready` has features, label, _w and _fold; `classes` is 0 for numbers."""
        self.classes, self.folds, self.effort = classes, folds, effort
        numbered = materialize(ready.select(vector_to_array("features").alias("_x"), F.col("label").cast("double").alias("label"),
                                            F.col("_w").cast("double").alias("_w"), F.col("_fold").cast("int").alias("_fold")))
        width, middle = numbered.agg(F.first(F.size("_x")), F.avg("label")).head()
        self.middle = 0.0 if classes else middle  # labels are summed from here, so that sums of squares keep their digits
        probs = [i / BINS for i in range(1, BINS)]
        found = numbered.agg(*[F.percentile_approx(F.get("_x", F.lit(f)), probs, 2_000) for f in range(width)]).head()
        self.edges = [np.unique(np.array(e, float)) for e in found]
        edges = self.edges

        @pandas_udf("binary")
        def binned(x: pd.Series) -> pd.Series:
            m = np.stack(x.to_list())
            b = np.stack([np.searchsorted(e, m[:, f], "left") for f, e in enumerate(edges)], 1).astype(np.uint8)
            return pd.Series([r.tobytes() for r in b], dtype=object)

        group = F.col("label").cast("int") if classes else F.lit(0)
        cells = numbered.select(binned("_x").alias("_b"), group.alias("_g"), "_fold", "label", "_w").groupBy(
            "_b", "_g", "_fold", "label", "_w").agg(F.count("*").alias("_c"))
        # in order, so that what is drawn does not depend on how rows arrive
        self.cells = materialize(cells.sortWithinPartitions("_b", "_g", "_fold", "label", "_w"))

    def forest(self) -> DataFrame:
        """Trees of all fits (the folds, then all rows), grown from all rows drawn with replacement.

        Each tree takes a row as often as a Poisson number of mean 1 says, so n copies as often as one of mean n.
        """
        e, classes, folds, width, middle = self.effort, self.classes, self.folds, len(self.edges), self.middle
        features = max(1, round(math.sqrt(width))) if classes else max(1, round(width / 3))
        step = max(1, DRAWN // e.trees)

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            part, turn = TaskContext.get().partitionId(), 0
            for pdf in batches:
                for low in range(0, len(pdf), step):
                    held = pdf.iloc[low:low + step]
                    rng = np.random.default_rng((e.seed, part, turn))
                    bins = np.frombuffer(b"".join(held["_b"]), np.uint8).reshape(len(held), -1)
                    group, fold = held["_g"].to_numpy(np.int32), held["_fold"].to_numpy(np.int32)
                    weight = held["_w"].to_numpy()
                    amount = weight if classes else weight * (held["label"].to_numpy() - middle)
                    new = np.r_[True, (bins[1:] != bins[:-1]).any(1) | (group[1:] != group[:-1]) | (fold[1:] != fold[:-1])]
                    first = np.flatnonzero(new)
                    drawn = rng.poisson(held["_c"].to_numpy(np.float64)[:, None], (len(held), e.trees))
                    n, w, s = (np.add.reduceat(x, first, 0) for x in (drawn, drawn * weight[:, None], drawn * amount[:, None]))
                    out = []
                    for tree in range(e.trees):
                        at = np.flatnonzero(n[:, tree])
                        if len(at):
                            there = first[at]
                            out.append((tree, part, turn, *[x.tobytes() for x in (
                                bins[there], group[there], fold[there], n[at, tree].astype(np.float64), w[at, tree], s[at, tree])]))
                    turn += 1
                    yield pd.DataFrame(out, columns=[c.split()[0] for c in _DEALT.split(", ")])

        def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = in_order(pdf, "part", "turn")
            bins, group, fold, n, weight, amount = (
                np.frombuffer(b"".join(pdf[c]), t) for c, t in (("b", np.uint8), ("g", np.int32), ("fold", np.int32), ("n", float), ("w", float), ("s", float)))
            bins, group, count, w_of, s_of = alike(bins.reshape(len(group), -1), group, fold, folds, weight, amount, copies=n)
            group = group.astype(np.int64)
            out = []
            for j in range(folds + 1):
                others = np.arange(folds) != j
                n, w, amount = count[:, others].sum(1), w_of[:, others].sum(1), s_of[:, others].sum(1)
                at = np.flatnonzero(n)
                if not len(at):
                    continue
                b, g, n, w, amount = bins[at], group[at], n[at], w[at], amount[at]
                off = 0.0 if classes else amount.sum() / w.sum()
                tree, node = grow(b, w, amount - off * w if not classes else amount, g, max(1, classes), e.depth, e.leaf, features,
                                  np.random.default_rng((e.seed, key[0], j)), n)
                total = np.bincount(node, w, minlength=len(tree.feature))
                entries = leaves(len(tree.feature), node, g, (w if classes else amount + middle * w) / total[node], max(1, classes))
                out.append(packed(j, key[0], [], tree, entries))
            return pd.DataFrame(out, columns=[c.split()[0] for c in _TREE.split(", ")])

        return materialize(self.cells.mapInPandas(deal, _DEALT).groupBy("tree").applyInPandas(fit, _TREE))

    def boosted(self) -> DataFrame:
        """Trees of all fits, each fit grown by rounds of gradient boosting from all rows."""
        e, classes, folds, middle = self.effort, self.classes, self.folds, self.middle
        served = self.cells.withColumn("fit", F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds)), lambda j: j != F.col("_fold")))).groupBy(
            "fit", "_b", "_g").agg(F.sum("_c").alias("_c"), F.sum(F.col("_c") * (F.col("label") - middle)).alias("_s"))

        def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = in_order(pdf, "_b", "_g")
            bins = np.frombuffer(b"".join(pdf["_b"]), np.uint8).reshape(len(pdf), -1)
            group, copies = pdf["_g"].to_numpy(np.int64), pdf["_c"].to_numpy(np.float64)[:, None]
            total = pdf["_s"].to_numpy()[:, None] + middle * copies
            y, n = (total / copies)[:, 0], len(bins)  # one label for each class, else the mean of rows that no tree tells apart
            slots = 1 if classes <= 2 else classes
            mean = float(total.sum() / copies.sum())
            if not classes:
                base, target = np.array([mean]), y[:, None]
            elif slots == 1:
                p = np.clip(mean, 1e-6, 1 - 1e-6)
                base, target = np.array([np.log(p / (1 - p))]), y[:, None]
            else:
                target = (group[:, None] == np.arange(classes)).astype(float)
                base = np.log(np.maximum((target * copies).sum(0) / copies.sum(), 1e-6))
            raw = np.tile(base, (n, 1))
            rng, out = np.random.default_rng((e.seed, key[0])), []
            zero = np.zeros(n, np.int64)
            for turn in range(e.rounds):
                if not classes:
                    slope, bend = target - raw, np.ones((n, 1))
                elif slots == 1:
                    p = 1 / (1 + np.exp(-np.clip(raw, -500, 500)))
                    slope, bend = target - p, np.maximum(p * (1 - p), 1e-6)
                else:
                    p = np.exp(raw - raw.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    slope, bend = target - p, np.maximum(p * (1 - p), 1e-6)
                slope, bend = slope * copies, bend * copies
                for k in range(slots):
                    tree, node = grow(bins, bend[:, k], slope[:, k], zero, 1, e.boost_depth, e.leaf, bins.shape[1], rng, copies[:, 0])
                    value = e.step * np.bincount(node, slope[:, k], minlength=len(tree.feature)) / np.maximum(
                        np.bincount(node, bend[:, k], minlength=len(tree.feature)), 1e-12)
                    used = np.unique(node)
                    out.append(packed(key[0], turn * slots + k, base, tree, leaves(len(tree.feature), used, np.full(len(used), k), value[used], slots)))
                    raw[:, k] += value[node]
            return pd.DataFrame(out, columns=[c.split()[0] for c in _TREE.split(", ")])

        return materialize(served.groupBy("fit").applyInPandas(fit, _TREE))

    def model(self, grown: DataFrame, fit: int, boosted: bool) -> Trees:
        """The trees of one fit; at most as many nodes as its effort allows come to the driver."""
        rows = grown.where(F.col("fit") == fit).orderBy("tree").collect()
        parts = {k: [np.frombuffer(r[k], t) for r in rows] for k, t in _TYPES.items()}
        nodes = np.array([len(x) for x in parts["feature"]])
        entries = np.array([len(x) for x in parts["slot"]])
        root, first = np.cumsum(nodes) - nodes, np.cumsum(entries) - entries
        shift = {"child": root, "start": first}
        arrays = {k: np.concatenate([x.astype(np.int64) + shift[k][i] if k in shift else x for i, x in enumerate(xs)]) for k, xs in parts.items()}
        if not boosted:
            slots, meaning, base = max(1, self.classes), "mean", np.zeros(max(1, self.classes))
        else:
            slots, base = 1 if self.classes <= 2 else self.classes, np.array(rows[0]["base"])
            meaning = "boosted_classes" if self.classes else "boosted_number"
        return Trees(self.edges, slots, base, root, meaning=meaning, **arrays)


class TreeModel(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted trees as a pipeline stage: `prediction`, and for classes `probability` and `rawPrediction`."""

    trees = Param(Params._dummy(), "trees", "the trees, packed", TypeConverters.toString)

    @keyword_only
    def __init__(self, trees=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        model = Trees.load(self.getOrDefault(self.trees))
        number = model.meaning == "boosted_number" or (model.meaning == "mean" and model.slots == 1)
        shared = dataset.sparkSession.sparkContext.broadcast(model)  # bounded by the effort

        @pandas_udf("array<double>")
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            predict = shared.value.remembering()
            for x in batches:
                yield pd.Series(list(predict(np.stack(x.to_list()))) if len(x) else [], dtype=object)

        out = dataset.withColumn("_scores", scored.asNondeterministic()(vector_to_array("features")))
        if number:
            return out.withColumn("prediction", F.get("_scores", F.lit(0))).drop("_scores")
        likeliest = (F.array_position("_scores", F.array_max("_scores")) - 1).cast("double")
        return out.withColumns({"rawPrediction": array_to_vector("_scores"), "probability": array_to_vector("_scores"), "prediction": likeliest}).drop("_scores")
