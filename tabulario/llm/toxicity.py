"""Toxicity by a convolutional text classifier (operator 8).

Words are embedded as the sum of hashed rows for the word and its beginnings, filters of several widths run over the
whole text, each filter's largest answer is kept, and a logistic layer reads those maxima. All labelled rows take part:
three quarters, by hash, are counted and trained on, by Adam in numpy inside the tasks, whose networks are averaged
after every round; the others set the cut-offs, per language guessed from function words in the text. The score is
shifted so that the cut-off lies at `cut`. Neither labelled texts nor keys reach the driver.
"""
from __future__ import annotations

import copy
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from tabulario.llm.bpe import blocks
from tabulario.llm.common import Memo, materialize, text_column

WORD = re.compile(r"\w+")
# Frequent function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": ("the", "of", "and", "to", "is", "that", "it", "was", "for", "with", "this", "are"),
    "fr": ("le", "les", "des", "et", "est", "dans", "une", "du", "au", "pour", "qui", "avec"),
    "de": ("der", "die", "und", "das", "ist", "nicht", "den", "mit", "von", "zu", "sich", "auf"),
    "es": ("el", "los", "las", "en", "y", "por", "para", "con", "del", "se", "su", "al"),
}
LANGUAGES = (*FUNCTION_WORDS, "other")
LANGUAGE_OF = {w: i for i, ws in enumerate(FUNCTION_WORDS.values()) for w in ws}


@dataclass(frozen=True)
class Settings:
    """Parameters. `steps` batches of `batch` rows are about what one task trains on, in `rounds` rounds; fewer rows are gone
    through again, more rows mean more tasks. Lists of up to `small` labels are broadcast."""

    buckets: int = 1 << 18
    width: int = 8
    filters: int = 8
    spans: tuple[int, ...] = (1, 2, 3)
    beginnings: tuple[int, ...] = (3, 4, 5, 6)
    min_texts: int = 3
    steps: int = 250
    batch: int = 64
    rounds: int = 4
    small: int = 500_000
    rate: float = 0.05
    decay: float = 1e-4
    cut: float = 0.7
    seed: int = 11
    chars: int = 1 << 20
    memo: int = 300_000


def parts(word: str, s: Settings) -> list[int]:
    """Hashed rows of a word; a beginning as long as the word counts only as the whole word."""
    return [zlib.crc32(p.encode()) % s.buckets for p in ("=" + word, *(word[:k] for k in s.beginnings if k < len(word)))]


@dataclass
class Network:
    """Weights. `embedding` has a row per known bucket; `row_of` maps buckets to rows, the last row being zeros."""

    settings: Settings
    row_of: np.ndarray
    embedding: np.ndarray
    filters: list[np.ndarray]  # per width w: (w, width, filters)
    bias: list[np.ndarray]
    weights: np.ndarray
    offset: float
    shift: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))

    def values(self) -> list[np.ndarray]:
        """All that is trained but `offset`; changed in place."""
        return [self.embedding, *self.filters, *self.bias, self.weights]

    def flat(self) -> np.ndarray:
        return np.concatenate([*(v.ravel() for v in self.values()), [self.offset]]).astype(np.float32)

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for v in self.values():
            v[...] = flat[at:at + v.size].reshape(v.shape)
            at += v.size
        self.offset = float(flat[at])

    def look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Embedding rows of all parts of the words and the index of each part's word."""
        found = [parts(w, self.settings) for w in words]
        index = np.repeat(np.arange(len(words)), [len(f) for f in found])
        return self.row_of[np.array([b for f in found for b in f], np.int64)], index

    def embed(self, rows: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
        known = rows < len(self.embedding) - 1
        out = np.zeros((n, self.settings.width), np.float32)
        np.add.at(out, index[known], self.embedding[rows[known]])
        return out

    def maxima(self, vectors: np.ndarray, code: np.ndarray, sizes: np.ndarray, places: bool = False) -> tuple[np.ndarray, list]:
        """Largest answer of each filter per text (0 at least); with `places` also where it was found, -1 if it is 0.

        `code` lists the words of the texts, one after the other, as rows of `vectors`.
        """
        begin, full = np.cumsum(sizes) - sizes, np.flatnonzero(sizes)
        text = np.repeat(np.arange(len(sizes)), sizes)
        out, where = [], []
        for w, kernel, bias in zip(self.settings.spans, self.filters, self.bias):
            steps = [vectors @ kernel[j] for j in range(w)]  # one product per distinct word
            answer = steps[0][code] + bias
            for j in range(1, w):
                inside = (text[j:] == text[:-j])[:, None]
                answer[:len(code) - j] += np.where(inside, steps[j][code[j:]], 0)
            best, at = np.zeros((len(sizes), kernel.shape[2]), np.float32), np.full((len(sizes), kernel.shape[2]), -1)
            if len(full):
                top = np.maximum.reduceat(answer, begin[full], axis=0)
                best[full] = np.maximum(top, 0)
                if places:
                    hit = np.where(answer == np.repeat(top, sizes[full], axis=0), np.arange(len(code))[:, None], len(code))
                    at[full] = np.where(top > 0, np.minimum.reduceat(hit, begin[full], axis=0), -1)
            out.append(best)
            where.append(at)
        return np.concatenate(out, 1), where

    def known(self, words: list[str]) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
        """Rows of words, with vectors and languages (index in LANGUAGES, the last where a word tells none) of all rows.

        A worker remembers the words of its blocks within `memo`; this is no part of the network.
        """
        s, n = self.settings, len(LANGUAGES) - 1
        of, vectors, spoken, used = self.__dict__.get("_words", ({}, np.zeros((0, s.width), np.float32), np.zeros(0, np.int64), 0))
        new = [w for w in words if w not in of]
        if used + len(new) > s.memo:
            of, used, new = {}, 0, words
        end = used + len(new)
        if end > len(vectors):
            vectors, spoken = np.resize(vectors, (2 * end, s.width)), np.resize(spoken, 2 * end)
        if new:
            vectors[used:end] = self.embed(*self.look_up(new), len(new))
            spoken[used:end] = [LANGUAGE_OF.get(w, n) for w in new]
            of.update(zip(new, range(used, end)))
        self.__dict__["_words"] = of, vectors, spoken, end
        return of, vectors, spoken

    def read(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Logit and guessed language (index in LANGUAGES) of each text."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        of, vectors, spoken = self.known(list(set().union(*words)))
        rows = np.fromiter(map(of.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        # the filters answer each distinct word of these texts once
        place = np.zeros(len(vectors), np.int64)
        place[rows] = 1
        here = np.flatnonzero(place)
        place[here] = np.arange(len(here))
        top, _ = self.maxima(vectors[here], place[rows], sizes)
        n = len(LANGUAGES)
        votes = np.bincount(np.repeat(np.arange(len(words)), sizes) * n + spoken[rows], minlength=n * len(words)).reshape(-1, n)[:, :-1]
        most = votes.max(1)
        clear = (most > 0) & ((votes == most[:, None]).sum(1) == 1)  # no function word or a tie: "other"
        return top @ self.weights + self.offset, np.where(clear, votes.argmax(1), n - 1)

    def scores(self, texts: list[str]) -> np.ndarray:
        logit, spoken = self.read([WORD.findall(t.lower()) for t in texts])
        return 1 / (1 + np.exp(-np.clip(logit + self.shift[spoken], -30, 30)))


def labelled(docs: DataFrame, labels: DataFrame, s: Settings, key: str, text: str, label: str = "toxic") -> DataFrame:
    """_key, _text, _label and _held (a quarter, by hash, that sets cut-offs) of every document with a label, written down once."""
    known = materialize(labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).where(
        F.col("_key").isNotNull() & F.col("_label").isin(0, 1)).groupBy("_key").agg(F.max("_label").alias("_label")))
    # a list of known size saves moving all texts; beyond it they are shuffled
    side = F.broadcast(known) if known.count() <= s.small else known
    return materialize(docs.select(F.col(key).alias("_key"), text_column(text).alias("_text")).join(side, "_key").withColumn(
        "_held", F.pmod(F.xxhash64(F.lit(s.seed), "_key"), F.lit(4)) == 0))


def slices(vector: np.ndarray, size: int = 4_096) -> pd.DataFrame:
    """A task's vector as rows: slice, task and its bytes."""
    cut = [vector[a:a + size].tobytes() for a in range(0, len(vector), size)]
    return pd.DataFrame({"slice": range(len(cut)), "task": TaskContext.get().partitionId(), "part": cut})


def summed(df: DataFrame, kind: type) -> np.ndarray | None:
    """The sum of all tasks' vectors of `slices`, None without any; the driver sees as much as one of them."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, kind) for x in rows.sort_values("task")["part"]], axis=0, dtype=np.float64)
        return pd.DataFrame({"slice": rows["slice"][:1], "part": [total.tobytes()]})

    found = sorted(df.groupBy("slice").applyInPandas(add, "slice int, part binary").collect())
    return np.frombuffer(b"".join(r["part"] for r in found), np.float64) if found else None


def prepare(rows: DataFrame, s: Settings) -> tuple[Network, np.ndarray]:
    """A network that starts from how much more often toxic texts hold a part, and the numbers of clean and toxic rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = np.zeros((2, s.buckets)), np.zeros(2)
        memo = Memo(lambda words: [parts(w, s) for w in words], s.memo)
        for batch in batches:
            labels = iter(batch["_label"])
            for block in blocks(batch["_text"].tolist(), s.chars):
                words = [set(WORD.findall(text.lower())) for text in block]
                memo.learn(set().union(*words))
                for ws, y in zip(words, labels):
                    seen[y][list(set().union(*map(memo.__getitem__, ws)))] += 1
                    n[y] += 1
        if n.any():
            yield slices(np.r_[seen.ravel(), n].astype(np.float32))  # whole numbers far below 2 ** 24

    fit = rows.where("NOT _held").select("_text", "_label")
    few = max(8, fit.count() // (s.steps * s.batch))  # every task sends a vector, however few its rows
    total = summed(fit.coalesce(few).mapInPandas(count, "slice int, task int, part binary"), np.float32)
    total = np.zeros(2 * s.buckets + 2) if total is None else total
    seen, rows_of = total[:-2].reshape(2, -1), total[-2:]
    rng, n = np.random.default_rng(s.seed), np.maximum(1, rows_of)
    known = np.flatnonzero(seen.sum(0) >= s.min_texts)
    row_of = np.full(s.buckets, len(known), np.int64)
    row_of[known] = np.arange(len(known))
    odds = np.log((seen[1][known] + 0.5) / (n[1] + 1)) - np.log((seen[0][known] + 0.5) / (n[0] + 1))
    embedding = np.zeros((len(known) + 1, s.width), np.float32)
    embedding[:-1] = rng.normal(0, 0.01, (len(known), s.width))
    embedding[:-1, 0] += 0.1 * odds
    filters = [rng.normal(0, 0.1, (w, s.width, s.filters)).astype(np.float32) for w in s.spans]
    for f in filters:
        f[0, 0] = np.abs(f[0, 0]) + 0.5
    return Network(s, row_of, embedding, filters, [np.zeros(s.filters, np.float32) for _ in s.spans],
                   np.full(s.filters * len(s.spans), 0.3, np.float32), -1.0), rows_of


class Descent:
    """Adam on the logistic loss, one batch at a time; changes the network in place."""

    def __init__(self, net: Network):
        self.net, self.t, self.offset = net, 0, np.array([net.offset], np.float32)
        self.all = [*net.values(), self.offset]
        self.first, self.second = [np.zeros_like(v) for v in self.all], [np.zeros_like(v) for v in self.all]
        self.memo = Memo(lambda words: [net.row_of[parts(w, net.settings)] for w in words], net.settings.memo)

    def step(self, words: list[list[str]], y: np.ndarray, weight: np.ndarray) -> None:
        net, s = self.net, self.net.settings
        distinct = list(dict.fromkeys(chain.from_iterable(words)))
        of = {w: i for i, w in enumerate(distinct)}
        self.memo.learn(distinct)
        sizes = np.array([len(ws) for ws in words])
        code = np.fromiter(map(of.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        found = [self.memo[w] for w in distinct]
        index = np.repeat(np.arange(len(found)), [len(f) for f in found])
        lookup = np.concatenate(found) if found else np.zeros(0, np.int64)
        vectors = net.embed(lookup, index, len(found))
        top, where = net.maxima(vectors, code, sizes, True)
        error = (1 / (1 + np.exp(-np.clip(top @ net.weights + self.offset[0], -30, 30))) - y) * weight / len(y)
        grads = [np.zeros_like(v) for v in self.all]
        grads[-2][:] = top.T @ error
        grads[-1][0] = error.sum()
        vector_grad = np.zeros_like(vectors)
        back = error[:, None] * net.weights[None, :]
        end = np.repeat(np.cumsum(sizes), s.filters).reshape(len(y), s.filters)
        for k, (w, at) in enumerate(zip(s.spans, where)):
            delta = np.where(at >= 0, back[:, k * s.filters:(k + 1) * s.filters], 0)
            grads[1 + len(s.spans) + k][:] = delta.sum(0)
            for j in range(w):
                text, unit = np.nonzero((at >= 0) & (at + j < end))
                word, d = code[at[text, unit] + j], delta[text, unit]
                np.add.at(grads[1 + k][j].T, unit, vectors[word] * d[:, None])
                np.add.at(vector_grad, word, net.filters[k][j].T[unit] * d[:, None])
        inside = lookup < len(net.embedding) - 1
        np.add.at(grads[0], lookup[inside], vector_grad[index[inside]])
        self.t += 1
        for v, g, m, q in zip(self.all, grads, self.first, self.second):
            g += s.decay * v
            m *= 0.9
            m += 0.1 * g
            q *= 0.99
            g *= g
            g *= 0.01
            q += g
            np.divide(q, 1 - 0.99 ** self.t, out=g)
            np.sqrt(g, out=g)
            g += 1e-6
            np.divide(m, g, out=g)
            g *= s.rate / (1 - 0.9 ** self.t)
            v -= g
        net.offset = float(self.offset[0])
        net.embedding[-1] = 0


def train(rows: DataFrame, s: Settings) -> Network:
    """Fit on all rows of `labelled` that are not held back.

    Every round trains, in each task, on its share of the rows, from the network the round before ended with; the tasks'
    networks are then averaged by their numbers of rows. A task holds one batch of texts at a time.
    """
    net, n = prepare(rows, s)
    if not n.all():
        return net
    total = int(n.sum())
    copies = max(1, -(-s.steps * s.batch // total))  # of few rows, so that small tables get as many steps
    tasks = -(-total * copies // (s.steps * s.batch))
    weight = n.sum() / (2 * n)  # both classes weigh alike
    order = F.xxhash64(F.lit(s.seed + 1), "_copy", "_key")
    fed = rows.where("NOT _held").select("_key", "_text", "_label", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("_copy")).withColumn("_order", order)
    for turn in range(s.rounds):
        shared = rows.sparkSession.sparkContext.broadcast(net)  # bounded by `buckets` rows

        def descend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            work = Descent(copy.deepcopy(shared.value))  # noqa: B023
            done, held = 0, []

            def step() -> None:
                y = np.array([label for _, label in held])
                work.step([WORD.findall(text.lower()) for text, _ in held], y.astype(np.float32), weight[y].astype(np.float32))

            for batch in batches:
                for row in zip(batch["_text"], batch["_label"]):
                    held.append(row)
                    done += 1
                    if len(held) == s.batch:
                        step()
                        held.clear()
            if held:
                step()
            if done:
                yield slices(np.r_[work.net.flat() * np.float32(done), np.float32(done)])

        part = fed.where(F.pmod(F.shiftright("_order", 8), F.lit(s.rounds)) == turn).repartition(tasks, "_order").coalesce(tasks).sortWithinPartitions("_order", "_text")
        found = summed(part.select("_text", "_label").mapInPandas(descend, "slice int, task int, part binary"), np.float32)
        if found is not None:
            net.load(found[:-1] / found[-1])
    return net


def calibrate(rows: DataFrame, net: Network, few: int = 20) -> None:
    """Per language the cut-off with the best F1 on all held-back rows (the middle of the best range); pooled where rows are few.

    Distinct logits are ranged in order; what a range counts is added to what those before it count, so no task holds a language.
    """
    s, every = net.settings, len(LANGUAGES)
    shared = rows.sparkSession.sparkContext.broadcast(net)

    @pandas_udf("logit double, spoken int")
    def read(texts: pd.Series) -> pd.DataFrame:
        found = [shared.value.read([WORD.findall(t.lower()) for t in b]) for b in blocks(texts.tolist(), s.chars)]
        return pd.DataFrame({"logit": np.concatenate([x for x, _ in found]).astype(np.float64), "spoken": np.concatenate([x for _, x in found])})

    judged = rows.where("_held").select(read.asNondeterministic()("_text").alias("x"), "_label")
    one = judged.select(F.explode(F.array("x.spoken", F.lit(every))).alias("group"), F.col("x.logit").alias("logit"), "_label")
    values = one.groupBy("group", "logit").agg(F.count("*").alias("n"), F.sum("_label").alias("hits"))
    ranged = materialize(values.repartitionByRange("group", F.desc("logit")).withColumn("part", F.spark_partition_id()))
    of_part = ranged.groupBy("group", "part").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))  # a row per range and group
    group = Window.partitionBy("group")
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = of_part.select("group", "part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "hits")],
                            *[F.sum(c).over(group).alias(f"{c}_all") for c in ("n", "hits")])
    inside = Window.partitionBy("group", "part").orderBy(F.desc("logit"))
    placed = ranged.join(F.broadcast(totals), ["group", "part"]).select(
        "group", "logit", "n_all", "hits_all", (2 * (F.col("hits_before") + F.sum("hits").over(inside)) / (
            F.col("n_before") + F.sum("n").over(inside) + F.col("hits_all"))).alias("f1"))
    best = placed.where((F.col("n_all") >= few) & (F.col("hits_all") >= 3) & (F.col("hits_all") < F.col("n_all"))).groupBy("group").agg(
        F.max_by("logit", F.struct("f1", -F.col("logit"))).alias("best"))
    below = ranged.join(F.broadcast(best), "group").groupBy("group", "best").agg(F.max(F.when(F.col("logit") < F.col("best"), F.col("logit"))).alias("next"))
    cut = {r["group"]: (r["best"] + (r["best"] - 1 if r["next"] is None else r["next"])) / 2 for r in below.collect()}  # a row per language
    at_cut = math.log(s.cut / (1 - s.cut))
    for i in range(every):
        net.shift[i] = at_cut - cut.get(i, cut.get(every, 0.0))


def score(df: DataFrame, net: Network, text: str = "text", into: str = "score") -> DataFrame:
    """Add column `into` (double in 0..1) read from each whole text alone. Null and empty texts score as empty."""
    shared = df.sparkSession.sparkContext.broadcast(net)  # bounded by `buckets` rows

    @pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        net = shared.value
        return pd.Series(np.concatenate([net.scores(b) for b in blocks(texts.tolist(), net.settings.chars)] or [np.zeros(0)]))

    return df.withColumn(into, scored.asNondeterministic()(text_column(text)))


def report(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, held_out, score and predicted of each row; labels of held-out rows are never looked at."""
    outside = lambda c: F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(3)) == 1
    rows = labelled(docs, labels.where(~outside(key)), s, key, text)
    net = train(rows, s)
    calibrate(rows, net)
    slim = docs.select(F.col(key), text_column(text).alias("_text"))
    return score(slim, net, "_text", "score").select(
        key, F.coalesce(outside(key), F.lit(False)).alias("held_out"), "score", (F.col("score") >= s.cut).cast("int").alias("predicted"))
