"""Quality classifier by importance resampling (operator 3).

Two bag-of-n-gram models over hashed words and word pairs are fitted: one to labelled good texts, one to all texts. The
tempered log of their ratio over a whole text is its importance weight; adding Gumbel noise and taking the k largest draws k
texts without replacement in proportion to their weights. k is not a cap: it is the number of texts whose weight
reaches a floor found from good texts that the models have not seen, so a corpus without bad texts is kept whole.
"""
from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from tabulario.llm.bpe import blocks
from tabulario.llm.common import Memo, materialize, text_column
from tabulario.operators.quantiles import quantiles

TOKEN = re.compile(r"\w+|[^\w\s]+")
PAIR = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """Parameters.

    `prior` is the number of n-grams by which the target model leans on the raw one, so that what was seen too seldom
    decides nothing. The weight of a text is `temper` times its mean log ratio, `pad` n-grams of ratio 1 added: texts of
    all lengths are drawn alike and very short ones stay near 0.

    Of `few` labelled good texts or more every fifth is held back from the target model. The floor lies as far under the
    `low` quantile of their weights as that lies under their median, but not under `floor`, which holds where labels are fewer.
    """

    buckets: int = 10_000
    prior: float = 100_000.0
    temper: float = 200.0
    pad: float = 20.0
    floor: float = -20.0
    low: float = 0.02
    few: int = 100
    seed: int = 7
    chars: int = 1 << 18


@functools.lru_cache(maxsize=1)
def token_hashes() -> Memo:
    return Memo(lambda tokens: [zlib.crc32(t.encode("utf-8", "replace")) for t in tokens], 200_000)


def grams(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words, then of the word pairs, of all texts, and for each the index of its text."""
    words = [TOKEN.findall(t.lower()) for t in texts]
    memo = token_hashes()
    memo.learn(set().union(*words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    hashed = np.fromiter((h for ws in words for h in map(memo.__getitem__, ws)), np.uint64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts)), sizes)
    same = doc[1:] == doc[:-1]
    pair = ((hashed[:-1] * PAIR + hashed[1:]) * PAIR >> np.uint64(20))[same]
    return np.r_[hashed % np.uint64(buckets), pair % np.uint64(buckets)].astype(np.int64), np.r_[doc, doc[1:][same]]


def fit(df: DataFrame, good: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> np.ndarray:
    """Log ratio of target to raw probability per bucket.

    `good` holds keys of good texts; the target model counts all of them that `df` has, the raw model every row of `df`.
    What reaches the driver are two counts per bucket.
    """
    chosen = good.select(F.col(key).alias("_key")).where(F.col("_key").isNotNull()).distinct()
    n, chars = settings.buckets, settings.chars

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(2 * n, np.int64)  # one row per bucket leaves the task
        for batch in batches:
            side, at = batch["_good"].to_numpy(bool), 0
            for block in blocks(batch["_text"].tolist(), chars):
                bucket, doc = grams(block, n)
                total += np.bincount(bucket + n * side[at:at + len(block)][doc], minlength=2 * n)
                at += len(block)
        there = np.flatnonzero(total)
        yield pd.DataFrame({"slot": there, "n": total[there]})

    # labels grow with the texts: Spark broadcasts their keys or shuffles, as their size allows
    marked = df.select(F.col(key).alias("_key"), text_column(text).alias("_text")).join(
        chosen.withColumn("_hit", F.lit(True)), "_key", "left")
    counts = marked.select("_text", F.col("_hit").isNotNull().alias("_good")).mapInPandas(count, "slot long, n long")
    table = np.zeros(2 * n)
    for r in counts.groupBy("slot").agg(F.sum("n").alias("n")).collect():  # at most 2 * buckets rows
        table[r["slot"]] = r["n"]
    target = table[n:]
    raw = table[:n] + target
    if not target.sum():
        return np.zeros(n)
    raw_share = (raw + 1) / (raw.sum() + n)
    return np.log((target + settings.prior * raw_share) / (target.sum() + settings.prior) / raw_share)


def log_ratio(df: DataFrame, model: np.ndarray, settings: Settings = Settings(), text: str = "text") -> Column:
    """The log importance weight of each whole text; 0 for null and empty texts."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # `buckets` numbers
    chars, temper, pad = settings.chars, settings.temper, settings.pad

    @pandas_udf("double")
    def weight(texts: pd.Series) -> pd.Series:
        out = []
        for block in blocks(texts.tolist(), chars):
            bucket, doc = grams(block, len(shared.value))
            size = np.bincount(doc, minlength=len(block))
            out.append(temper * np.bincount(doc, shared.value[bucket], len(block)) / (size + pad))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return weight.asNondeterministic()(text_column(text))  # so that a filter does not run it twice


def gumbel(key: Column | str, seed: int) -> Column:
    """Gumbel noise that depends on the key alone, so a lost task draws the same again."""
    u = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096, few: int = 50_000) -> float:
    """The exact k-th largest value (1 <= k <= rows) of a column without nulls, by histograms of ever narrower ranges."""
    low, high = df.agg(F.min(column), F.max(column)).head()
    above = 0
    while low < high:
        width = (high - low) / bins
        if low + width <= low or high - width >= high:  # neighbouring numbers: look at the values themselves
            rows = df.where(F.col(column).between(low, high)).groupBy(column).count().orderBy(F.desc(column)).collect()
            for value, n in rows:
                above += n
                if above >= k:
                    return value
        at = F.least(F.lit(bins - 1), F.floor((F.col(column) - low) / width).cast("int"))
        counts = df.where(F.col(column).between(low, high)).groupBy(at.alias("b")).agg(
            F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy(F.desc("b")).collect()
        for _, n, lo, hi in counts:  # at most `bins` rows
            if above + n >= k:
                low, high = lo, hi
                break
            above += n
        if n <= few and low < high:
            return df.where(F.col(column).between(low, high)).orderBy(F.desc(column)).limit(k - above).agg(F.min(column)).head()[0]
    return low


@dataclass(frozen=True)
class Sampler:
    """A fitted draw: rows whose weight plus noise reaches `threshold` are selected."""

    model: np.ndarray
    threshold: float
    settings: Settings

    def weigh(self, df: DataFrame, key: str = "doc_id", text: str = "text", into: str = "importance") -> DataFrame:
        """Add struct column `into` (log_ratio, perturbed, selected); it is replaced if there."""
        weighed = df.withColumn(into, log_ratio(df, self.model, self.settings, text))
        perturbed = F.col(into) + gumbel(F.col(key), self.settings.seed)
        return weighed.withColumn(into, F.struct(
            F.col(into).alias("log_ratio"), perturbed.alias("perturbed"), (perturbed >= self.threshold).alias("selected")))


def split(good: DataFrame, settings: Settings, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Keys to fit the target model to, and those held back to find the floor with; none where keys are few."""
    keys = good.select(key).where(F.col(key).isNotNull()).distinct()
    if keys.count() < settings.few:
        return keys, keys.limit(0)
    held = F.pmod(F.xxhash64(F.lit(settings.seed + 1), key), F.lit(5)) == 0
    return keys.where(~held), keys.where(held)


def floor_of(weighed: DataFrame, held: DataFrame, settings: Settings, key: str) -> float:
    """The least weight that counts as good, from the weights of all held-back texts."""
    own = materialize(weighed.join(held.withColumnRenamed(held.columns[0], key), key, "left_semi").select("log_ratio"))
    low, middle = quantiles(own, "log_ratio", [settings.low, 0.5])
    return settings.floor if low is None else max(settings.floor, 2 * low - middle)


def draw(weighed: DataFrame, floor: float) -> float:
    """The threshold of Gumbel top-k for rows with columns log_ratio and perturbed; minus infinity if all are drawn."""
    k, rows = weighed.agg(F.count_if(F.col("log_ratio") >= floor), F.count("*")).head()
    if k == rows:
        return -math.inf
    return kth_largest(weighed, "perturbed", k) if k else math.inf


def fit_sampler(df: DataFrame, good: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> Sampler:
    """Fit both models and the threshold over all rows of `df`. Rows that tie with the k-th are all drawn."""
    fitting, held = split(good, settings, key)
    model = fit(df, fitting, settings, key, text)
    slim = Sampler(model, -math.inf, settings).weigh(df.select(F.col(key), F.col(text)), key, text, "_i")
    weighed = materialize(slim.select(F.col(key).alias("_key"), "_i.log_ratio", "_i.perturbed"))
    return Sampler(model, draw(weighed, floor_of(weighed, held, settings, "_key")), settings)


def report(df: DataFrame, good: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, log_ratio, perturbed and selected of each row. Null and empty texts weigh 0; equal rows fare alike."""
    fitting, held = split(good, settings, key)
    model = fit(df, fitting, settings, key, text)
    weighed = materialize(Sampler(model, -math.inf, settings).weigh(
        df.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_key", "_text", "_i").select("_key", "_i.*"))
    threshold = draw(weighed, floor_of(weighed, held, settings, "_key"))
    return weighed.select(F.col("_key").alias(key), "log_ratio", "perturbed", (F.col("perturbed") >= threshold).alias("selected"))
