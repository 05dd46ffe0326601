"""Importance resampling towards a target distribution (operator 13).

Word runs are hashed into buckets; the logarithm of how much likelier a bucket is in the target texts than in all
documents is its gain, and a document weighs the mean gain of its features. Gumbel noise from a hash of the document's
id makes the k highest scores a sample drawn in proportion to the weights. The k-th score is found by bisection: jobs
that only count how many persisted scores reach a threshold, then, among equal scores, how many ids lie below one. The
rows drawn are range-partitioned to be numbered. The driver holds one gain per bucket and a few counts.
"""
from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from tabulario.llm.common import Memo, materialize
from tabulario.operators import quantiles as Q

#: In UTF-8 after lower-casing ASCII: runs of digits, a-z and all bytes of characters beyond ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Settings:
    """Features are runs of 1 to `longest` words, hashed into `buckets`. Of the documents with `least_words` words or more
    `percent` in a hundred are drawn; `seed` starts the text whose hash is a document's noise. A bisection job counts
    `cuts` thresholds at once."""

    longest: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: int = 2024
    scale: int = 1_000
    cuts: int = 15


class Features:
    """Buckets of the features of texts given as UTF-8 bytes."""

    def __init__(self, s: Settings):
        self.s = s
        self.memo = Memo(lambda features: [zlib.crc32(f) % s.buckets for f in features])

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All buckets one after the other, the number of features of each text and its number of words."""
        found, words = [], []
        for t in texts:
            ws = WORD.findall(t.lower())
            words.append(len(ws))
            for n in range(2, self.s.longest + 1):
                ws = ws + [b" ".join(r) for r in zip(*[ws[i:words[-1]] for i in range(n)])]
            found.append(ws)
        self.memo.learn(set().union(*found))
        size = np.fromiter(map(len, found), np.int64, len(found))
        get = self.memo.__getitem__
        return np.fromiter((b for fs in found for b in map(get, fs)), np.int64, int(size.sum())), size, np.array(words, np.int64)


def slices(texts: list[bytes], size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Consecutive lists of texts of about `size` bytes; a longer text stands alone."""
    block, held = [], 0
    for t in texts:
        if block and held + len(t) > size:
            yield block
            block, held = [], 0
        block.append(t)
        held += len(t)
    if block:
        yield block


def text_bytes(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")


def bucket_counts(df: DataFrame, text: str, s: Settings) -> np.ndarray:
    """How many features of all texts fall into each bucket. Each task sends one row per bucket it met."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features, total = Features(s), np.zeros(s.buckets, np.int64)
        for batch in batches:
            for block in slices(batch["_text"].tolist()):
                total += np.bincount(features(block)[0], minlength=s.buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    rows = df.select(text_bytes(text).alias("_text")).mapInPandas(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect()
    out = np.zeros(s.buckets, np.int64)
    for bucket, n in rows:  # at most one row per bucket
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray, s: Settings) -> np.ndarray:
    """Floored log ratio of each bucket's smoothed share in the target to that in the raw texts."""
    all_raw, all_target = int(raw.sum()), int(target.sum())
    ratio = lambda r, t: float((t + 1) * (all_raw + s.buckets)) / float((r + 1) * (all_target + s.buckets))
    return np.array([math.floor(s.scale * math.log(ratio(r, t))) for r, t in zip(raw.tolist(), target.tolist())], np.int64)


def weigh(df: DataFrame, gain: np.ndarray, s: Settings, text: str = "text", into: str = "weighed") -> DataFrame:
    """Add the struct `into` (n_features, n_words, weight); the weight of a text without features is 0."""

    @pandas_udf("n_features long, n_words long, weight long")
    def weighed(texts: pd.Series) -> pd.DataFrame:
        features, out = Features(s), []
        for block in slices(texts.tolist()):
            buckets, size, words = features(block)
            total = np.r_[0, np.cumsum(gain[buckets])]
            end = np.cumsum(size)
            out.append(pd.DataFrame({"n_features": size, "n_words": words,
                                     "weight": (total[end] - total[end - size]) // np.maximum(size, 1)}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"n_features": [], "n_words": [], "weight": []}, dtype=np.int64)

    return df.withColumn(into, weighed(text_bytes(text)))


def noise(key: Column, s: Settings) -> Column:
    """Floored Gumbel noise of a key: the first 32 bits of the SHA-256 of `seed:key`, spread over (0, 1)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{s.seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(s.scale)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def bisect(rows: DataFrame, column: str, wanted: int, s: Settings, low: int, high: int) -> int:
    """The smallest threshold from `low` to `high` that at least `wanted` values of `column` do not exceed; all are at most `high`."""
    while low < high:
        width = high - low
        points = sorted({low + width * i // (s.cuts + 1) for i in range(1, s.cuts + 1)} | {low + width // 2})
        counts = rows.agg(*[F.count_if(F.col(column) <= p) for p in points]).head()
        reached = [p for p, n in zip(points, counts) if n >= wanted]
        missed = [p for p, n in zip(points, counts) if n < wanted]
        low, high = max(missed, default=low - 1) + 1, min(reached, default=high)
    return low


def draw(scored: DataFrame, k: int, s: Settings) -> DataFrame:
    """Add `rank` (1 to k, else null) to the rows of a persisted frame (_id, score, n_features, able): highest scores
    first, ties to smaller ids, then to fewer features."""
    able = scored.where("able").select("_id", "n_features", "score", (-F.col("score")).alias("_down"))
    nothing = scored.withColumn("rank", F.lit(None).cast("long"))
    if k <= 0:
        return nothing
    first, last = able.agg(F.min("_down"), F.max("_down")).head()
    cut = bisect(able, "_down", k, s, first, last)
    tied = able.where(F.col("_down") == cut)
    missing = k - able.where(F.col("_down") < cut).count()
    first, last = tied.agg(F.min("_id"), F.max("_id")).head()
    last_id = bisect(tied, "_id", missing, s, first, last)
    down = -F.col("score")
    chosen = F.coalesce(F.col("able") & ((down < cut) | ((down == cut) & (F.col("_id") <= last_id))), F.lit(False))
    # ranges of the order that hold repeated rows together are numbered apart, with what the ranges before hold
    place = F.row_number().over(W.partitionBy("_range").orderBy(F.desc("score"), "_id", "n_features", "_row"))
    order = [F.desc("score"), F.asc("_id"), F.asc("n_features"), F.asc("_row")]
    placed = Q.ranges(scored.where(chosen).withColumn("_row", F.monotonically_increasing_id()), *order)
    held = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row per range
    numbered = placed.join(F.broadcast(held.select("_range", before.alias("_before"))), "_range").withColumn("_place", place + F.col("_before"))
    # only rows that repeat the last id can come after the k-th place
    ranked = numbered.withColumn("rank", F.when(F.col("_place") <= k, F.col("_place").cast("long")))
    return ranked.select(nothing.columns).unionByName(nothing.where(~chosen))


def report(df: DataFrame, target: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, n_features, weight, score and rank (null where not drawn) of every row, as longs.

    Both frames have `text`. Null and empty texts have no features and weight 0; whole texts count, however long. Rows
    without a key have a null score, cannot be drawn and do not count among those of which a share is drawn, though their
    texts count as raw text. Repeated rows count each; they share a score and take successive ranks. An empty target or
    table gives gains of smoothing alone, or no rows. Other columns are not looked at.
    """
    s = settings
    gain = gains(bucket_counts(df, text, s), bucket_counts(target, text, s), s)
    slim = df.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))
    scored = materialize(weigh(slim, gain, s, "_text", "_w").select(
        "_id", "_w.n_features", "_w.weight", (F.col("_w.weight") + noise(F.col("_id"), s)).alias("score"),
        ((F.col("_w.n_words") >= s.least_words) & F.col("_id").isNotNull()).alias("able")))
    k = scored.where("able").count() * s.percent // 100
    return draw(scored, k, s).select(F.col("_id").alias(key), "n_features", "weight", "score", "rank")
