"""Approximate nearest neighbours by a permutation index (operator 10).

A vector is represented by its nearest pivots in order. Distinct vectors, each with its smallest ids, are dealt into blocks of bounded size; each block posts
its vectors in one inverted file per pivot, with the pivot's place in their order. A query walks the files of its own
pivots and gathers the footrule distance of the two orders, absent pivots counting as last; the nearest share by
footrule is ranked again by exact inner product. Near copies of a pivot have one place in the share together.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from tabulario.llm.common import materialize


@dataclass(frozen=True)
class Settings:
    """`pivots` vectors are sampled as pivots, `places` of them represent a vector; of each block the `share` nearest by
    footrule, `least` at least, are ranked exactly. Vectors whose cosine with their nearest pivot is `crowd` or more count
    as one and are ranked all or none. Blocks hold about `block` distinct vectors and `queries` queries."""

    pivots: int = 256
    places: int = 128
    share: float = 0.2
    least: int = 256
    crowd: float = 0.9
    block: int = 8_192
    queries: int = 1_024
    seed: int = 5


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """_id and _v of vectors that take part: of the commonest length, without null or non-finite numbers, not zero."""
    v = F.col(vector).cast("array<double>")
    whole = df.select(F.col(key).cast("long").alias("_id"), v.alias("_v")).where(
        F.col("_id").isNotNull() & F.col("_v").isNotNull()
        & F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("_v", lambda x: x != 0.0))
    common = whole.groupBy(F.size("_v").alias("n")).count().orderBy(F.desc("count"), "n").head()
    return whole.where(F.size("_v") == (common[0] if common else 0))


def distinct(rows: DataFrame, k: int) -> DataFrame:
    """Each vector once: _v and _ids, the k + 1 smallest of its ids in order with the number of rows n of each.

    Without any one of the ids these are still the first k rows of the vector.
    """
    counted = rows.groupBy("_v", "_id").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("_v").orderBy("_id"))  # limited before the shuffle, so a hot vector is no hot key
    return counted.withColumn("_k", place).where(F.col("_k") <= k + 1).groupBy("_v").agg(
        F.array_sort(F.collect_list(F.struct("_id", "n"))).alias("_ids"))


def spread(vectors: np.ndarray, wanted: int, crowd: float) -> np.ndarray:
    """The first `wanted` unit vectors that are no near copies of earlier ones; near copies only where those are too few."""
    like = np.tril(vectors @ vectors.T >= crowd, -1)
    own = np.zeros(len(vectors), bool)
    for i in range(len(vectors)):
        own[i] = not (like[i] & own).any()
    return vectors[np.argsort(~own, kind="stable")[:wanted]]


def posted(orders: np.ndarray, pivots: int) -> np.ndarray:
    """A file per pivot: its place in every row's order, as far as the end where it is absent."""
    n, size = orders.shape
    files = np.full((pivots, n), size, np.uint16 if size < 256 else np.int32)  # sums of `size` places must fit
    files[orders.ravel(), np.repeat(np.arange(n), size)] = np.tile(np.arange(size), n)
    return files


def footrule(files: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Half the footrule distances of one order to the posted ones, but for a constant of the query.

    A pivot counts |place - places| where it is shared and as far as the end on both sides where it is absent; over the
    pivots of the query this is twice the larger of both places, less what does not depend on the row.
    """
    out, larger = np.zeros(files.shape[1], files.dtype), np.empty(files.shape[1], files.dtype)
    for place, pivot in enumerate(order):
        np.maximum(files[pivot], files.dtype.type(place), out=larger)
        out += larger
    return out


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, settings: Settings = Settings(),
            key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest found per query, by inner product of the vectors in
    double precision; ties go to the smaller id. Both frames have `key` and `vector`; a query never finds its own key.

    Vectors that are null, zero, hold null or non-finite numbers or differ in length from most take no part. A key that
    repeats among `df` is found as often as it comes; repeated queries with one key count once. With fewer than k
    candidates all are returned; an empty table gives no rows.
    """
    spark = df.sparkSession
    rows = materialize(distinct(usable(df, key, vector), k))
    asked = usable(queries, key, vector).dropDuplicates(["_id"])
    n, dimension = rows.agg(F.count("*"), F.coalesce(F.max(F.size("_v")), F.lit(0))).head()
    asked = asked.where(F.size("_v") == dimension)
    picked = rows.select("_v").orderBy(F.xxhash64(F.lit(settings.seed), "_v"), "_v").limit(4 * settings.pivots).collect()
    pivots = np.array([r[0] for r in picked], np.float64).reshape(len(picked), dimension)
    pivots = spread(pivots / np.linalg.norm(pivots, axis=1, keepdims=True), settings.pivots, settings.crowd)
    pivots = spark.sparkContext.broadcast(pivots)  # `pivots` rows

    @pandas_udf("array<smallint>")
    def places(vectors: pd.Series) -> pd.Series:
        # element-wise products summed row by row: equal vectors get equal orders wherever they stand
        near = np.einsum("ij,kj->ik", np.stack(vectors.to_list()), pivots.value)
        return pd.Series(list(np.argsort(-near, axis=1, kind="stable")[:, :settings.places].astype(np.int16)))

    @pandas_udf("int")
    def crowds(vectors: pd.Series, orders: pd.Series) -> pd.Series:
        # the nearest pivot of near copies, -1 for others
        own, first = np.stack(vectors.to_list()), np.array([o[0] for o in orders])
        like = np.einsum("ij,ij->i", own, pivots.value[first]) >= settings.crowd * np.linalg.norm(own, axis=1)
        return pd.Series(np.where(like, first, -1).astype(np.int32))

    vector_blocks = max(1, math.ceil(n / settings.block))
    query_blocks = max(1, math.ceil(asked.count() / settings.queries))
    # both sides of the cogroup need keys of one type, or equal keys hash to different partitions and are not paired
    dealt = lambda blocks, *by: F.pmod(F.xxhash64(F.lit(settings.seed), *by), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    indexed = rows.withColumn("_p", places("_v")).withColumn("_c", crowds("_v", "_p")).withColumn(
        "_b", dealt(vector_blocks, "_v")).withColumn("_q", every(query_blocks))
    wanted = asked.withColumn("_p", places("_v")).withColumn("_q", dealt(query_blocks, "_id", "_v")).withColumn("_b", every(vector_blocks))

    def search(block: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if block.empty or ask.empty:
            return pd.DataFrame([], columns=names)
        block = block.assign(_id=[x[0]["_id"] for x in block["_ids"]]).sort_values("_id", kind="stable")  # ties then go to smaller ids
        ids, vectors, orders, every_id = block["_id"].to_numpy(), np.stack(block["_v"].to_list()), np.stack(block["_p"].to_list()), block["_ids"].to_list()
        after = np.array([x[1]["_id"] if len(x) > 1 else -1 for x in every_id])  # the smallest id where the first is the query's own
        alone = np.array([len(x) == 1 for x in every_id])
        # one number per crowd and per vector of none, in the order of their smallest ids
        code, first, of = np.unique(np.where(block["_c"] < 0, len(pivots.value) + np.arange(len(ids)), block["_c"]), return_index=True, return_inverse=True)
        of = np.argsort(np.argsort(first))[of]
        by_unit = np.argsort(of, kind="stable")
        starts = np.searchsorted(of[by_unit], np.arange(len(code)))
        files = posted(orders, len(pivots.value))
        keep = max(settings.least, math.ceil(settings.share * len(code)))
        out = []
        for own, vector, order in zip(ask["_id"].to_numpy(), ask["_v"], ask["_p"]):
            there = ~(alone & (ids == own))
            if keep < len(code):  # the keep nearest, ties to smaller ids
                far = footrule(files, order)
                far[~there] = np.iinfo(far.dtype).max
                far = np.minimum.reduceat(far[by_unit], starts)
                edge = np.partition(far, keep - 1)[keep - 1]
                chosen = far < edge
                chosen[np.flatnonzero(far == edge)[:keep - chosen.sum()]] = True
                near = np.flatnonzero(chosen[of] & there)
            else:
                near = np.flatnonzero(there)
            score = (vectors[near] * vector).sum(1)
            if len(near) > k:  # only what reaches the k-th score needs an order
                high = ~(score < np.partition(score, len(score) - k)[len(score) - k])
                near, score = near[high], score[high]
            least = np.where(ids[near] == own, after[near], ids[near])
            # each vector brings a row at least, so the first k hold the first k rows
            best = np.lexsort((least, -score))[:k]
            rows = [(x["_id"], score[i]) for i in best for x in every_id[near[i]] if x["_id"] != own for _ in range(min(k, x["n"]))]
            rows = sorted(rows, key=lambda r: (-r[1], r[0]))[:k]
            out += [(own, *r) for r in rows]
        return pd.DataFrame(out, columns=names)

    found = indexed.groupBy("_b", "_q").cogroup(wanted.groupBy("_b", "_q")).applyInPandas(
        search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
