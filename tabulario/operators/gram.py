"""Correlations of every pair of columns from masked Gram matrices.

A batch of rows is a matrix X with 0 where a cell is missing and a mask M. The products M'M, X'M, (X^2)'M and X'X hold, for
every pair, how many rows have both cells and the sums over just those rows. They are kept as counts, means and sums of
squares about the mean, which merge without cancellation, so no pass for the means comes first. A task hands on one row
per column; rows of a column meet in one task, which adds them as they come. The work per row is a matrix product
whatever the number of columns, and the plan has no expression per pair.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Of a pair: rows with both, mean of the first and of the second, sums of squares about them, sum of products about them.
FIELDS = ("n", "mean_a", "mean_b", "square_a", "square_b", "product")
STATE = "i int, " + ", ".join(f"{f} array<double>" for f in FIELDS)
#: A sum of squares this small beside the size of its values is rounding: the column does not vary.
ROUNDING = 1e-13
#: Rows times columns that a matrix product takes at a time.
CELLS = 2_000_000


def moments(x: np.ndarray) -> np.ndarray:
    """FIELDS of every ordered pair of columns, of shape (6, k, k). NaN is a missing cell."""
    m = ~np.isnan(x)
    count = m.sum(0)
    with np.errstate(invalid="ignore", over="ignore"):
        centre = np.where(count > 0, np.where(m, x, 0).sum(0) / np.maximum(count, 1), 0)
        x, m = np.where(m, x - centre, 0), m.astype(float)
        n = m.T @ m
        least = np.maximum(n, 1)
        total, square = x.T @ m, (x * x).T @ m  # [i, j]: over column i, where j is there too
        mean = total / least
        about = np.maximum(square - total * mean, 0)
        mean = np.where(n > 0, mean + centre[:, None], 0)
        return np.stack([n, mean, mean.T, about, about.T, x.T @ x - total * total.T / least])


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """FIELDS of two sets of rows taken together."""
    n = a[0] + b[0]
    with np.errstate(invalid="ignore", over="ignore"):
        share = b[0] / np.maximum(n, 1)
        da, db, weight = b[1] - a[1], b[2] - a[2], a[0] * share
        empty = (a[0] == 0) | (b[0] == 0)
        da, db = np.where(empty, 0, da), np.where(empty, 0, db)
        mean_a = np.where(a[0] == 0, b[1], a[1] + da * share)
        mean_b = np.where(a[0] == 0, b[2], a[2] + db * share)
        return np.stack([n, mean_a, mean_b, a[3] + b[3] + da * da * weight, a[4] + b[4] + db * db * weight,
                         a[5] + b[5] + da * db * weight])


def coefficient(s: np.ndarray) -> np.ndarray:
    """Pearson's r of merged FIELDS; NaN where it is not defined."""
    n, mean_a, mean_b, square_a, square_b, product = s
    flat_a, flat_b = (q <= ROUNDING * ROUNDING * n * mean * mean for q, mean in ((square_a, mean_a), (square_b, mean_b)))
    with np.errstate(invalid="ignore", divide="ignore"):
        r = product / np.sqrt(square_a) / np.sqrt(square_b)
    return np.where((n < 2) | flat_a | flat_b, np.nan, np.clip(r, -1, 1))


def pair_correlations(typed: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, n, r) of every pair of columns of `typed`, doubles in the order of `names`; a comes before b there.

    n counts rows where both are present. r is null for fewer than two rows or a column that does not vary, and for
    infinite values. An empty table gives every pair with n = 0.
    """
    k = len(names)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = np.zeros((6, k, k))
        step = max(1, CELLS // max(k, 1))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                rows = batch.slice(at, step)
                x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in rows.columns], 1)
                state = merge(state, moments(x))
        yield _rows(range(k - 1), [state[:, i, i + 1:] for i in range(k - 1)])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, np.ndarray] = {}
        for batch in batches:
            columns = [batch.column(1 + f) for f in range(len(FIELDS))]
            for at, i in enumerate(batch.column(0).to_pylist()):
                own = np.stack([c[at].values.to_numpy() for c in columns])
                states[i] = merge(states[i], own) if i in states else own
        i = np.repeat(list(states), [k - 1 - i for i in states]).astype(np.int32)
        j = np.concatenate([np.zeros(0, np.int32), *[np.arange(i + 1, k) for i in states]]).astype(np.int32)
        n = np.concatenate([np.zeros(0), *[s[0] for s in states.values()]]).astype(np.int64)
        r = np.concatenate([np.zeros(0), *[coefficient(s) for s in states.values()]])
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(n), pa.array(r, mask=np.isnan(r))], ["i", "j", "n", "r"])

    spark = typed.sparkSession
    pairs = spark.range(k * k).select(F.expr(f"cast(id div {max(k, 1)} as int)").alias("i"), F.expr(f"cast(id % {max(k, 1)} as int)").alias("j")).where("i < j")
    if k < 2:
        found = spark.createDataFrame([], "i int, j int, n bigint, r double")
    else:
        found = typed.mapInArrow(partial, STATE).repartition("i").mapInArrow(merged, "i int, j int, n bigint, r double")
    name = F.array(*map(F.lit, names)) if names else F.array(F.lit(""))
    return pairs.join(found, ["i", "j"], "left").select(
        F.get(name, F.col("i")).alias("a"), F.get(name, F.col("j")).alias("b"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "r")


def _rows(index: range, states: list[np.ndarray]) -> pa.RecordBatch:
    """One row per column `i`: its FIELDS against the columns after it."""
    offsets = pa.array(np.r_[0, np.cumsum([s.shape[1] for s in states])].astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([s[f] for s in states]))) for f in range(len(FIELDS))]
    return pa.RecordBatch.from_arrays([pa.array(list(index), pa.int32()), *lists], ["i", *FIELDS])
