"""Best-fit packing by patterns (operator 6).

Documents become pieces of at most `room` tokens; all that matters for packing is the histogram of piece lengths, which
has at most `room` entries whatever the corpus. Patterns of one to three lengths that fill a sequence are enumerated,
their repeat counts are fitted to the histogram by non-negative least squares and rounded down, and what is left is
packed best-fit, again by counts. A piece then finds its place from its rank among the pieces of its length: ranks are
counted per task and shifted by the counts of the tasks before, so a frequent length is never gathered in one place.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from tabulario.llm.bpe import blocks, byte_bpe
from tabulario.llm.common import materialize, text_column

PIECE = "piece int, start long, length long, ids_crc32 long, _part int, _local long"
#: A pattern: (length, copies) pairs that lie in a sequence one after the other.
Pattern = tuple[tuple[int, int], ...]


def cut(n: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of all pieces of documents of n tokens: full ones, but for each first one, which takes what is over."""
    count = -(-n // room)
    document = np.repeat(np.arange(len(n)), count)
    piece = np.arange(len(document)) - np.repeat(np.cumsum(count) - count, count)
    first = n - (count - 1) * room
    start = np.where(piece == 0, 0, first[document] + (piece - 1) * room)
    return document, piece, start, np.where(piece == 0, first[document], room)


def checksums(ids: list[bytes], pieces: np.ndarray, start: np.ndarray, tail: bytes) -> np.ndarray:
    """CRC-32 of every piece; each document's bytes are `ids` and then `tail`, which may be cut off from them."""
    out, at = np.empty(len(start), np.int64), 0
    crc = zlib.crc32
    for data, n in zip(ids, pieces.tolist()):
        if n == 1:
            out[at] = crc(tail, crc(data))
        else:
            view = memoryview(data)
            for i in range(at, at + n - 1):
                out[i] = crc(view[4 * start[i]:4 * start[i + 1]])
            out[at + n - 1] = crc(tail, crc(view[4 * start[at + n - 1]:]))
        at += n
    return out


def ranks(length: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The number of pieces of the same length before each one; `seen` holds those of earlier calls and is brought forward."""
    order = np.argsort(length, kind="stable")
    count = np.bincount(length, minlength=len(seen))
    begin = np.cumsum(count) - count
    rank = np.empty(len(length), np.int64)
    rank[order] = np.arange(len(length)) - begin[length[order]]
    rank += seen[length]
    seen += count
    return rank


def fill_patterns(lengths: np.ndarray, room: int) -> np.ndarray:
    """Rows of up to three lengths (0 where none) from those present that fill `room` exactly."""
    there = np.zeros(room + 1, bool)
    there[lengths] = True
    a = np.sort(lengths)[::-1].astype(np.int64)
    pairs = np.stack([a, room - a, np.zeros_like(a)], 1)
    pairs = pairs[(pairs[:, 0] >= pairs[:, 1]) & (pairs[:, 1] > 0) & there[np.clip(room - a, 0, room)]]
    triples = [np.zeros((0, 3), np.int64)]
    for x in a[a >= room / 3]:
        y = a[(a <= x) & (a < room - x)]
        z = room - x - y
        ok = (z <= y) & (z > 0)
        ok[ok] = there[z[ok]]
        triples.append(np.stack([np.full(ok.sum(), x), y[ok], z[ok]], 1))
    return np.concatenate([pairs, *triples])


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative repeat counts x that bring the patterns' lengths near the histogram: accelerated projected gradient."""
    if not len(patterns):
        return np.zeros(0)
    scale = max(1.0, float(histogram.max()))
    target = histogram / scale
    target[0] = 0

    def used(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(patterns[:, j], x, len(target)) for j in range(3))
        out[0] = 0
        return out

    v = np.ones(len(patterns))
    for _ in range(20):  # the largest eigenvalue bounds the step
        w = used(v)[patterns].sum(1)
        norm = np.linalg.norm(w)
        v = w / norm
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        step = np.maximum(0, y - (used(y) - target)[patterns].sum(1) / (1.05 * norm))
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        x, y = step, step + (before - 1) / t * (step - x)
    return x * scale


def pack_histogram(histogram: np.ndarray, room: int) -> list[tuple[Pattern, int]]:
    """(pattern, repeats) that use up the histogram exactly. `histogram[l]` is the number of pieces of length l."""
    left = histogram.astype(np.int64).copy()
    packed: list[tuple[Pattern, int]] = []
    if left[room]:
        packed.append((((room, 1),), int(left[room])))
        left[room] = 0
    patterns = fill_patterns(np.flatnonzero(left), room)
    repeats = np.floor(fit_repeats(patterns, left) + 1e-6).astype(np.int64)
    for i in np.argsort(-repeats, kind="stable"):
        if not repeats[i]:
            break
        lengths, copies = np.unique(patterns[i][patterns[i] > 0], return_counts=True)
        n = int(min(repeats[i], (left[lengths] // copies).min()))
        if n:
            left[lengths] -= n * copies
            packed.append((tuple((int(v), int(c)) for v, c in zip(lengths[::-1], copies[::-1])), n))
    return packed + best_fit(left, room)


def best_fit(left: np.ndarray, room: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over counts: sequences with equal content are filled together."""
    groups: dict[int, list[list]] = {}
    for length in range(len(left) - 1, 0, -1):
        count = int(left[length])
        while count:
            space = next((s for s in range(length, room) if groups.get(s)), None)
            pattern, n = ((), count) if space is None else groups[space].pop()
            space = room if space is None else space
            copies = space // length
            full = min(n, count // copies)
            if full:
                groups.setdefault(space - copies * length, []).append([(*pattern, (length, copies)), full])
                count -= full * copies
            if full < n and pattern:  # sequences of this kind that stay open
                one = 1 if 0 < count < copies else 0
                if one:
                    groups.setdefault(space - count * length, []).append([(*pattern, (length, count)), 1])
                    count = 0
                if n - full - one:
                    groups.setdefault(space, []).append([pattern, n - full - one])
            elif full < n and 0 < count < copies:
                groups.setdefault(space - count * length, []).append([((length, count),), 1])
                count = 0
    return [(p, n) for members in groups.values() for p, n in members]


def places(packed: list[tuple[Pattern, int]], room: int) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: ranks from `start` on to `repeats` sequences from `sequence` on, `copies` each."""
    rows, sequence, taken = [], 0, np.zeros(room + 1, np.int64)
    for pattern, repeats in packed:
        offset = 0
        for length, copies in pattern:
            rows.append((length, taken[length], sequence, copies, offset))
            taken[length] += repeats * copies
            offset += length * copies
        sequence += repeats
    rows = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"key": (rows[:, 0] << 44) | rows[:, 1], "start": rows[:, 1], "sequence": rows[:, 2], "copies": rows[:, 3], "offset": rows[:, 4]}


def pack(df: DataFrame, path: str, room: int = 1024, end: int = 2, key: str = "doc_id", text: str = "text",
         keep_ids: bool = False, chars: int = 1 << 21) -> DataFrame:
    """Pack the tokens of all texts, each followed by id `end`, into sequences of at most `room`.

    One row per piece: `key`, piece, start, length, ids_crc32, sequence_id, offset, and with `keep_ids` its `ids`.
    A null or empty text is one piece holding the end id. Repeated rows are packed as often as they come; a row keeps
    whatever key it has, null included. An empty table gives no rows. The driver sees only the histogram.
    """
    spark = df.sparkSession
    key_type = df.schema[key].dataType.simpleString()
    tail = int(end).to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, seen = byte_bpe(path), TaskContext.get().partitionId(), np.zeros(room + 1, np.int64)
        for batch in batches:
            keys, texts, at = batch.column(0), batch.column(1).to_pylist(), 0
            for block in blocks(texts, chars):
                ids = bpe.encode(block)
                n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4 + 1
                document, piece, start, length = cut(n, room)
                columns = [keys.take(pa.array(document + at)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                           pa.array(checksums(ids, np.bincount(document, minlength=len(n)), start, tail)),
                           pa.array(np.full(len(piece), part), pa.int32()), pa.array(ranks(length, seen))]
                if keep_ids:  # pieces follow each other without gaps
                    flat = np.frombuffer(tail.join([*ids, b""]), "<i4")
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)], pa.int32()), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(columns, names)
                at += len(block)

    names = ["_key", *(c.split()[0] for c in PIECE.split(", "))] + (["_ids"] if keep_ids else [])
    cut_up = materialize(df.select(F.col(key).alias("_key"), text_column(text).alias("_text")).mapInArrow(
        pieces, f"_key {key_type}, {PIECE}" + (", _ids array<int>" if keep_ids else "")))
    counts = cut_up.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    histogram = np.zeros(room + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect():  # at most `room` rows
        histogram[r["length"]] = r["n"]
    # patterns of up to three lengths and what best-fit adds: bounded by `room`, not by the corpus
    place = spark.sparkContext.broadcast(places(pack_histogram(histogram, room), room))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))

    @pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        p, length, rank = place.value, length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(p["key"], (length << 44) | rank, side="right") - 1
        inside = rank - p["start"][at]
        return pd.DataFrame({"sequence_id": p["sequence"][at] + inside // p["copies"][at],
                             "offset": p["offset"][at] + inside % p["copies"][at] * length})

    ranked = cut_up.join(shift, ["length", "_part"])
    return ranked.withColumn("_p", placed("length", F.col("_local") + F.col("_shift"))).select(
        F.col("_key").alias(key), "piece", "start", "length", "ids_crc32", F.col("_p.sequence_id").alias("sequence_id"),
        F.col("_p.offset").alias("offset"), *([F.col("_ids").alias("ids")] if keep_ids else []))
