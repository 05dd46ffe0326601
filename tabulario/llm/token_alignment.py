"""Alignment of two tokenizers (operator 12).

A text with a blank before it is cut into units at blanks after a word, where tokens of both vocabularies always end, and
each distinct unit is tokenized and aligned once. Byte offsets where tokens of both end cut a unit into groups, and every
pair of an A and a B token of a group is a link.

An array holds the B id with the same bytes of every A id. Links with that id, which are all of the exact one-to-one
groups, are counted in one vector as long as the vocabulary; only other pairs of ids enter the shuffle, counted per
block of texts before it. Their counts come back to the blocks that hold them, each block with its texts.
"""
from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulario.llm.bpe import byte_bpe
from tabulario.llm.common import SPACE, Memo, text_column
from tabulario.session import checkpoint_folder

#: A blank with what follows up to the next blank after a character that is no white space.
UNIT = re.compile(f" [^ ]*(?:(?<=[{SPACE}]) [^ ]*)*")
INNER = re.compile(f"[{SPACE}]")
BLANK = "▁"
ROWS = ("kind int, block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "same binary, others binary, a array<int>, pair array<long>, held array<long>")


@dataclass(frozen=True)
class Settings:
    """A block has about `chars` characters of text, a longer text is a block of its own; workers remember `memo` units."""

    chars: int = 1 << 21
    memo: int = 150_000


#: A unit: numbers of tokens and groups, its groups as text, and its distinct links (a << 32 | b) with how often each comes.
Unit = tuple[int, int, int, str, bytes, bytes]
#: A unit that a vocabulary does not give back has no tokens.
NOTHING: Unit = (0, 0, 0, "", b"", b"")


class Aligner:
    """Both vocabularies, as arrays of the bytes of each id."""

    def __init__(self, path_a: str, path_b: str, bound: int):
        import sentencepiece

        self.a = byte_bpe(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.blank = self.b.piece_to_id(BLANK)
        of: dict[bytes, int] = {}
        for i, x in enumerate(self.bytes_b):
            if not self.b.is_control(i) and not self.b.is_unknown(i) and (x not in of or self.b.is_byte(of[x])):
                of[x] = i
        self.bytes_a = [self.a.piece_bytes[s:s + n].tobytes() for s, n in zip(self.a.piece_start.tolist(), self.a.piece_len.tolist())]
        special = set(self.a.special.values())
        #: The B id with the bytes of each A id, -1 where there is none.
        self.same = np.array([-1 if i in special else of.get(x, -1) for i, x in enumerate(self.bytes_a)], np.int64)
        self.flat_b = np.frombuffer(b"".join(self.bytes_b), np.uint8)
        self.start_b = np.cumsum(self.size_b) - self.size_b
        #: Ids in the text form: followed by `,`, or as the last A or B id of a group by `|` or `;`.
        ids = range(max(len(self.same), len(self.bytes_b)))
        self.words = [f"{i}," for i in ids] + [f"{i}|" for i in ids] + [f"{i};" for i in ids]
        self.memo = Memo(self._units, bound)

    def _ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all units one after the other and how many each has, of A and of B."""
        single = [INNER.search(u, 1) is None for u in units]  # one of A's own units
        own = iter(self.a._units([u for u, one in zip(units, single) if one]) if any(single) else [])
        other = iter(self.a._plain([u for u, one in zip(units, single) if not one]))
        parts = [next(own) if one else next(other) for one in single]
        a, n_a = np.frombuffer(b"".join(parts), "<u4").astype(np.int64), np.array([len(x) for x in parts], np.int64) // 4
        found = self.b.encode([u[1:] for u in units], num_threads=1)
        found = [x if len(u) > 1 else [self.blank] for u, x in zip(units, found)]
        n_b = np.array([len(x) for x in found], np.int64)
        return a, n_a, np.fromiter(chain.from_iterable(found), np.int64, int(n_b.sum())), n_b

    def _sound(self, units: list[str], b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """Whether the bytes of each unit's B ids are its own. Those of A are for every text."""
        raw = [u.encode() for u in units]
        size, length = np.array([len(x) for x in raw], np.int64), self.size_b[b]
        of_unit = np.repeat(np.arange(len(units)), n_b)
        out = np.bincount(of_unit, length, minlength=len(units)) == size
        length = length[out[of_unit]]
        at = np.repeat(self.start_b[b[out[of_unit]]] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        differ = self.flat_b[at] != np.frombuffer(b"".join([x for x, ok in zip(raw, out.tolist()) if ok]), np.uint8)
        out[np.repeat(np.flatnonzero(out), size[out])[differ]] = False
        return out

    def _units(self, units: list[str]) -> list[Unit]:
        a, n_a, b, n_b = self._ids(units)
        sound = self._sound(units, b, n_b)
        kept = np.flatnonzero(sound)
        if not len(kept):
            return [NOTHING] * len(units)
        a, b = a[np.repeat(sound, n_a)], b[np.repeat(sound, n_b)]
        n_a, n_b = n_a[kept], n_b[kept]
        end_a, end_b = np.cumsum(self.a.piece_len[a]), np.cumsum(self.size_b[b])
        # offsets in all units one after the other; the end of a unit is an end on both sides
        ends = np.intersect1d(end_a, end_b)
        group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        unit_a, unit_b = np.repeat(np.arange(len(kept)), n_a), np.repeat(np.arange(len(kept)), n_b)
        n_groups = np.bincount(unit_a[np.r_[True, group_a[1:] != group_a[:-1]]], minlength=len(kept))
        # every A token with the B tokens of its group, which lie side by side
        first, many = np.searchsorted(group_b, np.arange(len(ends))), np.bincount(group_b, minlength=len(ends))
        repeat = many[group_a]
        at = np.repeat(first[group_a] - (np.cumsum(repeat) - repeat), repeat) + np.arange(repeat.sum())
        link = np.repeat(a << 32, repeat) | b[at]
        of_unit = np.repeat(unit_a, repeat)
        order = np.lexsort((link, of_unit))
        link, of_unit = link[order], of_unit[order]
        new = np.flatnonzero(np.r_[True, (link[1:] != link[:-1]) | (of_unit[1:] != of_unit[:-1])])
        times = np.diff(np.r_[new, len(link)])
        link, cut = link[new], np.searchsorted(of_unit[new], np.arange(len(kept) + 1))
        last_a, last_b = np.r_[group_a[1:] != group_a[:-1], True], np.r_[group_b[1:] != group_b[:-1], True]
        third = len(self.words) // 3
        code = np.r_[a + third * last_a, b + 2 * third * last_b]
        order = np.lexsort((np.repeat([0, 1], [len(a), len(b)]), np.r_[group_a, group_b]))  # stable: tokens of a side keep their order
        words = [self.words[i] for i in code[order].tolist()]
        begin, cut = np.r_[0, np.cumsum(n_a + n_b)].tolist(), (8 * cut).tolist()
        links, times = link.tobytes(), times.tobytes()
        made = zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), ["".join(words[x:y]) for x, y in zip(begin, begin[1:])],
                   [links[x:y] for x, y in zip(cut, cut[1:])], [times[x:y] for x, y in zip(cut, cut[1:])])
        return [next(made) if ok else NOTHING for ok in sound.tolist()]

    def texts(self, texts: list[str]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
        """One row per text, and all distinct links of each text: number of the text, link and how often it comes, in this order."""
        units = [UNIT.findall(" " + t) if t else [] for t in texts]
        distinct = list(set().union(*units))
        self.memo.learn(set(distinct))
        code = {u: k for k, u in enumerate(distinct)}
        found = [self.memo[u] for u in distinct]
        columns = list(zip(*found)) if found else [()] * len(NOTHING)
        counts = np.array(columns[:3], np.int64).reshape(3, len(found))
        bad = counts[0] == 0
        size = np.fromiter(map(len, units), np.int64, len(units))
        codes = np.fromiter(map(code.__getitem__, chain.from_iterable(units)), np.int64, int(size.sum()))
        text = np.repeat(np.arange(len(texts)), size)
        none = size == 0
        none[text[bad[codes]]] = True
        keep = ~none[text]
        end = np.cumsum(size).tolist()
        forms, rows = [columns[3][c] for c in codes.tolist()] if found else [], {}
        rows["groups_sha256"] = ["" if no else hashlib.sha256("".join(forms[x:y])[:-1].encode()).hexdigest() for x, y, no in zip([0, *end], end, none.tolist())]
        codes, text = codes[keep], text[keep]
        for name, per in zip(("n_a", "n_b", "n_groups"), counts):
            rows[name] = np.bincount(text, weights=per[codes], minlength=len(texts)).astype(np.int64)
        many = np.array([len(x) for x in columns[4]], np.int64) // 8
        link, times = (np.frombuffer(b"".join(columns[c]), np.int64) for c in (4, 5))
        both, often = np.unique(text * np.int64(max(1, len(distinct))) + codes, return_counts=True)
        text, codes = both // max(1, len(distinct)), both % max(1, len(distinct))
        begin, repeat = np.cumsum(many) - many, many[codes]
        at = np.repeat(begin[codes] - (np.cumsum(repeat) - repeat), repeat) + np.arange(repeat.sum())
        text, link, times = np.repeat(text, repeat), link[at], times[at] * np.repeat(often, repeat)
        order = np.lexsort((link, text))
        text, link, times = text[order], link[order], times[order]
        new = np.flatnonzero(np.r_[True, (link[1:] != link[:-1]) | (text[1:] != text[:-1])][:len(link)])
        times = np.add.reduceat(times, new) if len(new) else times
        text, link = text[new], link[new]
        rows["n_links"] = np.bincount(text, weights=times, minlength=len(texts)).astype(np.int64)
        return pd.DataFrame(rows), text, link, times


@functools.lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str, bound: int) -> Aligner:
    return Aligner(path_a, path_b, bound)


def blocks(rows: Iterator[tuple], chars: int) -> Iterator[list[tuple]]:
    """Consecutive rows (id, text) whose texts have about `chars` characters."""
    block, held = [], 0
    for row in rows:
        if block and held + len(row[1]) > chars:
            yield block
            block, held = [], 0
        block.append(row)
        held += len(row[1])
    if block:
        yield block


def packed(number: np.ndarray, times: np.ndarray) -> bytes:
    return np.stack((number, times), 1).astype("<u4").tobytes()


def aligned(df: DataFrame, path_a: str, path_b: str, s: Settings) -> DataFrame:
    """Rows of three kinds, see ROWS: 0 a text with its links (`same`: ids of A, `others`: places in the block's list of pairs,
    each with how often it comes), 1 a block's list of pairs and in how many of its texts each is, 2 a task's vector of
    A ids and in how many texts each is linked to the B id of its bytes."""

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        work = aligner(path_a, path_b, s.memo)
        vector = np.zeros(len(work.same), np.int64)
        part = TaskContext.get().partitionId()
        names = [c.split()[0] for c in ROWS.split(", ")]
        blank = lambda n, **cols: pd.DataFrame({c: cols.get(c, [None] * n) for c in names})
        rows = ((i, t) for batch in batches for i, t in zip(batch["_id"].astype("Int64"), batch["_text"]))
        for number, block in enumerate(blocks(rows, s.chars)):
            found, text, link, times = work.texts([t for _, t in block])
            a = link >> 32
            plain = work.same[a] == link & 0xFFFFFFFF
            vector += np.bincount(a[plain], minlength=len(vector))
            pairs, place, held = np.unique(link[~plain], return_inverse=True, return_counts=True)
            cut = np.searchsorted(text[plain], np.arange(len(block) + 1)).tolist()
            same = packed(a[plain], times[plain])
            cut_others = np.searchsorted(text[~plain], np.arange(len(block) + 1)).tolist()
            others = packed(place, times[~plain])
            here = (part << 33) | number
            yield blank(len(block), kind=0, block=here, doc_id=pd.array([i for i, _ in block], "Int64"),
                        **{c: found[c] for c in found.columns},
                        same=[same[8 * x:8 * y] for x, y in zip(cut, cut[1:])], others=[others[8 * x:8 * y] for x, y in zip(cut_others, cut_others[1:])])
            if len(pairs):
                yield blank(1, kind=1, block=here, pair=[pairs], held=[held])
        at = np.flatnonzero(vector)
        yield blank(1, kind=2, a=[at.astype(np.int32)], held=[vector[at]])

    return df.mapInPandas(align, ROWS)


def report(df: DataFrame, path_a: str, path_b: str, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` (long), n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    Texts that are null or empty, or that either vocabulary does not give back byte for byte (such as those with U+2581),
    have zeros and an empty digest. Special tokens' strings inside texts are plain text. Each row counts as a document,
    repeated ones too; ids may be null. Whole texts are aligned, however long. Other columns are not looked at; an empty
    table gives no rows.
    """
    s, spark = settings, df.sparkSession
    slim = df.select(F.col(key).cast("long").alias("_id"), text_column(text).alias("_text"))
    # alignment is costly and read several times, so it is written once
    folder = f"{checkpoint_folder(spark).rstrip('/')}/alignment-{spark.sparkContext.applicationId}-{unique()}"
    aligned(slim, path_a, path_b, s).write.parquet(folder)
    rows = spark.read.schema(ROWS).parquet(folder)
    lists = rows.where("kind = 1").select("block", F.posexplode(F.arrays_zip("pair", "held")).alias("place", "x")).select(
        "block", "place", F.col("x.pair").alias("pair"), F.col("x.held").alias("held"))
    counts = lists.groupBy("pair").agg(F.sum("held").alias("n"))
    vector = rows.where("kind = 2").select(F.explode(F.arrays_zip("a", "held")).alias("x")).groupBy("x.a").agg(F.sum("x.held"))
    best = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n"))
    same_n, best_n = dict(vector.collect()), dict(best.collect())  # at most as many rows as the vocabulary has ids
    size = max([*same_n, *best_n], default=-1) + 1
    same = np.array([same_n.get(i, 0) for i in range(size)], np.int64)
    top = np.array([max(same_n.get(i, 0), best_n.get(i, 0)) for i in range(size)], np.int64)
    shared = spark.sparkContext.broadcast((same, top))
    tops = F.broadcast(spark.createDataFrame(pd.DataFrame({"a": np.arange(size), "top": top}), "a long, top long"))
    # a pair of every block is a hot key of the list side alone, which adaptive execution splits
    back = lists.select("block", "place", "pair").join(
        counts.withColumn("a", F.shiftright("pair", 32)).join(tops, "a"), "pair").select("block", "place", "n", (F.col("n") == F.col("top")).alias("best"))

    def scored(texts: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        same, top = shared.value
        pairs = pairs.sort_values("place")
        n, of_best = pairs["n"].to_numpy(np.int64), pairs["best"].to_numpy(bool)
        out = texts[["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]].copy()
        total, hits = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for column, count, is_best in (("same", same, same == top), ("others", n, of_best)):
            raw = texts[column].tolist()
            many = np.array([len(x) // 8 for x in raw], np.int64)
            flat = np.frombuffer(b"".join(raw), "<u4").reshape(-1, 2).astype(np.int64)
            row = np.repeat(np.arange(len(texts)), many)
            np.add.at(total, row, count[flat[:, 0]] * flat[:, 1])
            np.add.at(hits, row, is_best[flat[:, 0]] * flat[:, 1])
        return out.assign(n_best=hits, count_sum=total)

    texts = spark.read.schema(ROWS).parquet(folder).where("kind = 0").select(
        "block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "same", "others")
    out = texts.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(
        scored, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    return out.select(F.col("doc_id").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def unique() -> str:
    """A name that no other call of any driver takes."""
    import uuid

    return uuid.uuid4().hex
