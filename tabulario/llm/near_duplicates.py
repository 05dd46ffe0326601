"""Near-duplicates by SetSketch registers (operator 2).

A document is the set of its five-word shingles. A register keeps the smallest of as many exponential hashes as the set
has shingles, truncated to a power of the base: registers of a union are the larger ones, and two documents agree in a
register about as often as their sets overlap. Runs of registers make bands; documents that agree in a whole band meet
in a bucket. In a few rounds every document is compared with one hub of its buckets, by the joint likelihood of their
registers and, unless that rules a link out, on the full sets; this joins most of each group by about one comparison per
document. Buckets that then still hold several components are settled exactly: clusters of documents that share such
buckets are brought together in blocks, and whoever is outside the largest component is intersected with all others by
an inverted list of shingles. Blocks return only links that join components, so copies are never expanded into pairs.
"""
from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from tabulario.llm.bpe import blocks
from tabulario.llm.common import Memo, materialize, text_column

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """`bands` of `rows` registers each; base and first level of the registers; pairs link from `percent` similarity on.

    At exactly 75 % a pair shares no band with probability (1 - 0.75^5)^40 = 2e-5, at 80 % with 1e-7. A comparison is
    left to the registers only if their estimate lies `sigmas` standard errors below the threshold. Blocks hold about
    `block` shingles. A cluster is settled as a whole, each document moved about once, unless that means over `spread`
    times the pairs of its buckets, which would move a document once for each of its bands. Lists of up to `small` ids
    are broadcast.
    """

    words: int = 5
    percent: int = 75
    bands: int = 40
    rows: int = 5
    base: float = 1.1
    first: int = 20
    sigmas: float = 5.0
    rounds: int = 2
    block: int = 1 << 20
    spread: float = 16.0
    small: int = 500_000
    seed: int = 3
    chars: int = 1 << 20

    @property
    def registers(self) -> int:
        return self.bands * self.rows


@functools.lru_cache(maxsize=1)
def word_hashes() -> Memo:
    return Memo(lambda words: [xxhash.xxh64_intdigest(w.encode("utf-8", "replace")) for w in words])


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles: `size` words in a row, or all of them if they are fewer."""
    words = [WORD.findall(t.translate(LOWER)) for t in texts]
    memo = word_hashes()
    memo.learn(set().union(*words))
    out = []
    for ws in words:
        h = np.fromiter(map(memo.__getitem__, ws), np.uint64, len(ws))
        n = min(size, len(h))
        if n:
            mixed = np.full(len(h) - n + 1, n, np.uint64)
            for j in range(n):
                mixed = (mixed ^ h[j:len(h) - n + 1 + j]) * MIX
                mixed ^= mixed >> np.uint64(29)
            h = np.unique(mixed)
        out.append(h)
    return out


def sketch(sets: list[np.ndarray], s: Settings, chunk: int = 1 << 14) -> np.ndarray:
    """Registers (uint8) of each set; an empty set has zeros."""
    rng = np.random.default_rng(s.seed)
    factor = rng.integers(0, 1 << 63, s.registers, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 63, s.registers, dtype=np.uint64)
    out = np.zeros((len(sets), s.registers), np.uint8)
    group, size = [], 0
    filled = [i for i, x in enumerate(sets) if len(x)]
    for at, i in enumerate(filled):
        group.append(i)
        size += len(sets[i])
        if size < chunk and at + 1 < len(filled):
            continue
        flat = np.concatenate([sets[k] for k in group])
        begin = np.cumsum([0] + [len(sets[k]) for k in group[:-1]])
        least = np.stack([np.minimum.reduceat(flat * a + b, begin) for a, b in zip(factor, shift)], 1)
        u = (least.astype(np.float64) + 1) / 2.0 ** 64
        # minima of exponential variates, on a scale where one of 1 has level `first`
        level = np.floor(1 + s.first - np.log(-np.log1p(-np.minimum(u, 1 - 2.0 ** -53))) / np.log(s.base))
        out[group] = np.clip(level, 0, 255).astype(np.uint8)
        group, size = [], 0
    return out


def band_keys(registers: np.ndarray, s: Settings) -> np.ndarray:
    """One 64-bit key per band and row of registers."""
    parts = registers.reshape(len(registers), s.bands, s.rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, s.bands + 1, dtype=np.uint64) * MIX, parts.shape[:2]).copy()
    for j in range(s.rows):
        key = (key ^ (parts[:, :, j] + np.uint64(1))) * MIX
        key ^= key >> np.uint64(31)
    return key.astype(np.int64)


def joint_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, base: float) -> tuple[np.ndarray, np.ndarray]:
    """Similarity with the largest likelihood given registers and sizes of two sets, and its standard error."""
    m = a.shape[1]
    above, below = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)
    chance = lambda x: -np.log1p(-np.maximum(x, 0) * (base - 1) / base) / np.log(base)
    p, q = chance(u - v * grid), chance(v - u * grid)
    tie = np.maximum(1 - p - q, 1e-12)
    fit = above * np.log(np.maximum(p, 1e-12)) + below * np.log(np.maximum(q, 1e-12)) + (m - above - below) * np.log(tie)
    best = grid[np.arange(len(grid)), fit.argmax(1)]
    return best, np.sqrt(np.maximum(best * (1 - best), 0.02) / m)


def compact(df: DataFrame, rows: int = 20_000) -> tuple[DataFrame, int]:
    """`df` written down, in partitions of at least about `rows` rows, and its number of rows.

    The rounds end with small frames; in as many partitions as the first shuffle had, each later one would write
    hundreds of nearly empty files.
    """
    kept = materialize(df)
    n = kept.count()
    return kept.coalesce(max(8, n // rows)), n


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (u, v): its component's smallest node. Large-star and small-star rounds."""
    edges, n = compact(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        parts = max(8, n // 20_000)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(parts)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(
            least.select("u", F.col("m").alias("v"))).coalesce(2 * parts).distinct()
        edges = materialize(small.coalesce(parts))
        n, total = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if (n, total) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = n, total


class Linker:
    """The rounds over the buckets of one table."""

    def __init__(self, texts: DataFrame, classes: DataFrame, s: Settings):
        self.texts, self.classes, self.s = texts, classes, s
        self.links: DataFrame | None = None
        self.roots: DataFrame | None = None

    def rooted(self, df: DataFrame, node: str, root: str) -> DataFrame:
        """Add the component of column `node`; a node without links is its own."""
        if self.roots is None:
            return df.withColumn(root, F.col(node))
        found = self.roots.select(F.col("node").alias(node), F.col("root").alias("_root"))
        return df.join(found, node, "left").withColumn(root, F.coalesce("_root", node)).drop("_root")

    def estimated(self, pairs: DataFrame) -> DataFrame:
        """Pairs that the registers and sizes cannot rule out, with their estimate."""
        s = self.s
        side = lambda k: self.classes.select(F.col("rep").alias(k), F.col("n").alias(f"n_{k}"), F.col("registers").alias(f"r_{k}"))

        @pandas_udf("double")
        def estimate(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
            unpack = lambda c: np.frombuffer(b"".join(c), np.uint8).reshape(len(c), s.registers)
            best, error = joint_estimate(unpack(a), unpack(b), n_a.to_numpy(float), n_b.to_numpy(float), s.base)
            return pd.Series(np.where(100 * (best + s.sigmas * error) >= s.percent, best, -1.0))

        near = pairs.join(side("x"), "x").join(side("y"), "y").where(
            100 * F.least("n_x", "n_y") >= s.percent * F.greatest("n_x", "n_y"))
        return near.select("x", "y", estimate.asNondeterministic()("r_x", "r_y", "n_x", "n_y").alias("estimate")).where(
            "estimate >= 0").groupBy("x", "y").agg(F.max("estimate").alias("estimate"))

    def sets(self, pairs: DataFrame) -> DataFrame:
        """(rep, set) of the documents in `pairs`: packed shingle hashes of their whole texts."""
        s = self.s
        wanted, n = compact(pairs.select(F.col("x").alias("rep")).unionByName(pairs.select(F.col("y").alias("rep"))).distinct())
        if n <= s.small:  # a list of known size saves moving all texts; beyond it they are shuffled
            wanted = F.broadcast(wanted)

        @pandas_udf("binary")
        def packed(texts: pd.Series) -> pd.Series:
            return pd.Series([x.tobytes() for b in blocks(texts.tolist(), s.chars) for x in shingle_sets(b, s.words)], dtype=object)

        return compact(self.texts.join(wanted, "rep").select("rep", packed("text").alias("set")), 2_000)[0]

    def confirmed(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Pairs whose full sets are similar enough."""
        percent = self.s.percent

        @pandas_udf("boolean")
        def similar(a: pd.Series, b: pd.Series) -> pd.Series:
            out = []
            for p, q in zip(a, b):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                common = len(p) + len(q) - len(np.union1d(p, q))
                out.append(100 * common >= percent * (len(p) + len(q) - common))
            return pd.Series(out, dtype=bool)

        side = lambda k: sets.select(F.col("rep").alias(k), F.col("set").alias(f"s_{k}"))
        return pairs.select("x", "y").join(side("x"), "x").join(side("y"), "y").where(
            similar("s_x", "s_y")).select(F.col("x").alias("u"), F.col("y").alias("v")).distinct()

    def link(self, found: DataFrame) -> None:
        found, n = compact(found)
        if not n:
            return
        self.links = found if self.links is None else self.links.unionByName(found)
        stars = found if self.roots is None else found.unionByName(self.roots.select(F.col("node").alias("u"), F.col("root").alias("v")))
        self.roots = components(stars)

    def compare(self, pairs: DataFrame) -> None:
        """Look at all pairs (x, y) and join what is similar enough."""
        pairs, n = compact(self.estimated(pairs))
        if n:
            self.link(self.confirmed(pairs, self.sets(pairs)))

    def settle(self, groups: DataFrame) -> None:
        """Find the links that join components among the members of each group (group, rep)."""
        s = self.s
        rooted = self.rooted(groups, "rep", "root").join(self.classes.select("rep", "n"), "rep")
        parts = rooted.groupBy("group", "root").agg(F.count("*").alias("c"), F.sum("n").alias("shingles"))
        sizes = parts.groupBy("group").agg(
            F.max_by("root", F.struct("c", "root")).alias("largest"), F.sum("shingles").alias("all"),
            (F.sum("shingles") - F.max_by("shingles", F.struct("c", "root"))).alias("rest"))
        blocks_of = lambda c: F.ceil(F.col(c) / F.lit(s.block)).cast("int")
        dealt = lambda c: F.pmod(F.xxhash64("rep"), blocks_of(c)).cast("int")
        every = lambda c: F.sequence(F.lit(0), blocks_of(c) - 1)
        placed = rooted.join(sizes, "group").where("rest > 0")
        here = placed.where("root <> largest").select("group", dealt("rest").alias("i"), F.explode(every("all")).alias("j"), "rep", "root", "n", F.lit(True).alias("outside"))
        there = placed.select("group", F.explode(every("rest")).alias("i"), dealt("all").alias("j"), "rep", "root", "n", F.lit(False).alias("outside"))
        sets = self.sets(groups.select(F.col("rep").alias("x"), F.col("rep").alias("y")))
        percent = s.percent

        def joining(block: pd.DataFrame) -> pd.DataFrame:
            unpacked = [np.frombuffer(x, np.uint64) for x in block["set"]]
            outside = block["outside"].to_numpy()
            others = np.flatnonzero(~outside)
            rep, root = block["rep"].to_numpy(), block["root"].to_numpy()
            size = np.array([len(x) for x in unpacked])
            flat = np.concatenate([unpacked[k] for k in others]) if len(others) else np.zeros(0, np.uint64)
            order = np.argsort(flat, kind="stable")
            shingle, owner = flat[order], np.repeat(np.arange(len(others)), size[others])[order]
            joined: dict[int, int] = {}

            def top(x: int) -> int:
                while joined.get(x, x) != x:
                    x = joined[x]
                return x

            links = []
            for k in np.flatnonzero(outside):
                low, high = np.searchsorted(shingle, unpacked[k], "left"), np.searchsorted(shingle, unpacked[k], "right")
                many = high - low
                at = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
                common = np.bincount(owner[at], minlength=len(others))
                close = (100 * common >= percent * (size[k] + size[others] - common)) & (root[others] != root[k])
                for m in others[close]:
                    a, b = top(root[k]), top(root[m])
                    if a != b:
                        joined[max(a, b)] = min(a, b)
                        links.append((rep[k], rep[m]))
            return pd.DataFrame(links, columns=["u", "v"])

        blocks_ = here.unionByName(there).join(sets, "rep")
        self.link(blocks_.groupBy("group", "i", "j").applyInPandas(joining, "u long, v long"))

    def run(self, bands: Column) -> DataFrame | None:
        """All rounds; (node, root) of linked representatives, or None without links."""
        s = self.s
        rows = self.classes.select("rep", F.explode(bands).alias("bucket"))
        shared = rows.groupBy("bucket").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("bucket")
        rows, _ = compact(rows.join(shared, "bucket"))
        for turn in range(s.rounds):
            h = F.xxhash64(F.lit(turn), "rep")
            placed = self.rooted(rows, "rep", "root")
            hubs = placed.groupBy("bucket").agg(F.min_by("rep", h).alias("hub"), F.min_by("root", h).alias("of"), F.min(h).alias("h"))
            # one comparison per document: with the first of its buckets' hubs that lies in another component
            self.compare(placed.join(hubs, "bucket").where("root <> of").groupBy("rep").agg(F.min_by("hub", "h").alias("y")).withColumnRenamed("rep", "x"))
        placed = self.rooted(rows, "rep", "root")
        mixed = placed.groupBy("bucket").agg(
            F.min("root").alias("a"), F.max("root").alias("b"), F.min("rep").alias("least"), F.count("*").alias("c")).where("a <> b")
        placed, n = compact(placed.join(mixed.select("bucket", "least", "c"), "bucket").select("bucket", "rep", "least", "c"))
        if n:
            self.settle(self.groups(placed))
        return self.roots

    def groups(self, placed: DataFrame) -> DataFrame:
        """(group, rep): clusters of documents chained by buckets, or the single buckets of a cluster where those hold far fewer pairs."""
        cluster = components(placed.select(F.col("rep").alias("u"), F.col("least").alias("v")))
        inside, _ = compact(placed.join(cluster.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("cluster", F.coalesce("root", "rep")).drop("root"))
        members = inside.select("cluster", "rep").distinct()
        cost = members.groupBy("cluster").agg(F.count("*").cast("double").alias("s")).join(
            inside.groupBy("cluster").agg(F.sum("c").cast("double").alias("pairs")), "cluster")  # each bucket row brings its bucket's size
        whole = cost.select("cluster", (F.col("s") * F.col("s") <= self.s.spread * F.col("pairs")).alias("whole"))
        return compact(members.join(whole.where("whole"), "cluster").select(F.concat(F.lit("c"), "cluster").alias("group"), "rep").unionByName(
            inside.join(whole.where("not whole"), "cluster").select(F.concat(F.lit("b"), "bucket").alias("group"), "rep").distinct()))[0]


def find(df: DataFrame, settings: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` (long), n_shingles, component_id and kept of every row.

    Documents with equal shingle sets form a class, of which one representative is compared; copies are never paired.
    Texts that are null or without words have the empty set: they link with nothing, are their own component and are
    kept. Rows without a key are linked with nothing and kept, with a null component. Rows that repeat a key are judged
    by their own text. An empty table gives no rows.
    """
    s = settings
    docs = df.select(F.col(key).cast("long").alias("_id"), text_column(text).alias("_text"))

    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [x for b in blocks(batch["_text"].tolist(), s.chars) for x in shingle_sets(b, s.words)]
            digest = np.array([np.frombuffer(hashlib.blake2b(x.tobytes(), digest_size=16).digest(), "<i8") for x in sets]).reshape(-1, 2)
            yield pd.DataFrame({"_id": batch["_id"].astype("Int64"), "n": [len(x) for x in sets], "k1": digest[:, 0], "k2": digest[:, 1],
                                "registers": [r.tobytes() for r in sketch(sets, s)]})

    rows = materialize(docs.mapInPandas(sketched, "_id long, n long, k1 long, k2 long, registers binary"))
    filled = rows.where((F.col("n") > 0) & F.col("_id").isNotNull())
    of_class = filled.groupBy("k1", "k2").agg(F.min("_id").alias("rep"))
    members = materialize(rows.join(of_class, ["k1", "k2"], "left").select(
        "_id", "n", F.when((F.col("n") > 0) & F.col("_id").isNotNull(), F.col("rep")).alias("rep"),
        F.when(F.col("_id") == F.col("rep"), F.col("registers")).alias("registers")))
    classes = members.where("registers IS NOT NULL").select("rep", "n", "registers").distinct()

    @pandas_udf("array<long>")
    def bands(registers: pd.Series) -> pd.Series:
        return pd.Series(list(band_keys(np.frombuffer(b"".join(registers), np.uint8).reshape(len(registers), s.registers), s)))

    linker = Linker(docs.select(F.col("_id").alias("rep"), F.col("_text").alias("text")), classes, s)
    roots = linker.run(bands("registers"))
    out = members.select("_id", "n", "rep")
    if roots is None:
        out = out.withColumn("root", F.col("rep"))
    else:
        out = out.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    component = F.coalesce("root", "_id")
    return out.select(F.col("_id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"))
