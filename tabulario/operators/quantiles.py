"""Exact order statistics, top-k sums and prefix sums that never sort a whole table in one task.

Spark's `percentile` keeps every distinct value of a group in one task, and a window without
partitions sorts a whole table in one. Here a mergeable sketch (`percentile_approx`) brackets each
wanted rank, one scan counts the rows below the bracket, and only the distinct values inside it are
ordered; brackets that may still hold too many are sketched again from the inside. Prefix sums run
inside ranges of the order and add what the ranges before hold. The sketch only narrows the search,
so results are exact, and tables of every size take the same way.
"""
from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulario.session import materialize

ACCURACY = 10_000
MARGIN = 4.0 / ACCURACY
CANDIDATES = 1_000_000  # values of one bracket that are ordered together
GROUPS = 20_000  # groups whose brackets may be broadcast: about 100 bytes each and quantile


@dataclass(frozen=True)
class Target:
    """One wanted order statistic of a column: zero-based rank(n), near fraction * n."""

    column: str
    fraction: float
    rank: Callable[[int], float]


def quantile(column: str, p: float) -> Target:
    """Linear interpolation between the two nearest ranks."""
    return Target(column, p, lambda n: (n - 1) * p)


def kth_largest(column: str, fraction: float, k: Callable[[int], int]) -> Target:
    """The k-th largest value, where k(n) stays within one of fraction * n."""
    return Target(column, 1.0 - fraction, lambda n: n - k(n))


@dataclass(frozen=True)
class _Bracket:
    """Bounds known to hold a rank: values below `low` and values from `low` to `high`, counted."""

    low: float
    high: float
    below: int
    inside: int

    def fractions(self, rank: float, margin: float) -> tuple[float, float]:
        """Where the two neighbours of the rank lie among the values inside, one rank and the sketch's error around."""
        local = rank - self.below
        ends = (local - 1) / self.inside - margin, (local + 2) / self.inside + margin
        return min(max(ends[0], 0.0), 1.0), min(max(ends[1], 0.0), 1.0)


def order_statistics(df: DataFrame, targets: list[Target], sizes: dict[str, int] | None = None) -> list[float | None]:
    """The wanted values over the whole frame, in the order asked; None for an empty column.

    Columns must be DOUBLE without NaN. `sizes` gives the count of present values per column when it
    is known already. What reaches the driver are a few rows per target.
    """
    columns = sorted({t.column for t in targets})
    n_of = sizes or dict(zip(columns, df.agg(*[F.count(c) for c in columns]).head()))
    ranks = [min(max(float(t.rank(n_of[t.column])), 0.0), n_of[t.column] - 1.0) for t in targets]
    found: list[float | None] = [None] * len(targets)
    open_ = {i: _Bracket(-math.inf, math.inf, 0, n_of[t.column]) for i, t in enumerate(targets) if n_of[t.column]}
    margin = MARGIN
    while open_:
        narrowed = _sketch(df, targets, ranks, open_, margin)
        if max(b.inside for b in open_.values()) * 2 * (margin + 1 / ACCURACY) > CANDIDATES:
            counted = _count(df, targets, narrowed)
            done = {i: b.low for i, b in counted.items() if b.low == b.high and b.below <= ranks[i] <= b.below + b.inside - 1}
            shrunk = {
                i: b for i, b in counted.items()
                if i not in done and b.below <= math.floor(ranks[i]) and math.ceil(ranks[i]) < b.below + b.inside
                and b.inside <= open_[i].inside / 2
            }
            for i, value in done.items():
                found[i] = value
            if done or shrunk:
                open_ = {i: shrunk.get(i, b) for i, b in open_.items() if i not in done}
                continue  # a bracket that no longer shrinks is made of few, frequent values
        for i, value in _search(df, targets, [(i, ranks[i], low, high) for i, (low, high) in narrowed.items()]).items():
            found[i] = value
        open_ = {i: b for i, b in open_.items() if found[i] is None}
        margin *= 25  # only where a sketch fell outside its stated error
    return found


def _sketch(df: DataFrame, targets: list[Target], ranks: list[float], open_: dict[int, _Bracket],
            margin: float) -> dict[int, tuple[float, float]]:
    """Narrower bounds of each open target, by one pass. Targets that share a column and bounds share a sketch."""
    wanted: dict[tuple, list[float]] = {}
    ends = {}
    for i, b in open_.items():
        key = (targets[i].column, b.low, b.high)
        ends[i] = key, b.fractions(ranks[i], margin)
        wanted[key] = sorted({*wanted.get(key, []), *ends[i][1]})
    row = df.agg(*[
        F.percentile_approx(c if low == -math.inf else F.when(F.col(c).between(low, high), F.col(c)), spots, ACCURACY)
        for (c, low, high), spots in wanted.items()
    ]).head()
    sketch = dict(zip(wanted, row))
    return {i: (sketch[key][wanted[key].index(a)], sketch[key][wanted[key].index(b)]) if margin < 1 else (-math.inf, math.inf)
            for i, (key, (a, b)) in ends.items()}


def _count(df: DataFrame, targets: list[Target], bounds: dict[int, tuple[float, float]]) -> dict[int, _Bracket]:
    row = df.agg(*[x for i, (low, high) in bounds.items() for x in (
        F.count_if(F.col(targets[i].column) < low), F.count_if(F.col(targets[i].column).between(low, high)))]).head()
    return {i: _Bracket(low, high, row[2 * j], row[2 * j + 1]) for j, (i, (low, high)) in enumerate(bounds.items())}


def _search(df: DataFrame, targets: list[Target], searched: list[tuple[int, float, float, float]]) -> dict[int, float]:
    # counted in the same job as the candidates, as a subquery of one row
    below = df.agg(F.array(*[F.count_if(F.col(targets[i].column) < low) for i, _, low, _ in searched])).scalar()
    candidates = F.filter(
        F.array(*[
            F.when(F.col(targets[i].column).between(low, high),
                   F.struct(F.lit(j).alias("i"), F.col(targets[i].column).alias("v")))
            for j, (i, _, low, high) in enumerate(searched)
        ]),
        lambda x: x.isNotNull(),
    )
    inside = df.select(F.explode(candidates).alias("x")).groupBy("x.i", "x.v").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(W.partitionBy("i").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    offset = F.get("below", F.col("i"))
    rank = F.get(F.array(*[F.lit(r) for _, r, *_ in searched]), F.col("i"))
    placed = inside.withColumn("below", below).select("i", "v", "c", (offset + upto).alias("end"), rank.alias("r")).withColumn(
        "start", F.col("end") - F.col("c")
    )

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("start") <= position) & (F.col("end") > position), F.col("v")))

    rows = placed.groupBy("i").agg(at(F.floor("r")).alias("low"), at(F.ceil("r")).alias("high")).collect()
    out = {}
    for r in rows:
        i, rank = searched[r["i"]][:2]
        if r["low"] is not None and r["high"] is not None:
            out[i] = r["low"] + (r["high"] - r["low"]) * (rank - math.floor(rank))
    return out


def quantiles(df: DataFrame, column: str, probs: list[float]) -> list[float | None]:
    return order_statistics(df, [quantile(column, p) for p in probs])


#: How far beyond the sketch's error a bracket reaches: for groups of any size by two to four ranks at least.
REACH = [2.0 ** -j for j in range(1, 13)]


def grouped_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """One row per group with a column per name in `probs`; groups may be any size and number."""
    base = df.select(*by, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    keys = [f"_k_{c}" for c in by]
    spots = sorted({min(max(p + s * (MARGIN + reach), 0.0), 1.0) for p in probs.values() for reach in REACH for s in (-1, 1)})
    level = F.least(F.lit(len(REACH)), F.greatest(F.lit(1), F.floor(F.log2("n")).cast("int") - 1))

    def bound(p: float, sign: int) -> Column:
        at = [spots.index(min(max(p + sign * (MARGIN + reach), 0.0), 1.0)) for reach in REACH]
        return F.get("_s", F.element_at(F.array(*map(F.lit, at)), level))

    brackets = (
        base.groupBy(*by).agg(F.count("_v").alias("n"), F.percentile_approx("_v", spots, ACCURACY).alias("_s"))
        .select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.array(*[
            F.struct(F.lit(i).alias("i"), ((F.col("n") - 1) * F.lit(p)).alias("r"), bound(p, -1).alias("lo"), bound(p, 1).alias("hi"))
            for i, p in enumerate(probs.values())
        ]).alias("_t"))
    )
    # counted, not guessed: left to itself, Spark sends all rows of a group to one task and sorts them there
    brackets = materialize(brackets)
    few = brackets.count() <= GROUPS
    joined = base.join(F.broadcast(brackets) if few else brackets, _same(by, keys)).drop(*keys)
    below = joined.groupBy(*by).agg(F.array(*[
        F.count_if(F.col("_v") < F.col("_t")[i]["lo"]) for i in range(len(probs))
    ]).alias("_b")).select(*[F.col(c).alias(k) for c, k in zip(by, keys)], "_b")
    inside = (
        joined.select(*by, "_v", F.explode(
            F.filter("_t", lambda t: F.col("_v").between(t["lo"], t["hi"]))).alias("_x"))
        .groupBy(*by, F.col("_x.i").alias("_i"), F.col("_x.r").alias("_r"), "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    placed = running_sum(inside, [*by, "_i"], [F.asc("_v")], "_c", "_upto").join(F.broadcast(below) if few else below, _same(by, keys)).withColumn(
        "_end", F.get("_b", F.col("_i")) + F.col("_upto")).withColumn("_start", F.col("_end") - F.col("_c"))

    def at(i: int, position: Column) -> Column:
        hit = (F.col("_i") == i) & (F.col("_start") <= position) & (F.col("_end") > position)
        return F.max(F.when(hit, F.col("_v")))

    picked = []
    for i, name in enumerate(probs):
        r = F.max(F.when(F.col("_i") == i, F.col("_r")))
        low, high = at(i, F.floor("_r")), at(i, F.ceil("_r"))
        picked.append((low + (high - low) * (r - F.floor(r))).alias(name))
    return placed.groupBy(*by).agg(*picked)


def grouped_quantiles_of(df: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row per group with a column per name in `wanted`: the quantile p of a value column, as (column, p).

    All columns and quantiles share one search, keyed by group and column, so the number of jobs does not depend on how
    many there are. A quantile of a column without values in a group is null; groups without any value have no row.
    """
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    probs = {f"_p{j}": p for j, p in enumerate(dict.fromkeys(p for _, p in wanted.values()))}
    of = {p: name for name, p in probs.items()}
    if len(columns) == 1:
        found = grouped_quantiles(df, by, columns[0], probs)
        return found.select(*by, *[F.col(of[p]).alias(name) for name, (_, p) in wanted.items()])
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)]))
    long = df.select(*by, cells.alias("_x")).select(*by, F.col("_x.c").alias("_column"), F.col("_x.v").alias("_value")).where("_value is not null")
    found = grouped_quantiles(long, [*by, "_column"], "_value", probs)
    return found.groupBy(*by).agg(*[
        F.max(F.when(F.col("_column") == columns.index(c), F.col(of[p]))).alias(name) for name, (c, p) in wanted.items()])


def ranges(df: DataFrame, *order: Column | str) -> DataFrame:
    """`df` in ranges of `order`, one per shuffle partition, numbered in `_range`; written down, so that they stay as they are.

    Rows that are equal in `order` share a range: end it with what tells rows apart where one value may be frequent.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))


def running_sum(df: DataFrame, keys: list[str], order: list[Column], amount: str, into: str) -> DataFrame:
    """Add the sum of `amount` up to each row of its group; neither a large group nor the whole is ordered in one task.

    `order` must tell the rows of a group apart.
    """
    placed = ranges(df, *keys, *order)
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row per group and range
    offsets = placed.groupBy(*keys, "_range").agg(F.sum(amount).alias("_s")).select(
        *[F.col(c).alias(f"_o_{c}") for c in keys], F.col("_range").alias("_o"),
        F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = placed.withColumn(into, F.sum(amount).over(inside))
    same = _same([*keys, "_range"], [*[f"_o_{c}" for c in keys], "_o"])
    return local.join(offsets, same).withColumn(into, F.col(into) + F.col("_before")).select(*df.columns, into)


def _same(left: list[str], right: list[str]) -> Column:
    condition = F.col(left[0]).eqNullSafe(F.col(right[0]))
    for a, b in zip(left[1:], right[1:]):
        condition = condition & F.col(a).eqNullSafe(F.col(b))
    return condition


def one_percent(n: int) -> int:
    return max(1, int(n * 0.01))


def rounded_share(fraction: float) -> Callable[[int], int]:
    """max(1, fraction * n rounded half to even)."""
    return lambda n: max(1, round(n * fraction))


def top_k_sum(df: DataFrame, column: str, fraction: float, k: Callable[[int], int]) -> DataFrame:
    """One row: n, k, total, largest and top_sum (the sum of the k largest values).

    The k-th largest value is found as an order statistic; then one scan adds what lies above it
    and as many copies of it as are still missing.
    """
    (cut,) = order_statistics(df, [kth_largest(column, fraction, k)])
    return sum_above(df, column, fraction, k, cut)


def sum_above(df: DataFrame, column: str, fraction: float, k: Callable[[int], int], cut: float | None) -> DataFrame:
    """`top_k_sum` once the k-th largest value is known."""
    v = F.col(column)
    cut_value = F.lit(cut).cast("double")
    sums = df.agg(
        F.count(v).alias("n"), F.sum(v).alias("total"), F.max(v).alias("largest"),
        F.sum(F.when(v > cut_value, v).otherwise(0.0)).alias("over"),
        F.count_if(v > cut_value).alias("n_over"),
    )
    size = F.greatest(F.lit(1), _k_column(k, fraction))
    return sums.select(
        "n", size.cast("bigint").alias("k"), "total", "largest",
        (F.col("over") + (size - F.col("n_over")) * cut_value).alias("top_sum"),
    )


def _k_column(k: Callable[[int], int], fraction: float) -> Column:
    scaled = F.col("n") * F.lit(fraction)
    return F.floor(scaled) if k is one_percent else F.bround(scaled, 0)


def descending_prefix(df: DataFrame, value: str) -> DataFrame:
    """The distinct values, how often they come (`c`), the sum up to and with them, largest first (`upto`), `total` and `n`."""
    counted = df.groupBy(value).agg(F.count(F.lit(1)).alias("c")).withColumn("_sum", F.col(value) * F.col("c"))
    placed = running_sum(counted, [], [F.desc(value)], "_sum", "upto")
    whole = counted.agg(F.sum("_sum").alias("total"), F.sum("c").alias("n"))
    return placed.drop("_sum").crossJoin(F.broadcast(whole))  # one row
