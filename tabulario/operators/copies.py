"""Rows that repeat in every column, found by fingerprint.

Equal rows have equal 128-bit fingerprints, so a row whose fingerprint occurs once repeats nothing. Fingerprints are
counted first: the shuffle carries 16 bytes, a mask of missing cells and a count per distinct row, never the row. Whole
rows are compared only where a fingerprint occurs more than once, so the answer does not rest on fingerprints being
different. Two missing cells are equal, and so are two NaN.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulario.operators.intake import col
from tabulario.session import materialize

#: Repeated fingerprints that may be broadcast: 24 bytes each. Beyond it they are joined by a shuffle.
BROADCAST = 500_000
Fingerprint = Callable[[DataFrame, list[str]], list[Column]]


def fingerprint(df: DataFrame, columns: list[str]) -> list[Column]:
    """Two hashes of the row and one of which cells are missing: a hash passes over a missing cell, which would otherwise
    make (a, missing) and (missing, a) one. Maps have no order to hash by and are left to the comparison of whole rows."""
    cells = [col(c) for c in columns if not _holds_map(df.schema[c].dataType)]
    return [F.xxhash64(F.lit(1), *cells), F.xxhash64(F.lit(2), *cells), F.xxhash64(F.lit(3), *[c.isNull() for c in cells])]


def _holds_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _holds_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_holds_map(f.dataType) for f in dtype)
    return isinstance(dtype, T.MapType)


class Copies:
    """`df` marked with fingerprints, and those that occur more than once in `columns`."""

    def __init__(self, df: DataFrame, columns: list[str] | None = None, marks: Fingerprint = fingerprint):
        self.columns = columns or df.columns
        self.names = [_free(df, f"_f{i}") for i in range(len(marks(df, self.columns)))]
        self.marked = df.withColumns(dict(zip(self.names, marks(df, self.columns))))
        self.all_columns = df.columns
        n = _free(df, "_n")
        counted = materialize(self.marked.groupBy(*self.names).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 1))
        self.repeated = counted.select(*self.names)
        self.n_repeated, self.n_suspects = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum(n), F.lit(0))).head()

    def _joined(self, how: str) -> DataFrame:
        few = F.broadcast(self.repeated) if self.n_repeated <= BROADCAST else self.repeated
        return self.marked.join(few, self.names, how).select(*[col(c) for c in self.all_columns])

    def suspects(self) -> DataFrame:
        """The rows whose fingerprint occurs more than once."""
        return self._joined("left_semi")

    def single(self) -> DataFrame:
        """The rows whose fingerprint occurs once; they repeat nothing and are not shuffled."""
        return self._joined("left_anti")

    def groups(self, *aggregates: Column) -> DataFrame:
        """The suspects grouped by whole rows."""
        return self.suspects().groupBy(*[col(c) for c in self.columns]).agg(*aggregates)


def duplicate_rows(df: DataFrame, marks: Fingerprint = fingerprint) -> DataFrame:
    """One row, `n_duplicates`: how many rows repeat an earlier one in every column. A table without columns has none."""
    if not df.columns:
        return df.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("n_duplicates"))
    copies = _free(df, "_copies")
    return Copies(df, marks=marks).groups(F.count(F.lit(1)).alias(copies)).agg(
        F.coalesce(F.sum(F.col(copies) - 1), F.lit(0)).alias("n_duplicates"))


def first_of_copies(df: DataFrame, row_id: str | None = None, marks: Fingerprint = fingerprint) -> DataFrame:
    """Each row once. With `row_id`, which is not compared, the copy with the smallest one stays, a missing one last."""
    return without_copies(df, row_id, marks)[0]


def without_copies(df: DataFrame, row_id: str | None = None, marks: Fingerprint = fingerprint) -> tuple[DataFrame, int]:
    """`first_of_copies` and how many rows it leaves out. One copy of each repeated row is written down, so the rest is read once."""
    others = [c for c in df.columns if c != row_id]
    if not others:
        first = df.limit(1) if row_id is None else df.orderBy(col(row_id).asc_nulls_last()).limit(1)
        return first, max(df.count() - 1, 0)
    copies = Copies(df, others, marks)
    if not copies.n_repeated:
        return df, 0
    once = copies.groups(*([F.min(col(row_id)).alias(row_id)] if row_id else [F.count(F.lit(1)).alias(_free(df, "_n"))]))
    once = materialize(once.select(*[col(c) for c in df.columns]))
    return copies.single().unionByName(once), copies.n_suspects - once.count()


def _free(df: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name
