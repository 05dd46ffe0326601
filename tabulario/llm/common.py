"""What the operators of this subpackage share: reading tables, checkpoints, white space and bounded caches."""
from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from itertools import filterfalse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulario.session import materialize

__all__ = ["BATCH_ROWS", "Memo", "UNIT", "materialize", "free_name", "small_batches", "table", "text_column"]

#: Rows that a Python worker holds at a time; texts may be long, so far fewer than Spark's 10 000.
BATCH_ROWS = 512

#: Unicode White_Space, as the tokenizers' patterns understand \s.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Units no token crosses: a run without white space with the blank before it, or white space that belongs to no run.
UNIT = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")


def small_batches(spark: SparkSession) -> None:
    """Give Python workers few rows at a time, as long texts need."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` is called so."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; sets the small Arrow batches that long texts need."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_column(name: str = "text") -> Column:
    """A text, empty where it is null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


class Memo(dict):
    """Answers per key, computed in batches; at most `bound` recent and as many older ones are kept."""

    def __init__(self, answer: Callable[[list], Iterable], bound: int = 400_000):
        super().__init__()
        self._answer, self._bound, self._older = answer, bound, {}

    def learn(self, keys: Iterable) -> None:
        """Make every key of `keys` present; earlier ones may go."""
        keys = keys if isinstance(keys, set) else set(keys)
        missing = set(filterfalse(self.__contains__, keys))  # a difference with `self` would walk through all that is remembered
        if len(self) + len(missing) > self._bound:
            old = dict(self)
            self.clear()
            missing = keys
        else:
            old = self._older
        found = {k: old[k] for k in missing if k in old} if old else {}
        self.update(found)
        self._older = old
        fresh = [k for k in missing if k not in found]
        if fresh:
            self.update(zip(fresh, self._answer(fresh), strict=True))
