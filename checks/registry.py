"""The register of queries."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, when SQL can express it, the SQL with the same result."""

    def register(f: Query) -> Query:
        assert key not in QUERIES, key

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return f(spark, sf_dir)

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return f

    return register


def r(c: Column | str, digits: int = 2) -> Column:
    """Rounded the same way on both engines: floor(x * 10^d + 0.5) / 10^d."""
    scale = float(10 ** digits)
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def rs(expression: str, digits: int = 2) -> str:
    """The SQL text of `r`."""
    return f"(FLOOR(({expression})*1e{digits}+0.5e0)/1e{digits})"
