"""Writing tables and result bundles."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tabulario.session import checkpoint_folder


def write_csv(df: DataFrame, path: str) -> None:
    """CSV in UTF-8 with a byte order mark at the head of every part, for spreadsheets."""
    marked = df.toDF("﻿" + df.columns[0], *df.columns[1:])
    marked.write.mode("overwrite").option("header", True).csv(path)


def save_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """One parquet directory per table; no row limit."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def load_bundle(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def preview(df: DataFrame, n: int, order_by: str | None = None) -> tuple[DataFrame, str]:
    """The first n rows for a reader, and a notice when there are more."""
    shown = (df.orderBy(order_by) if order_by else df).limit(n)
    more = df.limit(n + 1).count() > n
    return shown, f"se muestran {n:,} filas; la tabla completa tiene más" if more else ""


def scratch(spark: SparkSession) -> str:
    """The name of a new folder that every executor reaches, under the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/tabulario-{uuid.uuid4().hex}"
