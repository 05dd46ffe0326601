"""A corpus made ready for training: what is worthless or repeated goes, personal data is masked, the rest is packed.

Each stage takes the documents that its predecessor kept and returns them with the same columns; the last returns the
pieces of packed sequences. Null and empty texts, repeated rows and further columns are handled as the operators say.
"""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulario.llm import compression_rules, importance, near_duplicates, packing, pii
from tabulario.llm.common import free_name, materialize, small_batches, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the base rule or the compression bands reject go."""
    small_batches(spark)
    verdict = free_name(docs, "_quality")
    return compression_rules.judge(docs, into=verdict).where(F.col(verdict)["kept"]).drop(verdict)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that the draw leaves out go."""
    small_batches(spark)
    verdict = free_name(docs, "_importance")
    sampler = importance.fit_sampler(docs, table(spark, sf_dir, "labels").where("quality = 1"))
    return sampler.weigh(docs, into=verdict).where(F.col(verdict)["selected"]).drop(verdict)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each group of near-duplicates the document with the smallest id stays, once."""
    small_batches(spark)
    kept = near_duplicates.find(docs.select("doc_id", "text")).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    # semi-join and duplicates share one shuffle by doc_id; documents without an id are linked with nothing
    once = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns)
    return once.unionByName(docs.where("doc_id IS NULL"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: spans of personal data are masked; `n_chars`, where there is one, follows the new text."""
    masked = pii.redact(docs, pii.fit(docs))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the documents as pieces of sequences of 1024 tokens."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near deduplication", near_deduplication),
    ("personal data", personal_data),
    ("best-fit packing", best_fit_packing),
]
#: Compression, trained models and tokenizers cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each stage's result written to the checkpoint folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
