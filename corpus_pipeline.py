"""Corpus pipeline: documents without toxic ones, near-copies and secrets, packed into training sequences.

Every stage takes rows as they are: null ids and texts (a null text is read as empty and stays null), texts of any length,
rows that repeat each other or share an id, further columns, and no rows at all. All but the last give the columns of
documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import packing, secrets, simhash, toxicity
from factloom.llm.common import materialize, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels outside the held-out fold, scores under its threshold. Equal texts share their score, so repeated rows stay or go
    together; a null or empty text is scored as one without words."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that SimHash links join: that of the smallest doc_id, a null one coming last; of rows that share
    it, one. Null and empty texts are one group."""
    return simhash.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts replaced and n_chars renewed; null texts keep a null length, and
    repeated rows change alike."""
    return secrets.redact_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece: its document, its ids, and its place in a sequence of 1024 tokens at most. A null or empty text
    is its end id alone; rows that share an id are packed as rows of their own; which of equal lengths comes first is
    not part of the result's meaning."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_near_copies),
    ("secret_scan", without_secrets),
    ("best_fit_packing", packed),
]

#: SQL can express neither the classifier nor the packing plan; tests hold the stages against plain Python instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
