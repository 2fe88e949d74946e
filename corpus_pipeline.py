"""A training corpus in five stages; each works on what its predecessor kept.

In every stage rows are judged by their own texts: ids may be null or repeated, columns may have any names, and an empty table gives an
empty one. Null and empty texts are neither toxic, nor near duplicates of anything, nor contaminated, and hold no secrets; packing gives
them one piece, their end id. Of rows equal in id and shingles near_dedup keeps one, and of a class of ties the row with the smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from axisflow.llm import decontaminate, near_dup, secrets, tokens, toxicity
from axisflow.llm.common import load, materialize, quoted


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labelled ones among docs, does not reject."""
    return toxicity.drop_toxic(docs, toxicity.train_from_labels(docs, load(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contract's rule does not call contaminated; each row is judged by its own text."""
    return decontaminate.drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return secrets.redact(secrets.find_secrets(docs)).select(quoted(docs))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens."""
    return tokens.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack_documents),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
