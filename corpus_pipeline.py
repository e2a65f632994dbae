"""Corpus pipeline over the documents table: toxic documents go, one document of each near-duplicate group stays,
secrets are masked, sources are mixed to their weights, and the mixed stream is packed into training sequences.

Each stage is a function of (spark, docs, sf_dir). Its result is written as Parquet and read again as the next
stage's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillmark.llm import mixing, near_dedup, packing, secrets, toxicity
from quillmark.llm.common import bounded_batches, discard, fresh, table
from quillmark.llm.queries import VOCABULARY


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return near_dedup.one_of_each(docs, size=5, threshold=0.8)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in the order of the schedule; the next stage packs runs of this order."""
    bounded_batches(spark)
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return packing.packed(docs, public_tokenizers.path(VOCABULARY), in_order=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express none of the learned, sketched or scheduled stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``, each result a table in the shared folder that the next one replaces."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            discard(before)
        docs = before = spark.read.parquet(path)
    return docs
