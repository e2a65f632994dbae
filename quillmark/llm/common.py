"""What the operators of this subpackage share: inputs, samples, and the engine's scratch tables, joins and components."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.operators.graph import Forest, components, discard, settle, small_join
from quillmark.operators.graph import scratch as fresh

__all__ = ["Forest", "bounded_batches", "components", "discard", "fresh", "held_out", "settle", "small_join", "table", "texts", "training_sample", "whole"]


def bounded_batches(spark: SparkSession) -> None:
    """Let Python workers get texts in small Arrow batches, so that their memory doesn't depend on text lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column = "text") -> Column:
    """A text with null read as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels are never learned from; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, chars: int) -> DataFrame:
    """(doc_id, text, _label) of labelled documents that aren't held out, the first in the order of their ids' hashes:
    at most ``limit`` of them and ``chars`` code points in all. An id with several labels has the greatest, and one
    with several texts the smallest, so an id is one row however often it is in either table."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    chosen = chosen.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = settle(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_label").alias("_label")), "sample")
    so_far = F.sum(F.length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    within = rows.select("doc_id", so_far.alias("_chars")).where(F.col("_chars") <= chars).select("doc_id")
    return rows.join(F.broadcast(within), "doc_id")


def texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings of an Arrow column; null reads as empty."""
    return [x or "" for x in column.to_pylist()]
