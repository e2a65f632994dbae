"""Inputs as DataFrames: stored tables and the document abstractions derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rel_path() -> Column:
    return F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document as a scanned file."""
    docs = load(spark, sf_dir, "documents")
    return docs.select(
        F.col("source").alias("kb_id"),
        "doc_id",
        rel_path().alias("rel_path"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        F.sha2("text", 256).alias("checksum"),
        F.col("n_chars").alias("size"),
    )


def split_chunks(docs: DataFrame, *keep: str) -> DataFrame:
    """Non-blank lines of each document in order, numbered from 0 without a shuffle."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")
    return docs.select("doc_id", *keep, F.posexplode(lines).alias("chunk_index", "text")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_chunks(load(spark, sf_dir, "documents").withColumnRenamed("source", "kb_id"), "kb_id")


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two scans of the same folder: (recorded, seen). Some documents are gone, new, changed or moved in between."""
    docs = load(spark, sf_dir, "documents").withColumn("file_key", F.col("doc_id"))
    old = docs.where("doc_id % 10 <> 3").select(
        "file_key",
        rel_path().alias("rel_path"),
        F.sha2("text", 256).alias("checksum"),
        F.col("n_chars").alias("size"),
        F.when(F.col("doc_id") % 20 == 4, "deleted").when(F.col("doc_id") % 20 == 6, "skipped").otherwise("indexed").alias("status"),
        F.when(F.col("doc_id") % 20 == 8, F.lit("")).otherwise(F.sha2("text", 256)).alias("indexed_version"),
        F.when(F.col("doc_id") % 20 == 9, F.lit("text@1")).otherwise(F.lit("text@2")).alias("indexed_profile"),
    )
    text = F.when(F.col("doc_id") % 10 == 5, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    moved = F.when(F.col("doc_id") % 20 == 1, F.concat(F.lit("moved/"), rel_path())).otherwise(rel_path())
    new = docs.where("doc_id % 10 <> 7").select(
        "file_key", moved.alias("rel_path"), F.sha2(text, 256).alias("checksum"), F.length(text).cast("long").alias("size"), F.lit("text@2").alias("profile")
    )
    return old, new
