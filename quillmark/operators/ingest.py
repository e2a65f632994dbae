"""Discovery and change detection over snapshots, publication, retention and the job queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def still_settling(mtime: Column, now: Column, min_age: int) -> Column:
    """Changed less than ``min_age`` seconds ago; times far in the future count as stable."""
    return F.abs(now - mtime) < min_age


def reuse_checksums(seen: DataFrame, known: DataFrame) -> DataFrame:
    """Take the recorded checksum where size and mtime agree; rows with ``hashed`` are to be read."""
    old = known.select("rel_path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col("checksum").alias("_checksum"))
    rows = seen.join(old, "rel_path", "left")
    same = F.coalesce((F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime")), F.lit(False))
    return rows.withColumn("hashed", ~same).withColumn("checksum", F.when(same, F.col("_checksum")).otherwise(F.col("checksum"))).drop("_size", "_mtime", "_checksum")


def classify_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Snapshot diff: file_key, change and job of every file of either snapshot; the order of the cases decides."""
    o = old.select("file_key", *(F.col(c).alias(f"o_{c}") for c in ("rel_path", "checksum", "size", "status", "indexed_version", "indexed_profile")))
    n = new.select("file_key", *(F.col(c).alias(f"n_{c}") for c in ("rel_path", "checksum", "size", "profile")))
    same = (F.col("o_checksum") == F.col("n_checksum")) & (F.col("o_size") == F.col("n_size"))
    change = (
        F.when(F.col("n_checksum").isNull(), "deleted")
        .when(F.col("o_checksum").isNull(), "new")
        .when((F.col("o_status") == "deleted") & same & (F.col("o_indexed_version") == F.col("n_checksum")), "metadata_changed")
        .when(F.col("o_status") == "deleted", "new")
        .when(~same, "content_changed")
        .when(F.col("o_status") == "skipped", "skipped")
        .when(F.col("o_indexed_version") != F.col("n_checksum"), "needs_parse")
        .when(F.col("o_indexed_profile") != F.col("n_profile"), "parser_changed")
        .when(F.col("o_rel_path") != F.col("n_rel_path"), "metadata_changed")
        .otherwise("unchanged")
    )
    job = F.when(F.col("change").isin("new", "content_changed", "needs_parse", "parser_changed"), "parse").when(F.col("change") == "metadata_changed", "metadata_update").when(F.col("change") == "deleted", "delete")
    return o.join(n, "file_key", "full").select("file_key", change.alias("change")).withColumn("job", job)


def detect_moves(old: DataFrame, new: DataFrame) -> DataFrame:
    """Unseen paths whose checksum is that of exactly one vanished path, and of no other unseen path."""
    unseen = new.join(old, "rel_path", "left_anti").select(F.col("rel_path").alias("to_path"), "checksum")
    gone = old.join(new, "rel_path", "left_anti").select(F.col("rel_path").alias("from_path"), "checksum")
    single = lambda rows: rows.join(rows.groupBy("checksum").count().where("count = 1").select("checksum"), "checksum")
    return single(unseen).join(single(gone), "checksum").select("from_path", "to_path", "checksum")


def missing_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Registered files that were not seen."""
    return old.join(new, "file_key", "left_anti")


def published(points: DataFrame, ledger: DataFrame, files: DataFrame) -> DataFrame:
    """Points that are active in the ledger, of a file that is not deleted, at its indexed version and unchanged."""
    live = ledger.where("status = 'active'").select("point_id", F.col("text_sha").alias("_sha"), F.col("content_version").alias("_version"))
    valid = files.where("status <> 'deleted'").select("doc_id", F.col("indexed_version").alias("_indexed"))
    rows = points.join(live, "point_id").join(valid, "doc_id")
    return rows.where((F.col("text_sha") == F.col("_sha")) & (F.col("_version") == F.col("_indexed"))).drop("_sha", "_version", "_indexed")


def document_delta(base: DataFrame, current: DataFrame) -> DataFrame:
    """Added, removed and modified documents with their chunks: both inputs hold (doc_id, chunk_sha)."""
    old = base.select("doc_id", "chunk_sha").distinct().withColumn("o", F.lit(1))
    new = current.select("doc_id", "chunk_sha").distinct().withColumn("n", F.lit(1))
    both = old.join(new, ["doc_id", "chunk_sha"], "full").groupBy("doc_id").agg(F.count("o").alias("old"), F.count("n").alias("new"), F.sum(F.when(F.col("o").isNotNull() & F.col("n").isNotNull(), 1).otherwise(0)).alias("kept"))
    kind = F.when(F.col("old") == 0, "added").when(F.col("new") == 0, "removed").when((F.col("kept") < F.col("old")) | (F.col("kept") < F.col("new")), "modified")
    return both.withColumn("kind", kind).where("kind is not null").select("doc_id", "kind", (F.col("new") - F.col("kept")).alias("new_chunks"), (F.col("old") - F.col("kept")).alias("removed_chunks"))


def expired(points: DataFrame, cutoff: int) -> DataFrame:
    """Inactive points older than the cutoff by document and version."""
    old = points.where((~F.col("is_active")) & (F.col("inactive_at") < cutoff))
    return old.groupBy("doc_id", "content_version").agg(F.count("*").alias("points"), F.min("inactive_at").alias("oldest"))


def superseded(versions: DataFrame, by: list[str], order: list[Column], keep: int) -> DataFrame:
    """Versions beyond the newest ``keep`` of each group."""
    return versions.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") > keep).drop("_k")


def enqueue(jobs: DataFrame) -> DataFrame:
    """One active job for each key: the first by time; finished jobs do not block."""
    first = Window.partitionBy("dedupe_key").orderBy("created_at", "job_id")
    active = jobs.where(F.col("status").isin("queued", "running"))
    return active.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def claim_order(jobs: DataFrame, now: int) -> DataFrame:
    """Claimable jobs, those queued and due or whose lease ran out, numbered in claim order within their library."""
    due = ((F.col("status") == "queued") & (F.col("run_after") <= now)) | ((F.col("status") == "running") & (F.col("lease_until") < now))
    order = Window.partitionBy("kb_id").orderBy("priority", "created_at", "job_id")
    return jobs.where(due).withColumn("claim", F.row_number().over(order).cast("long"))


def backoff(base: float, attempts: Column, most: float) -> Column:
    """base * 2^attempts, at most ``most``."""
    return F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), attempts))


def stage_elapsed(events: DataFrame, by: str, at: str, order: str) -> DataFrame:
    """Seconds from each event of a job to its next."""
    w = Window.partitionBy(by).orderBy(at, order)
    return events.withColumn("elapsed", F.lead(at).over(w) - F.col(at))


def rebuild_policy(stats: DataFrame, *, days: int, chunks: int, ratio: float) -> DataFrame:
    """full, append or none for each library from (kb_id, age_days, new_chunks, total_chunks, changed_docs)."""
    full = (F.col("age_days") >= days) & ((F.col("new_chunks") >= chunks) | (F.col("new_chunks") / F.greatest("total_chunks", F.lit(1)) >= ratio))
    return stats.withColumn("policy", F.when(full, "full").when(F.col("changed_docs") > 0, "append").otherwise("none"))
