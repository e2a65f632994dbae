"""Upkeep of libraries: drift and repair, superseded and taken-over work, folders, phases, and comparisons of runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Seconds between the runs of each periodic job.
INTERVALS = {"scan": 60, "worker": 300, "graph": 7_200, "gc": 86_400, "cache": 604_800, "logs": 2_592_000}


def drift(ledger: DataFrame, stored: DataFrame) -> DataFrame:
    """(point_id, missing, version_mismatch, text_mismatch) of ledger points: absent from the store, or of another
    version or text. Empty values of either side are unknown and not compared."""
    have = stored.select("point_id", F.lit(True).alias("_here"), F.col("content_version").alias("_version"), F.col("text_sha").alias("_sha"))
    rows = ledger.where("point_id <> ''").join(have, "point_id", "left")
    differs = lambda a, b: F.coalesce((a != "") & (b != "") & (a != b), F.lit(False))
    return rows.select("point_id", F.col("_here").isNull().alias("missing"), differs(F.col("content_version"), F.col("_version")).alias("version_mismatch"), differs(F.col("text_sha"), F.col("_sha")).alias("text_mismatch"))


def to_repair(files: DataFrame, ledger: DataFrame, stored: DataFrame) -> DataFrame:
    """Published files with an active point that the store lacks or holds with another text; files without active
    points are empty on purpose. Files with a running job wait."""
    able = files.where("status not in ('deleted', 'skipped') and indexed_version is not null and not running")
    bad = drift(ledger.where("status = 'active'"), stored).where("missing or text_mismatch").select("point_id")
    return able.join(ledger.join(bad, "point_id").select("file_id").distinct(), "file_id", "left_semi")


def orphans(stored: DataFrame, registry: DataFrame, protected: Column) -> DataFrame:
    """Stored versions that the registry doesn't know and nothing protects."""
    return stored.join(registry, "version", "left_anti").where(~protected)


def cancelled(jobs: DataFrame, changed: DataFrame, keep: list[str]) -> DataFrame:
    """Jobs with the status after their files changed again: what waits is cancelled, but for kinds to keep."""
    rows = jobs.join(changed.select("file_id", F.lit(True).alias("_changed")).distinct(), "file_id", "left")
    stop = F.coalesce(F.col("_changed"), F.lit(False)) & F.col("status").isin("queued", "retry") & ~F.col("kind").isin(*keep)
    return rows.withColumn("status", F.when(stop, "cancelled").otherwise(F.col("status"))).drop("_changed")


def claimable(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs that may be claimed: queued ones that are due, and running ones whose lease has run out (taken over)."""
    due = F.col("status").isin("queued", "retry") & (F.col("run_after") <= now)
    lost = (F.col("status") == "running") & (F.col("lease_until") < now)
    return jobs.where(due | lost).withColumn("taken_over", lost)


def beaten(jobs: DataFrame, beats: DataFrame, lease: int) -> DataFrame:
    """Running jobs with their leases extended from their own worker's last heartbeat; others' beats don't count."""
    last = beats.groupBy("job_id", "worker").agg(F.max("at").alias("_at"))
    rows = jobs.join(last, ["job_id", "worker"], "left")
    return rows.withColumn("lease_until", F.when((F.col("status") == "running") & F.col("_at").isNotNull(), F.greatest("lease_until", F.col("_at") + lease)).otherwise(F.col("lease_until"))).drop("_at")


def deactivated(points: DataFrame, gone: DataFrame, now: Column) -> DataFrame:
    """Points of files that are gone become inactive at ``now``; those that are inactive already keep their time."""
    rows = points.join(gone.select("file_id", F.lit(True).alias("_gone")).distinct(), "file_id", "left")
    stop = F.coalesce(F.col("_gone"), F.lit(False)) & F.col("active")
    return rows.withColumn("inactive_at", F.when(stop, now).otherwise(F.col("inactive_at"))).withColumn("active", F.col("active") & ~stop).drop("_gone")


def reactivated(points: DataFrame, back: DataFrame) -> DataFrame:
    """Points of files that came back (file_id, deleted_at) revive if it was that deletion that stopped them."""
    rows = points.join(back, "file_id", "left")
    revive = F.coalesce(~F.col("active") & (F.col("inactive_at") == F.col("deleted_at")), F.lit(False))
    return rows.withColumns({"active": F.col("active") | revive, "inactive_at": F.when(~revive, F.col("inactive_at"))}).drop("deleted_at")


def metadata_fingerprint(fields: dict[str, Column]) -> Column:
    """Hash of a file's metadata as JSON with its keys in order; null fields don't count."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields)))), 256)


def folder_matches(known: DataFrame, found: DataFrame, least: float = 0.5) -> DataFrame:
    """(folder, kb_id, ratio): for each found folder the library with the greatest share of its files, by checksum;
    null below ``least``, which means a new library. Both have (checksum) and their name."""
    files = found.select("folder", "checksum").distinct()
    sizes = files.groupBy("folder").agg(F.count("*").alias("n"))
    common = files.join(known.select("kb_id", "checksum").distinct(), "checksum").groupBy("folder", "kb_id").agg(F.count("*").alias("m"))
    best = common.groupBy("folder").agg(F.max(F.struct("m", "kb_id")).alias("b"))
    rows = sizes.join(best, "folder", "left").withColumn("ratio", F.round(F.coalesce(F.col("b.m"), F.lit(0)) / F.col("n"), 4))
    return rows.select("folder", F.when(F.col("ratio") >= least, F.col("b.kb_id")).alias("kb_id"), "ratio")


def due(last_runs: DataFrame, now: Column) -> DataFrame:
    """(job, due) by the time since each job's last run; one that never ran is due."""
    every = F.create_map(*[F.lit(x) for pair in INTERVALS.items() for x in pair])
    return last_runs.select("job", F.coalesce(now - F.col("last_run") >= every[F.col("job")], F.lit(True)).alias("due"))


def snapshot_hash(chunks: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """One hash of each library's chunk references, whatever their order: hashes of rows meet in 4,096 hashed groups
    first, so that no task gathers a whole library."""
    row = F.sha2(F.concat_ws("|", *columns), 256)
    rows = chunks.select(by, row.alias("h")).withColumn("_g", F.substring("h", 1, 3))
    part = rows.groupBy(by, "_g").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("p"))
    return part.groupBy(by).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_g", "p"))), lambda x: x["p"]), ""), 256).alias("snapshot"))


def phase(spark: SparkSession, folder: str, name: str, fingerprint: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A phase's result: read if this phase was finished for the same fingerprint before, else built and written. A
    phase that broke off left no success mark and is built again."""
    path = f"{folder.rstrip('/')}/{name}-{fingerprint}"
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def replayed(pairs: DataFrame, judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decided, open) candidate pairs: those judged before on the same content keep their verdict, in either order."""
    order = lambda rows: rows.withColumn("_a", F.least("a", "b")).withColumn("_b", F.greatest("a", "b"))
    old = order(judged).select("_a", "_b", "content", "verdict").distinct()
    rows = order(pairs).join(old, ["_a", "_b", "content"], "left").drop("_a", "_b")
    return rows.where("verdict is not null"), rows.where("verdict is null").drop("verdict")


def supported(definitions: DataFrame, uses: DataFrame, live_units: DataFrame) -> DataFrame:
    """Definitions of a schema that a live unit still uses; they survive a new induction."""
    return definitions.join(uses.join(live_units, "unit_id", "left_semi").select("name").distinct(), "name", "left_semi")


def run_deltas(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(metric, current, previous, delta) of two runs; a delta only where both have the metric."""
    old = previous.select("metric", F.col("value").alias("previous"))
    rows = current.select("metric", F.col("value").alias("current")).join(old, "metric", "full")
    return rows.withColumn("delta", F.round(F.col("current") - F.col("previous"), 3) + F.lit(0.0))


def structured_checks(items: DataFrame, found: DataFrame) -> DataFrame:
    """(item_id, rule, passed, total): how many selectors of each rule hold. ``items`` has item_id, rule (required_...
    or forbidden_...), kind and selector, a map of fields that one record must all have; ``found`` has item_id, kind and
    record, a map. Values compare without case and outer space."""
    wanted = items.withColumn("_s", F.monotonically_increasing_id())
    bare = lambda m: F.transform_values(m, lambda k, v: F.lower(F.trim(v)))
    holds = lambda s, r: F.forall(F.map_entries(bare(s)), lambda e: F.coalesce(F.try_element_at(bare(r), e["key"]) == e["value"], F.lit(False)))
    rows = wanted.join(found, ["item_id", "kind"], "left")
    hit = F.max(F.coalesce(holds(F.col("selector"), F.col("record")), F.lit(False)))
    per = rows.groupBy("item_id", "rule", "_s").agg(hit.alias("hit"))
    good = F.when(F.startswith("rule", F.lit("forbidden")), ~F.col("hit")).otherwise(F.col("hit"))
    return per.groupBy("item_id", "rule").agg(F.count_if(good).alias("passed"), F.count("*").alias("total"))


def paths_hold(paths: DataFrame, relations: DataFrame) -> DataFrame:
    """(path_id, holds): whether every edge (source, predicate, target) of a directed path is among the relations."""
    have = relations.select("source", "predicate", "target", F.lit(True).alias("_here")).distinct()
    return paths.join(have, ["source", "predicate", "target"], "left").groupBy("path_id").agg(F.every(F.coalesce("_here", F.lit(False))).alias("holds"))


def sampled(chunks: DataFrame, n: int, seed: int, least: int) -> DataFrame:
    """The first ``n`` chunks of at least ``least`` characters by a seeded hash of their ids: a sample that any run repeats."""
    return chunks.where(F.length("text") >= least).orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), "point_id"), 256)).limit(n)


