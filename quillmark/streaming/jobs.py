"""Streams of events: windows with watermarks, deduplication and the job queue as a stateful operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, name: str = "*.parquet") -> DataFrame:
    """A stream over Parquet files of events as they arrive in a folder."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("at", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str, late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("at", late).groupBy(F.window("at", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str, step: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("at", late).groupBy(F.window("at", size, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("at", late).groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


def job_states(events: DataFrame) -> DataFrame:
    """Each job as a state machine: purchase starts it, error counts an attempt and returns it to the queue, other events
    keep it alive, and it is dead from five attempts on. Its state is an aggregate: the errors so far, and which of the
    two kinds came last; so late events count where they belong."""
    rows = events.select(F.concat(F.lit("job"), "user_id").alias("job"), "at", "event_id", "event_type")
    decisive = F.when(F.col("event_type").isin("error", "purchase"), F.struct("at", "event_id", "event_type"))
    sums = rows.groupBy("job").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.max(decisive).alias("last"), F.count("*").alias("events"))
    state = F.when(F.col("errors") >= 5, "dead").when(F.col("last.event_type") == "purchase", "running").otherwise("queued")
    return sums.select("job", state.alias("state"), F.least(F.col("errors"), F.lit(5)).cast("long").alias("attempts"), "events")


def drain_to(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Process all that is there into Parquet below ``folder`` and read it with each row's ``_batch``. A batch writes
    its own folder, so one that is replayed after a failure replaces itself. Of complete results the last batch is
    read; of updates all are, and the last of each key counts."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={number}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.parquet(f"{folder}/table").withColumnRenamed("batch", "_batch")
    if mode != "complete":
        return rows
    return rows.where(F.col("_batch") == rows.agg(F.max("_batch")).first()[0])
