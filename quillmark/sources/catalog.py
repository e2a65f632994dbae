"""Versioned tables: Parquet under one folder for each version, and a pointer that is switched last.

A writer that fails leaves the old version readable; a reader fixes the version it began with.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Catalog:
    """Tables below ``root``; all access goes through Spark's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, text: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)

    def _files(self, text: str):
        return self._path(text).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, table: str) -> list[str]:
        folder = self._path(f"{self.root}/{table}/_pointers")
        fs = self._files(f"{self.root}/{table}")
        return sorted(x.getPath().getName() for x in fs.listStatus(folder)) if fs.exists(folder) else []

    def versions(self, table: str) -> list[str]:
        """Activated versions, oldest first."""
        return [x.split("-", 1)[1] for x in self._names(table) if "-" in x]

    def turn(self, table: str) -> int:
        """The next free turn: the number that the next activation must claim."""
        return max((int(x.split("-", 1)[0]) + 1 for x in self._names(table)), default=0)

    def read(self, table: str, version: str | None = None) -> DataFrame:
        """The active version, or the pinned one."""
        version = version or self.versions(table)[-1]
        return self.spark.read.parquet(f"{self.root}/{table}/{version}")

    def stage(self, df: DataFrame, table: str, partition_by: tuple[str, ...] = ()) -> str:
        """Write a new version that nobody sees yet."""
        version = uuid.uuid4().hex
        df.write.partitionBy(*partition_by).parquet(f"{self.root}/{table}/{version}")
        return version

    def activate(self, table: str, version: str, expect_rows: int | None = None, turn: int | None = None) -> None:
        """Check the staged version, claim a turn and then create its pointer, one atomic step for readers. A turn's
        claim is a file that only one writer can create; a writer that fails after its claim leaves the turn empty.
        With ``turn``, taken before the version was made, an activation in between makes this one fail. Activating an
        old version again is a rollback."""
        staged = self.spark.read.parquet(f"{self.root}/{table}/{version}")
        if expect_rows is not None and (n := staged.count()) != expect_rows:
            raise ValueError(f"{table} {version}: {n} rows, {expect_rows} expected")
        folder = f"{self.root}/{table}/_pointers"
        fs = self._files(folder)
        mine = self.turn(table) if turn is None else turn
        try:
            fs.create(self._path(f"{folder}/{mine:09d}"), False).close()
        except Py4JJavaError as taken:
            raise ValueError("another writer has activated a version") from taken
        fs.create(self._path(f"{folder}/{mine:09d}-{version}"), False).close()

    def write(self, df: DataFrame, table: str, turn: int | None = None) -> str:
        version = self.stage(df, table)
        self.activate(table, version, turn=turn)
        return version

    def upsert(self, rows: DataFrame, table: str, key: list[str]) -> str:
        """Rows replace those of equal key, others stay; a new version. Fails if another writer was faster, whose rows
        would be lost."""
        turn = self.turn(table)
        if not self.versions(table):
            return self.write(rows, table, turn)
        return self.write(self.read(table).join(rows.select(*key), key, "left_anti").unionByName(rows), table, turn)

    def compact(self, table: str, files: int) -> str:
        """The active version in as many files."""
        turn = self.turn(table)
        return self.write(self.read(table).repartition(files), table, turn)

    def expire(self, table: str, keep: int = 3) -> list[str]:
        """Delete all but the newest versions; the active one always stays."""
        order = list(dict.fromkeys(reversed(self.versions(table))))
        for v in order[keep:]:
            self._files(self.root).delete(self._path(f"{self.root}/{table}/{v}"), True)
        return order[keep:]


def misses(requests: DataFrame, cache: DataFrame, parts: list[Column]) -> DataFrame:
    """Requests whose hash of all parts has no usable response in the cache (response not null or empty)."""
    keyed = requests.withColumn("cache_key", F.sha2(F.concat_ws("\x1f", *parts), 256))
    return keyed.join(cache.where("response is not null and response <> ''").select("cache_key"), "cache_key", "left_anti")


def reused_vectors(rows: DataFrame, previous: DataFrame) -> DataFrame:
    """Rows (id, text_sha) with the previous vector of an unchanged text; null where one is to be made."""
    old = previous.select("text_sha", "vector").withColumn("_k", F.row_number().over(Window.partitionBy("text_sha").orderBy(F.hash("vector")))).where("_k = 1").drop("_k")
    return rows.join(old, "text_sha", "left")
