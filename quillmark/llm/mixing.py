"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of about equal size. A block j of a source with weight w has the release time
floor(j / w) and the deadline ceil((j + 1) / w); in each slot the released block with the earliest deadline goes next.
Every source then has, after any number of slots t, w t blocks give or take less than one. Weights are exact ratios of
integers, so nothing is rounded however long the input. One task deals the blocks one after the other and writes them in
runs; it holds a few numbers for each source and takes some microseconds for a block, and the driver holds nothing. When
a source has no blocks left, a new phase begins with the weights of the others.
"""

from __future__ import annotations

import heapq
import itertools
import math
from array import array
from collections.abc import Iterable, Iterator, Mapping
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import settle, small_join, whole

#: Code points of a block, and rows of the groups in which rows are numbered.
BLOCK, GROUP = 65_536, 20_000
#: Blocks of a source in one row of the joined schedule.
RUN = 512
#: Without a target, a source weighs its size to this power.
TEMPERATURE = 0.5


def shares(weights: Mapping[str, float]) -> dict[str, int]:
    """Integers in the exact proportions of the weights as they are written."""
    exact = {n: Fraction(repr(w)) for n, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    return {n: int(x * scale) for n, x in exact.items()}


def dealt(blocks: Mapping[str, int], weights: Mapping[str, float], run: int = RUN) -> Iterator[tuple[str, int, list[int], list[int], list[int]]]:
    """(source, run, slots, releases, deadlines) for runs of ``run`` blocks of each source in their order.

    In each slot the released block with the earliest deadline goes next, ties by the order of names; a phase ends with
    the last block of a source and the next begins there. All arithmetic is in integers. What is held is a few numbers
    and an unfinished run for each source, whatever the number of blocks."""
    names = sorted(n for n, b in blocks.items() if b > 0)
    weight = shares({n: weights[n] for n in names}) if names else {}
    done = dict.fromkeys(names, 0)
    open_runs = {n: (array("q"), array("q"), array("q")) for n in names}
    base = 0
    while names:
        period = sum(weight[n] for n in names)
        ready = [(-(-period // weight[n]), k, 0) for k, n in enumerate(names)]
        heapq.heapify(ready)
        waiting: list[tuple[int, int, int, int]] = []  # release, deadline, source, block of the phase
        t = 0
        while True:
            while waiting and waiting[0][0] <= t:
                heapq.heappush(ready, heapq.heappop(waiting)[1:])
            deadline, k, j = heapq.heappop(ready)
            n = names[k]
            w, columns = weight[n], open_runs[n]
            for column, x in zip(columns, (base + t, base + j * period // w, base + deadline), strict=True):
                column.append(x)
            t, j = t + 1, j + 1
            done[n] += 1
            last = done[n] == blocks[n]
            if last or len(columns[0]) == run:
                yield n, (done[n] - 1) // run, *(c.tolist() for c in columns)
                open_runs[n] = (array("q"), array("q"), array("q"))
            if last:
                break
            heapq.heappush(waiting, (j * period // w, -(-(j + 1) * period // w), k, j))
        base += t
        names = [x for x in names if x != n]


def _keyed(docs: DataFrame, groups: int) -> DataFrame:
    """Add _source, _size, _tie, _place and _group. The places are hashes of the ids and the groups are ranges of them,
    so a source with a third of all rows is in all groups, and its order doesn't depend on how many there are."""
    rows = docs.withColumn("_source", F.coalesce(F.col("source"), F.lit("")))
    rows = rows.withColumn("_place", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(3)), 33))
    rows = rows.withColumn("_group", F.expr(f"cast(_place * {groups}L div {1 << 31}L as int)"))
    rows = rows.withColumn("_size", F.greatest(F.length(whole()), F.lit(1)).cast("long"))
    return rows.withColumn("_tie", F.xxhash64("text"))  # here, so that texts that nobody asks for aren't shuffled


def _dealer(targets: Mapping[str, float]):
    """All sources' rows (_source, size, n) to the runs of the schedule, written as they are dealt."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, blocks = {}, {}
        for b in rows:
            for s, size, n in zip(b.column("_source").to_pylist(), b.column("size").to_pylist(), b.column("n").to_pylist(), strict=True):
                sizes[s], blocks[s] = size, n
        weights = {s: float(targets.get(s) or 0) or size**TEMPERATURE for s, size in sizes.items()}
        found = dealt(blocks, weights)
        while held := list(itertools.islice(found, 256)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.string(), pa.int64(), *[pa.list_(pa.int64())] * 3), strict=True)], names=["_source", "_run", "_slots", "_releases", "_deadlines"]
            )

    return run


def _before(column: str) -> Column:
    """Sum of a column over the earlier groups of the source."""
    by = Window.partitionBy("_source").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(by), F.lit(0))


def _grouped(docs: DataFrame, groups: int, starts: DataFrame) -> DataFrame:
    """Add the row's place _row in its source, its block _raw by the source's running size, and the number _local of
    that block in its source and group. ``starts`` has the rows and sizes of the earlier groups, so blocks cross the
    borders of groups."""
    rows = small_join(_keyed(docs, groups), starts, ["_source", "_group"], "inner", 80)
    by = Window.partitionBy("_source", "_group").orderBy("_place", F.col("doc_id").asc_nulls_first(), F.col("_tie"))
    before = F.coalesce(F.sum("_size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_raw", F.floor((F.col("_start") + before) / BLOCK)).withColumn("_row", F.col("_rows") + F.row_number().over(by))
    return rows.withColumn("_local", F.dense_rank().over(Window.partitionBy("_source", "_group").orderBy("_raw")) - 1)


def scheduled(docs: DataFrame, targets: Mapping[str, float] | None = None) -> tuple[DataFrame, int]:
    """``docs`` with the columns _source, _block, _slot, _release, _deadline and _within (the row's place in its
    block), and the number of slots. One task deals the blocks, from a row for each source, into a table of runs."""
    groups = max(1, -(-docs.count() // GROUP))
    narrow = docs.select("doc_id", "source", "text")
    sizes = _keyed(narrow, groups).groupBy("_source", "_group").agg(F.count("*").alias("rows"), F.sum("_size").alias("size"))
    sizes = settle(sizes, "mix-sizes")
    starts = settle(sizes.select("_source", "_group", _before("rows").alias("_rows"), _before("size").alias("_start")), "mix-starts")
    counted = _grouped(narrow, groups, starts).groupBy("_source", "_group")
    counted = counted.agg((F.max("_local") + 1).alias("n"), F.min("_raw").alias("low"), F.max("_raw").alias("high"))
    # A group begins in the block in which the one before it ends, or in a new one.
    again = F.lag("high").over(Window.partitionBy("_source").orderBy("_group")) == F.col("low")
    counted = settle(counted.withColumn("again", F.coalesce(again, F.lit(False)).cast("long")).withColumn("fresh", F.expr("n - again")), "mix-groups")
    offsets = counted.select("_source", "_group", (_before("fresh") - F.col("again")).alias("_first"))
    offsets = starts.join(offsets, ["_source", "_group"])
    blocks = counted.groupBy("_source").agg(F.sum("fresh").alias("n"))
    totals = settle(sizes.groupBy("_source").agg(F.sum("size").alias("size")).join(blocks, "_source"), "mix-sources")
    plan = settle(totals.coalesce(1).mapInArrow(_dealer(targets or {}), "_source string, _run long, _slots array<long>, _releases array<long>, _deadlines array<long>"), "mix-plan")

    rows = _grouped(docs, groups, settle(offsets, "mix-offsets"))
    rows = rows.withColumn("_block", F.col("_first") + F.col("_local")).withColumn("_run", F.expr(f"_block div {RUN}"))
    rows = small_join(rows, plan, ["_source", "_run"], "inner", 64 + 24 * RUN)
    for name, column in (("_slot", "_slots"), ("_release", "_releases"), ("_deadline", "_deadlines")):
        rows = rows.withColumn(name, F.expr(f"element_at({column}, cast(_block % {RUN} + 1 as int))"))
    rows = rows.withColumnRenamed("_row", "_within").drop("_run", "_slots", "_releases", "_deadlines", "_raw", "_group", "_size", "_tie", "_place", "_rows", "_start", "_local", "_first")
    return rows, totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def schedule(docs: DataFrame, targets: Mapping[str, float] | None = None) -> DataFrame:
    """doc_id, source, block, slot, release, deadline, within of every row of ``docs(doc_id, source, text)``.

    Sources without a positive target weigh the square root of their size. A null source is the source '' in the
    schedule; null and empty texts are documents of size 1; null ids and repeated rows are scheduled like others;
    equal ids are ordered by a hash of their texts; other columns are ignored; an empty table gives no rows.
    """
    rows, _ = scheduled(docs.select("doc_id", "source", "text"), targets)
    return rows.select("doc_id", "source", *(F.col(f"_{c}").cast("long").alias(c) for c in ("block", "slot", "release", "deadline", "within")))


def mixed(docs: DataFrame, targets: Mapping[str, float] | None = None) -> DataFrame:
    """All rows and columns of ``docs`` in the order of the schedule: partitions in order, sorted inside."""
    # The row goes along as one column, so that no column of its own can clash.
    scaledrows = docs.select("doc_id", "source", "text", F.struct("*").alias("_whole"))
    rows, slots = scheduled(scaledrows, targets)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("_part", F.expr(f"cast(_slot * {parts}L div {max(slots, 1)}L as int)"))
    return rows.repartitionById(parts, F.col("_part")).sortWithinPartitions("_slot", "_within").select("_whole.*")
