"""Conflict-constrained best-fit packing of documents into sequences of a fixed number of tokens.

Documents are cut into pieces of at most a sequence. Within a shard the pieces go, largest first, into the open bin
with the smallest residual that holds the piece and is compatible: a bin carries a bitmap of the sources that have as
many pieces in it as they may and a bitmap of the duplicate clusters in it. Bins are kept by residual, and the search
passes on to the successor until a compatible bin is found; without one a new bin is opened.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import settle, small_join, texts, whole
from quillmark.llm.token_output import chunked, encoder

#: Tokens of a sequence, pieces of one source in it, and documents of a shard.
CAPACITY, PER_SOURCE, SHARD = 8_192, 4, 4_096


class Bins:
    """Open bins by residual. Sources and clusters are small numbers, bits of Python integers."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.by_residual: dict[int, list[int]] = {}
        self.residuals = 0  # bit r is set if a bin has residual r
        self.residual: list[int] = []
        self.full: list[int] = []  # bitmap of sources at their limit
        self.clusters: list[int] = []
        self.count: list[dict[int, int]] = []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Put a piece into the tightest compatible bin: its number, and the tokens in it before."""
        r, rest = size, self.residuals >> size
        while rest:
            step = (rest & -rest).bit_length() - 1
            r, rest = r + step, rest >> step
            for b in self.by_residual[r]:
                if not self.full[b] >> source & 1 and not (cluster >= 0 and self.clusters[b] >> cluster & 1):
                    self._move(b, r, r - size)
                    self._mark(b, source, cluster)
                    return b, self.capacity - r
            r, rest = r + 1, rest >> 1
        b = len(self.residual)
        self.residual.append(self.capacity)
        self.full.append(0)
        self.clusters.append(0)
        self.count.append({})
        self._move(b, None, self.capacity - size)
        self._mark(b, source, cluster)
        return b, 0

    def _move(self, b: int, old: int | None, new: int) -> None:
        if old is not None:
            peers = self.by_residual[old]
            peers.remove(b)
            if not peers:
                self.residuals &= ~(1 << old)
        self.residual[b] = new
        self.by_residual.setdefault(new, []).append(b)
        self.residuals |= 1 << new

    def _mark(self, b: int, source: int, cluster: int) -> None:
        n = self.count[b][source] = self.count[b].get(source, 0) + 1
        if n >= self.per_source:
            self.full[b] |= 1 << source
        if cluster >= 0:
            self.clusters[b] |= 1 << cluster


def pack_shard(n_tokens: list[int], sources: list[str | None], clusters: list[int], capacity: int, per_source: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (document, piece, start in document, tokens, bin, tokens in the bin before) of one shard, documents by
    their place in the lists; equal sizes go in that order. Every token is in one piece."""
    pieces = sorted((-min(capacity, n - at), i, k, at) for i, n in enumerate(n_tokens) for k, at in enumerate(range(0, max(n, 1), capacity)))
    name: dict = {}
    number = [name.setdefault(s, len(name)) for s in sources]
    seen: dict[int, int] = {}
    for c in clusters:
        seen[c] = seen.get(c, 0) + 1
    # A cluster needs a bit only if two pieces of the shard are in it.
    bits = {c: b for b, c in enumerate(c for c, n in seen.items() if n > 1)}
    bins = Bins(capacity, per_source)
    out = []
    for negative, i, k, at in pieces:
        b, before = bins.place(-negative, number[i], bits.get(clusters[i], -1))
        out.append((i, k, at, -negative, b, before))
    return out


def measured(docs: DataFrame, vocabulary: str, in_order: bool, cluster: str | None) -> DataFrame:
    """shard, doc_id, source, n_tokens (with the end id) and cluster of every row.

    In order, shards are runs of the rows of all files, by the files' paths and the rows' places in them. Otherwise
    rows are dealt to shards by a hash of their place, so that sources and repeated rows spread over all shards however
    the files are sorted. The cluster is the column of that name, or a hash of the lower-cased words."""
    names = ["doc_id", "source", "text"] + ([cluster] if cluster else [])
    try:
        rows = docs.select(*names, F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:  # not read from files: rows are numbered by their partitions
        rows = docs.select(*names, F.spark_partition_id().cast("string").alias("_path"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_row"))
    counts = settle(rows.groupBy("_path").agg(F.count("*").alias("n")), "files")
    if in_order:
        before = F.coalesce(F.sum("n").over(Window.orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        place = small_join(rows, settle(counts.select("_path", before.alias("_before")), "file-starts"), ["_path"], "inner", 300)
        shard = F.floor((F.col("_before") + F.col("_row")) / SHARD)
    else:
        n = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        place, shard = rows, F.pmod(F.xxhash64("_path", "_row"), F.lit(max(1, -(-n // SHARD))))

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in chunked(rows, "text"):
            found = texts(b.column("text"))
            n = enc.count(b.column("text")) + 1
            if cluster:
                same = b.column("cluster").to_numpy(zero_copy_only=False)
            else:
                same = np.array([xxhash.xxh64_intdigest(" ".join(t.lower().split()).encode("utf-8", "surrogatepass")) for t in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("doc_id"), b.column("source"), pa.array(n, pa.int64()), pa.array(same)], names=["shard", "doc_id", "source", "n_tokens", "cluster"])

    own = F.coalesce(F.col(cluster).cast("long"), F.xxhash64("_path", "_row")) if cluster else F.lit(0).cast("long")
    rows = place.select(shard.cast("string").alias("shard"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), whole().alias("text"), own.alias("cluster"))
    return rows.mapInArrow(run, "shard string, doc_id long, source string, n_tokens long, cluster long")


def packed(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, per_source: int = PER_SOURCE, in_order: bool = False, cluster: str | None = None) -> DataFrame:
    """bin_id, bin_start, doc_id, source, piece, start, n_tokens of every piece of every row.

    A bin holds at most ``capacity`` tokens, at most ``per_source`` pieces of one source and no two pieces of one
    duplicate cluster: rows of equal lower-cased words, or of equal values in the column ``cluster``, such as the
    component_id of near duplicates (null: a cluster of its own). Bins stay within a shard, so which rows can meet
    depends on the rows' places in the files, and with ``in_order`` they are neighbours there. Null texts are empty and hold their end id alone; null sources are one source; null ids and
    repeated rows are packed like others; other columns are ignored; an empty table gives no rows. Shards are of
    bounded size and packed independently, so only numbers are shuffled and tasks do not grow with the input.
    """
    rows = measured(docs, vocabulary, in_order, cluster).repartition("shard").sortWithinPartitions("shard", F.desc("n_tokens"), F.col("doc_id").asc_nulls_first(), "cluster")

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        shard = None

        def done() -> pa.RecordBatch:
            found = pack_shard(held["n_tokens"], held["source"], held["cluster"], capacity, per_source)
            columns = list(zip(*found, strict=True))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{shard}/{b}" for b in columns[4]], pa.string()),
                    pa.array(columns[5], pa.int64()),
                    pa.array([held["doc_id"][i] for i in columns[0]], pa.int64()),
                    pa.array([held["source"][i] for i in columns[0]], pa.string()),
                    pa.array(columns[1], pa.int64()),
                    pa.array(columns[2], pa.int64()),
                    pa.array(columns[3], pa.int64()),
                ],
                names=["bin_id", "bin_start", "doc_id", "source", "piece", "start", "n_tokens"],
            )

        names = ("doc_id", "source", "n_tokens", "cluster")
        for b in rows:
            for s, *row in zip(b.column("shard").to_pylist(), *(b.column(c).to_pylist() for c in names), strict=True):
                if s != shard:
                    if held:
                        yield done()
                    shard, held = s, {c: [] for c in names}
                for c, x in zip(names, row, strict=True):
                    held[c].append(x)
        if held:
            yield done()

    return rows.mapInArrow(run, "bin_id string, bin_start long, doc_id long, source string, piece long, start long, n_tokens long")
