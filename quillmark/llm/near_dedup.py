"""Near-duplicate documents by MinHash bands, odd sketches and exact confirmation.

1. One pass over whole texts gives each document the set of its word shingles as 64-bit hashes, 24 band keys of 4
   MinHash values each, and an odd sketch: the minima of a one-permutation MinHash folded into a bitmap of parities.
2. Documents with equal sets collapse into a class, named by the number of one of its rows, before any pair is thought
   of. Rows are numbered, so that rows that repeat an id with another text are in classes of their own.
3. Classes that share a band key are candidates. The population count of two sketches' XOR estimates their
   similarity; pairs with an estimate far below the threshold go. What stays is passed on as a spanning forest.
4. The components of these forests are small groups of texts that may be alike. Their full sets meet once, links
   are confirmed exactly on them, and again only a spanning forest is passed on.
5. The components of the confirmed links are the result.

A pair at the threshold shares no band key with probability (1 - 0.8**4)**24 = 3e-6, and less above it. Buckets and
groups of any size are cut into blocks, and each pair of blocks is a task of its own, so no task holds more than two
blocks and no pairs are written out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import Forest, components, discard, settle, small_join, texts, whole

BANDS, ROWS = 24, 4
#: Bins of the one-permutation MinHash and bits of the odd sketch.
BIN_BITS, SKETCH_BITS = 9, 1024
#: A pair is a candidate while its estimated similarity is less than this below the threshold (over 5 standard errors).
MARGIN = 0.18
#: Members of a block of a bucket, and shingles of a block of a group.
BLOCK_MEMBERS, BLOCK_SHINGLES = 2_000, 1_000_000
CACHED_WORDS = 100_000

ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * ODD
    return x ^ (x >> np.uint64(32))


_FACTORS = _mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * ODD) | np.uint64(1)


class Words(dict):
    """64-bit hashes of words, kept for the first words that a worker meets."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < CACHED_WORDS:
            self[word] = h
        return h


def shingles(text: str, size: int, words: Words) -> np.ndarray:
    """Ascending distinct hashes of the shingles of ``size`` words; fewer words are one shingle, none give none.
    A-Z is lower-cased; words are apart by ASCII white space."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, n)
    k = min(n, size)
    x = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        x = _mixed(x * ODD + h[i : n - k + 1 + i]) if i == k - 1 else (x * ODD + h[i : n - k + 1 + i]) * MIX
    return np.unique(x + np.uint64(k))


def band_keys(found: np.ndarray) -> np.ndarray:
    """One key for each band: its MinHash values and its number, hashed."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 4096):
        np.minimum(low, (_FACTORS[:, None] * found[None, i : i + 4096]).min(1), out=low)
    low = low.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = _mixed(key * ODD + low[:, j])
    return key.view(np.int64)


def odd_sketch(found: np.ndarray) -> tuple[bytes, int]:
    """Parity bitmap of the smallest hash of each bin that has one, and the number of such bins."""
    bins = found >> np.uint64(64 - BIN_BITS)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]])) if len(found) else np.empty(0, np.int64)
    bits = (_mixed(found[first]) % np.uint64(SKETCH_BITS)).astype(np.int64)
    return np.packbits((np.bincount(bits, minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes(), len(first)


def estimates(one: np.ndarray, others: np.ndarray, filled: np.ndarray, sizes: np.ndarray, one_filled: int, one_size: int, threshold: float) -> np.ndarray:
    """Estimated similarity of a sketch to others. The XOR's population gives the number of samples that only one
    side has; the bins that the union fills are those expected at the threshold."""
    odd = np.bitwise_count(one ^ others).sum(1, dtype=np.int64) / SKETCH_BITS
    apart = -SKETCH_BITS / 2 * np.log1p(-2 * np.minimum(odd, 0.4999))
    bins = float(1 << BIN_BITS)
    union = bins * -np.expm1(-(sizes + one_size) / (1 + threshold) / bins)
    return (filled + one_filled - apart) / 2 / np.maximum(union, 1)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_hash, n, d1, d2, bands, sketch, filled) of every row; d1 and d2 name the set."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in rows:
            n, d1, d2, bands, sketches, filled = [], [], [], [], [], []
            for key, text in zip(b.column("doc_id").to_pylist(), texts(b.column("text")), strict=True):
                found = shingles(text, size, words)
                digest = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64)
                n.append(len(found))
                d1.append(int(digest[0]))
                d2.append(int(digest[1]))
                bands.append(band_keys(found) if len(found) and key is not None else np.empty(0, np.int64))
                s, k = odd_sketch(found)
                sketches.append(s)
                filled.append(k)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in bands])]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*bands, np.empty(0, np.int64)]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), keys, pa.array(sketches, pa.binary()), pa.array(filled, pa.int32())],
                names=["doc_id", "text_hash", "n", "d1", "d2", "bands", "sketch", "filled"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"), F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n long, d1 long, d2 long, bands array<long>, sketch binary, filled int")


def paired_blocks(rows: DataFrame, key: str, member: str, blocks: Column) -> DataFrame:
    """Deal the members of each key over ``blocks`` blocks, and repeat each row for every pair of blocks with its
    own: columns _b, _i, _j with _i <= _j and _b one of them."""
    dealt = rows.withColumn("_g", blocks.cast("int")).withColumn("_b", F.pmod(F.xxhash64(F.col(key), F.col(member)), F.col("_g")).cast("int"))
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    return dealt.withColumn("_i", F.least("_b", "_o")).withColumn("_j", F.greatest("_b", "_o")).drop("_g", "_o")


def grouped(rows: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The consecutive runs of rows with equal keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in rows:
        if not b.num_rows:
            continue
        k = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in keys], 1)
        cuts = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1, [len(k)]]).tolist()
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if held and tuple(k[lo]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(k[lo])
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["u", "v"])


def candidate_forest(bucketed: DataFrame, threshold: float) -> DataFrame:
    """Spanning forests, per pair of blocks of a bucket, of the pairs that the sketches leave."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        seen: set[tuple[int, int]] = set()
        for t in grouped(rows, ["key", "_i", "_j"]):
            ids = t["id"].to_numpy()
            if len(ids) < 2:
                continue
            sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint64).reshape(len(ids), -1)
            filled, n, block = t["filled"].to_numpy(), t["n"].to_numpy().astype(float), t["_b"].to_numpy()
            across = t["_i"][0] != t["_j"][0]
            forest, left = Forest(len(ids)), len(ids) - 1
            for x in range(len(ids) - 1):
                near = estimates(sketch[x], sketch[x + 1 :], filled[x + 1 :], n[x + 1 :], int(filled[x]), float(n[x]), threshold) >= threshold - MARGIN
                if across:
                    near &= block[x + 1 :] != block[x]
                for y in (np.flatnonzero(near) + x + 1).tolist():
                    if forest.join(x, y):
                        left -= 1
                        pair = (int(ids[x]), int(ids[y]))
                        if pair[0] != pair[1] and pair not in seen:
                            out.append(pair)
                            if len(seen) < 200_000:
                                seen.add(pair)
                if not left:
                    break
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        if out:
            yield _edges(out)

    dealt = bucketed.repartition("key", "_i", "_j").sortWithinPartitions("key", "_i", "_j", "id")
    return dealt.select("key", "_i", "_j", "_b", "id", "n", "filled", "sketch").mapInArrow(run, "u long, v long")


def confirmed_forest(sets: DataFrame, threshold: float) -> DataFrame:
    """Spanning forests, per pair of blocks of a group, of the links that the full sets confirm."""
    percent = round(threshold * 100)

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for t in grouped(rows, ["group", "_i", "_j"]):
            ids, block = t["id"].to_numpy(), t["_b"].to_numpy()
            if len(ids) < 2:
                continue
            own = [np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()]
            size = np.array([len(x) for x in own])
            flat, owner = np.concatenate(own), np.repeat(np.arange(len(own)), size)
            order = np.argsort(flat, kind="stable")
            hashes, start, count = np.unique(flat[order], return_index=True, return_counts=True)
            holders = owner[order]
            place = np.empty(len(flat), np.int64)
            place[order] = np.repeat(np.arange(len(hashes)), count)
            first = np.concatenate([[0], np.cumsum(size)])
            across = t["_i"][0] != t["_j"][0]
            forest, left = Forest(len(ids)), len(ids) - 1
            for x in range(len(ids)):
                at = place[first[x] : first[x + 1]]
                at = at[count[at] > 1]
                if not len(at):
                    continue
                lengths = count[at]
                spread = np.repeat(start[at] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
                both = np.bincount(holders[spread], minlength=len(ids))
                near = 100 * both >= percent * (size + size[x] - both)
                near[: x + 1] = False
                if across:
                    near &= block != block[x]
                for y in np.flatnonzero(near).tolist():
                    if forest.join(x, y):
                        left -= 1
                        if ids[x] != ids[y]:
                            out.append((int(ids[x]), int(ids[y])))
                if not left:
                    break
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        if out:
            yield _edges(out)

    dealt = sets.repartition("group", "_i", "_j").sortWithinPartitions("group", "_i", "_j", "id")
    return dealt.select("group", "_i", "_j", "_b", "id", "shingles").mapInArrow(run, "u long, v long")


def judged(docs: DataFrame, size: int, threshold: float) -> DataFrame:
    """(doc_id, text_hash, n, root, least) of every row: the component's number, null for rows that are linked with
    nothing by rule, and the component's smallest doc_id."""
    signed = settle(signatures(docs, size).withColumn("row", F.monotonically_increasing_id()), "signatures")
    named = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    classes = signed.where(named).groupBy("d1", "d2").agg(F.min("row").alias("rep"), F.min("doc_id").alias("least"))
    classes = settle(classes, "classes")

    reps = signed.where(named).join(classes.select(F.col("rep").alias("row")), "row", "left_semi")
    reps = settle(reps.select(F.col("row").alias("id"), "doc_id", "d1", "d2", "n", "bands", "sketch", "filled"), "classes-signed")
    rows = reps.select("id", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    dealt = paired_blocks(rows.join(shared, "key"), "key", "id", F.ceil(F.col("m") / BLOCK_MEMBERS)).drop("m")
    bucketed = dealt.join(reps.select("id", "n", "filled", "sketch"), "id")
    loose = components(candidate_forest(bucketed, threshold))
    members = loose.select(F.col("u").alias("id"), F.col("v").alias("group"))
    members = members.unionByName(members.select(F.col("group").alias("id"), "group").distinct())
    members = settle(members.join(reps.select("id", "doc_id", "d1", "d2"), "id"), "groups")
    discard(reps, loose)

    def sets(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sets of the rows whose set is their class's. Repeated rows of a class pass once in a task; more of
        them, from other tasks, add nothing to a group but their own equal set."""
        words, passed = Words(), set()
        for b in rows:
            take, n, found = [], [], []
            digests = zip(b.column("id").to_pylist(), b.column("d1").to_pylist(), b.column("d2").to_pylist(), texts(b.column("text")), strict=True)
            for i, (key, d1, d2, text) in enumerate(digests):
                own = shingles(text, size, words)
                if key not in passed and np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64).tolist() == [d1, d2]:
                    passed.add(key)
                    take.append(i)
                    n.append(len(own))
                    found.append(own.tobytes())
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("group").take(at), pa.array(n, pa.int64()), pa.array(found, pa.binary())], names=["id", "group", "n", "shingles"])

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    joined = small_join(wanted, members, ["doc_id"], "inner", 48).select("id", "group", "d1", "d2", "text")
    full = settle(joined.mapInArrow(sets, "id long, group long, n long, shingles binary"), "sets")
    sizes = full.groupBy("group").agg(F.sum("n").alias("m"))
    dealt = paired_blocks(full.join(sizes, "group"), "group", "id", F.ceil(F.col("m") / BLOCK_SHINGLES))
    linked = components(confirmed_forest(dealt, threshold))
    discard(full, members)

    # Only classes in links can have another's smallest id.
    inside = linked.select(F.col("u").alias("rep"), F.col("v").alias("root"))
    inside = inside.unionByName(inside.select(F.col("root").alias("rep"), "root").distinct())
    smallest = inside.join(classes.select("rep", "least"), "rep").groupBy("root").agg(F.min("least").alias("smallest"))
    component = classes.join(inside.join(smallest, "root"), "rep", "left")
    component = component.select("d1", "d2", F.coalesce("root", "rep").alias("root"), F.coalesce("smallest", "least").alias("least"))
    columns = ("doc_id", "text_hash", "n", "root", "least")
    alone = signed.where(~named).select("doc_id", "text_hash", "n", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("least"))
    return signed.where(named).select("doc_id", "text_hash", "n", "d1", "d2").join(component, ["d1", "d2"]).select(*columns).unionByName(alone)


def clusters(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs(doc_id, text)``.

    Two texts are linked if the Jaccard similarity of their sets of ``size``-word shingles is at least ``threshold``.
    Null and empty texts and texts without words have the empty set and are linked with nothing. A row without an id
    is linked with nothing; its component_id is null and it is kept. Repeated rows are all returned; rows that repeat
    an id with another text are judged by their own text. Other columns are ignored; an empty table gives no rows.
    """
    found = judged(docs, size, threshold)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("least")).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row of ``docs``, all columns, of each group: that with the smallest id, and of rows that repeat this id the
    one whose text has the smallest hash. Rows that repeat an id and a text stay once, though without words or links;
    rows without an id all stay; an empty table gives no rows."""
    rows = settle(judged(docs, size, threshold), "judged")
    first = rows.where("root is not null and doc_id = least").groupBy("root").agg(F.count_distinct("text_hash").alias("texts"), F.min("text_hash").alias("first"))
    gone = rows.where("doc_id <> least").select("doc_id", "text_hash")
    several = first.where("texts > 1").drop("texts")
    gone = gone.unionByName(small_join(rows, settle(several, "repeated-ids"), ["root"], "inner", 24).where("doc_id = least and text_hash <> first").select("doc_id", "text_hash"))
    gone = settle(gone.distinct(), "duplicates")
    again = settle(rows.where("doc_id is not null").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "text_hash", F.lit(True).alias("_again")), "repeated")
    # The row goes along as one column, so that no column of its own can clash.
    whole_rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.struct("*").alias("_whole"))
    stay = small_join(whole_rows, gone, ["doc_id", "text_hash"], "left_anti", 24)
    if again.isEmpty():
        return stay.select("_whole.*")
    marked = small_join(stay, again, ["doc_id", "text_hash"], "left", 24)
    once = marked.where("_again is null").select("_whole")
    return once.unionByName(marked.where("_again").dropDuplicates(["doc_id", "text_hash"]).select("_whole")).select("_whole.*")
