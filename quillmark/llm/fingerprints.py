"""Document fingerprints by consistent weighted sampling.

A document is the multiset of its lower-cased words, each weighted by its count times its length. For every term and
sample a gamma(2, 1) step r, a gamma(2, 1) value c and a uniform shift beta are drawn from a hash of the term; the
weight S is rounded down to exp(r (t - beta)) with t = floor(ln S / r + beta), and the term with the smallest
ln c - r (t - beta) - r is the sample. Two documents draw the same (term, t) with a probability equal to the
generalised Jaccard similarity of their weights, sum of minima over sum of maxima.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import whole

SAMPLES = 128
#: Bits of a sample in the fingerprint; two hexadecimal digits for each eight.
TAG_BITS = 16
#: Rows of samples, one for each (term, count), that a worker keeps (a kilobyte each).
CACHED_ROWS = 50_000
#: Letters of a term that may be kept with its row; the rows of longer ones are computed again.
KEPT_LETTERS = 64
#: Terms gathered at once, and rows computed at once, so that the work stays in the processor's caches.
TERMS_AT_ONCE, ROWS_AT_ONCE = 4_096, 128
#: Rows of a table that a worker holds at once, and their code points; the row that passes a bound is still held.
PART_ROWS, PART_CHARS = 2_000, 2_000_000
#: Bits that choose a gamma quantile.
QUANTILE_BITS = 12

ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def _gamma_quantiles(n: int) -> np.ndarray:
    """Quantiles of the gamma(2, 1) law, whose tail is (1 + x) exp(-x), at the n midpoints, by bisection."""
    p = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 60.0)
    for _ in range(80):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * ODD
    return x ^ (x >> np.uint64(32))


class Sampler:
    """Sample rows of terms, and fingerprints of term counts."""

    def __init__(self):
        self.gamma = _gamma_quantiles(1 << QUANTILE_BITS)
        self.inverse, self.log_gamma = 1 / self.gamma, np.log(self.gamma)
        self.salts = _mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64) * ODD)
        self.place: dict[tuple[str, int], int] = {}
        # Rows that stay, then room for the other rows of a group.
        self.kept = np.empty((CACHED_ROWS + 2 * TERMS_AT_ONCE, SAMPLES))
        self.buffer = np.empty((TERMS_AT_ONCE, SAMPLES))

    def rows(self, terms: list[tuple[str, int]], out: np.ndarray) -> np.ndarray:
        """ln a of each sample for each (term, count), its lowest 16 bits replaced by a hash of term, sample and t."""
        h = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w, _ in terms), np.uint64, len(terms))
        weight = np.log(np.fromiter((n * len(w) for w, n in terms), np.float64, len(terms)))
        low, bits = np.uint64((1 << QUANTILE_BITS) - 1), np.uint64(QUANTILE_BITS)
        for i in range(0, len(terms), ROWS_AT_ONCE):
            x = _mixed(h[i : i + ROWS_AT_ONCE, None] ^ self.salts)
            k = (x & low).view(np.int64)
            beta = (x >> np.uint64(48)).astype(np.float64)
            beta += 0.5
            beta *= 1 / 65536
            t = self.inverse[k]
            t *= weight[i : i + ROWS_AT_ONCE, None]
            t += beta
            np.floor(t, out=t)
            beta -= t
            beta -= 1  # now -(t - beta) - 1
            beta *= self.gamma[k]
            beta += self.log_gamma[(x >> bits & low).view(np.int64)]
            x ^= t.astype(np.int64).view(np.uint64) * ODD
            x *= MIX
            x >>= np.uint64(64 - TAG_BITS)
            key = beta.view(np.uint64)
            key >>= np.uint64(TAG_BITS)
            key <<= np.uint64(TAG_BITS)
            key |= x
            out[i : i + ROWS_AT_ONCE] = beta
        return out

    def signatures(self, docs: list[Counter]) -> np.ndarray:
        """Tags (documents x samples); a document without terms has zeros, the low bits of infinity."""
        low = np.full((len(docs), SAMPLES), np.inf)
        group, size = [], 0
        for i, d in enumerate(docs):
            items = list(d.items())
            for j in range(0, len(items), TERMS_AT_ONCE):
                group.append((i, items[j : j + TERMS_AT_ONCE]))
                size += len(group[-1][1])
                if size >= TERMS_AT_ONCE:
                    self._group(group, low)
                    group, size = [], 0
        if group:
            self._group(group, low)
        return (low.view(np.uint64) & np.uint64((1 << TAG_BITS) - 1)).astype(np.uint16)

    def _group(self, group: list[tuple[int, list[tuple[str, int]]]], low: np.ndarray) -> None:
        """Lower the samples of documents by pieces (document, terms), of fewer than 2 * TERMS_AT_ONCE terms in all."""
        get = self.place.get
        known = [[get(x, -1) for x in piece] for _, piece in group]
        missing = list(dict.fromkeys(x for (_, piece), k in zip(group, known, strict=True) if -1 in k for x, at in zip(piece, k, strict=True) if at < 0))
        number: dict[tuple[str, int], int] = {}
        if missing:
            first = len(self.place)
            keep = [x for x in missing if len(x[0]) <= KEPT_LETTERS][: CACHED_ROWS - first]
            self.rows(keep, self.kept[first : first + len(keep)])
            self.place.update((x, first + i) for i, x in enumerate(keep))
            rest = [x for x in missing if x not in self.place]
            self.rows(rest, self.kept[CACHED_ROWS : CACHED_ROWS + len(rest)])
            number = {x: CACHED_ROWS + i for i, x in enumerate(rest)}
        for (i, piece), k in zip(group, known, strict=True):
            if -1 in k:
                k = [at if at >= 0 else number[x] if x in number else get(x) for x, at in zip(piece, k, strict=True)]
            found = np.take(self.kept, k, axis=0, out=self.buffer[: len(k)], mode="clip").min(0)
            np.minimum(low[i], found, out=low[i])


def terms(text: str) -> Counter:
    return Counter(text.lower().split())


def likeness(a: np.ndarray, b: np.ndarray, a_terms: bool, b_terms: bool) -> float:
    """Share of equal samples less what 16-bit tags agree on by chance; 1 for two documents without terms, 0 for one."""
    if not (a_terms and b_terms):
        return float(a_terms == b_terms)
    chance = 2.0**-TAG_BITS
    return max(0.0, (float((a == b).mean()) - chance) / (1 - chance))


def shown(tags: np.ndarray) -> str:
    return tags.astype(">u2").tobytes().hex()


_sampler: list[Sampler] = []


def sampler() -> Sampler:
    if not _sampler:
        _sampler.append(Sampler())
    return _sampler[0]


def fingerprint(text: str | None) -> str:
    """Fingerprint of one text, 512 hexadecimal digits; equal texts have equal ones."""
    return shown(sampler().signatures([terms(text or "")])[0])


def ranges(docs: DataFrame, n: int) -> Column:
    """Number of the range of ``doc_id`` that a row is in, 0 up to about n; nulls are in range 0, equal ids in one.

    The bounds are approximate quantiles, so ranges hold like numbers of rows. They are looked up in two levels."""
    found = docs.stat.approxQuantile("doc_id", [(i + 1) / n for i in range(n - 1)], 0.2 / n) if n > 1 else []
    bounds = sorted({int(x) for x in found})
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds)) + 1
    parts = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    literal = lambda xs: f"array({','.join(f'{x}L' for x in xs)})"
    coarse = f"size(filter({literal(p[-1] for p in parts)}, x -> x < doc_id))"
    fine = f"size(filter(element_at(array({','.join(map(literal, parts))}), _part + 1), x -> x < doc_id))"
    whole_parts = f"case when doc_id is null then 0 when _part >= {len(parts)} then {len(bounds)} else _part * {width} + {fine} end"
    return F.expr(whole_parts.replace("_part", f"({coarse})"))


def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple[int, int, int | None, str]]]:
    """Runs of two or more rows (range, guest, doc_id, text) in their order, bounded by rows and by code points. The last
    row of a run is the first of the next one, unless it is a guest: a range ends with its guest, so every other row has
    its next row in its run."""
    held: list[tuple[int, int, int | None, str]] = []
    size = 0
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("range", "guest", "doc_id", "text")), strict=True):
            held.append(row)
            size += len(row[3])
            if len(held) > 1 and (size > PART_CHARS or len(held) > PART_ROWS):
                yield held
                held, size = [] if row[1] else [row], 0
    if len(held) > 1:
        yield held


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text is the text with its last floor(n_chars / 4) code points replaced by the first as many, or all,
    of the next row's, in ascending order of doc_id (nulls first) and then text; after the last row comes the first.
    Null texts are empty; repeated rows are all returned; other columns are ignored; an empty table gives no rows.

    One shuffle: rows are dealt by ranges of doc_id, and each range also gets the first row of the range after it.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.withColumn("range", ranges(docs, n).cast("int"))
    # The first id of each range that has rows, and its first text; that row goes to the range before it, as a guest.
    # Ids alone are aggregated over the table: texts would be sorted for it. There are as many rows as ranges.
    full = sorted(tuple(r) for r in dealt.groupBy("range").agg(F.min("doc_id"), F.max(F.col("doc_id").isNull())).collect())
    firsts = spark.createDataFrame([(None if none else first, full[i - 1][0]) for i, (_, first, none) in enumerate(full)], "first long, before int")
    heads = dealt.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("first", "before").agg(F.min("text").alias("text"))
    guests = heads.select(F.col("first").alias("doc_id"), "text", F.col("before").alias("range"), F.lit(1).alias("guest"))
    rows = dealt.withColumn("guest", F.lit(0)).unionByName(guests)

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sampler()

        def done(part: list[tuple[int, int, int | None, str]]) -> pa.RecordBatch:
            """Rows for all of ``part`` that have their next row in it."""
            pairs = [(a, b) for a, b in zip(part[:-1], part[1:], strict=True) if not a[1]]
            after = [a[3][: len(a[3]) - len(a[3]) // 4] + b[3][: len(a[3]) // 4] for a, b in pairs]
            counts = [terms(x[3]) for x in part]
            changed = [terms(t) for t in after]
            at = [i for i, a in enumerate(part[:-1]) if not a[1]]
            # A text stands beside its edited text, so that most of their rows are computed once.
            order = sorted([(i, 0) for i in range(len(part))] + [(i, 1) for i in at])
            of = dict(zip(at, changed, strict=True))
            both = s.signatures([of[i] if edited else counts[i] for i, edited in order])
            tags = both[[k for k, (_, edited) in enumerate(order) if not edited]]
            other = both[[k for k, (_, edited) in enumerate(order) if edited]]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([a[2] for a, _ in pairs], pa.int64()),
                    pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in after], pa.string()),
                    pa.array([shown(tags[i]) for i in at], pa.string()),
                    pa.array([shown(x) for x in other], pa.string()),
                    pa.array([likeness(tags[i], other[k], bool(counts[i]), bool(changed[k])) for k, i in enumerate(at)], pa.float64()),
                    pa.array([likeness(tags[i], tags[i + 1], bool(counts[i]), bool(counts[i + 1])) for i in at], pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        yield from map(done, parts(rows))

    dealt = rows.repartition(n // 4, "range").sortWithinPartitions("range", "guest", "doc_id", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("range", "guest", "doc_id", "text").mapInArrow(run, schema)
