"""Toxicity by a factorization machine over hashed terms.

A document's terms are its lower-cased words and their prefixes, hashed; a term seen twice or more also gives a
second feature. The machine adds to the linear weights a low-rank weight for every pair of terms, so that an insult
next to the mention of a group can count for more than either alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import held_out, texts, training_sample, whole

WORDS = re.compile(r"[^\W\d_]+")
#: Lengths of the prefixes that count as terms of their own.
PREFIXES = (4, 5, 6)
HASH_BITS = 20
#: Words whose terms a worker keeps.
CACHED_WORDS = 100_000
#: The most labelled documents, and code points in them, that are gathered to fit the machine.
SAMPLE, SAMPLE_CHARS = 8_000, 60_000_000
#: Terms kept: the strongest by the z-score of their document frequencies in the two classes.
TERMS, LEAST_Z, LEAST_DOCS = 2_000, 4.0, 5
RANK, EPOCHS, STEP, DECAY = 8, 250, 0.03, 2e-3
THRESHOLD = 0.5


def terms_of(word: str) -> list[int]:
    """Hashed terms of one lower-cased word, each even; the odd neighbour stands for a second sight of the term."""
    found = [word] + [word[:n] + "~" for n in PREFIXES if len(word) > n]
    return [zlib.crc32(t.encode()) % (1 << HASH_BITS) << 1 for t in found]


def features(text: str, known: dict[str, list[int]], limit: int = CACHED_WORDS) -> np.ndarray:
    """Distinct features of a whole text, ascending."""
    once: set[int] = set()
    twice: set[int] = set()
    for w in WORDS.findall(text.lower()):
        got = known.get(w)
        if got is None:
            got = terms_of(w)
            if len(known) < limit:
                known[w] = got
        for t in got:
            if t in once:
                twice.add(t + 1)
            else:
                once.add(t)
    return np.array(sorted(once | twice), np.int32)


@dataclass
class Machine:
    """terms: the features kept, ascending; bias, linear weights and factors belong to them."""

    terms: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, rows: list[np.ndarray]) -> np.ndarray:
        """Scores before the logistic of rows of positions in ``terms``."""
        out = np.full(len(rows), self.bias)
        for i, x in enumerate(rows):
            if len(x):
                v = self.factors[x]
                s = v.sum(0)
                out[i] += self.linear[x].sum() + 0.5 * float(s @ s - (v * v).sum())
        return out


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Machine:
    """Choose terms, then minimise the logistic loss with decay by Adam. Without both classes the machine is
    its bias alone, the smoothed share of label 1."""
    n, ones = len(rows), int(labels.sum())
    bias = float(np.log((ones + 0.5) / (n - ones + 0.5)))
    none = Machine(np.empty(0, np.int64), bias, np.empty(0), np.empty((0, RANK)))
    if not 0 < ones < n:
        return none
    size = 2 << HASH_BITS
    with_1 = np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if y]), minlength=size)
    with_any = np.bincount(np.concatenate(rows), minlength=size)
    p1, p0, p = with_1 / ones, (with_any - with_1) / (n - ones), with_any / n
    z = (p1 - p0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / ones + 1 / (n - ones)))
    z[(with_any < LEAST_DOCS) | (np.abs(z) < LEAST_Z)] = 0
    terms = np.sort(np.argsort(-np.abs(z), kind="stable")[: min(TERMS, np.count_nonzero(z))])
    if not len(terms):
        return none
    at = np.full(size, -1, np.int64)
    at[terms] = np.arange(len(terms))
    rows = [x[x >= 0] for x in (at[r] for r in rows)]
    where = np.concatenate(rows)
    of = np.repeat(np.arange(n), [len(r) for r in rows])
    y = labels.astype(float)
    m = Machine(terms, bias, np.zeros(len(terms)), np.random.default_rng(seed).normal(0, 0.02, (len(terms), RANK)))
    state = [np.zeros(1), np.zeros(len(terms)), np.zeros((len(terms), RANK))]
    square = [np.zeros_like(s) for s in state]
    values = [np.array([bias]), m.linear, m.factors]

    def gather(x: np.ndarray, by: np.ndarray, k: int) -> np.ndarray:
        return np.stack([np.bincount(by, x[:, j], k) for j in range(x.shape[1])], 1)

    for t in range(1, EPOCHS + 1):
        v = values[2][where]
        s = gather(v, of, n)
        margin = values[0][0] + np.bincount(of, values[1][where], n) + 0.5 * ((s * s).sum(1) - np.bincount(of, (v * v).sum(1), n))
        g = (logistic(margin) - y) / n
        slopes = [
            np.array([g.sum()]),
            np.bincount(where, g[of], len(terms)) + DECAY * values[1] / 10,
            gather(g[of, None] * (s[of] - v), where, len(terms)) + DECAY * values[2],
        ]
        for value, slope, a, b in zip(values, slopes, state, square, strict=True):
            a += 0.1 * (slope - a)
            b += 0.001 * (slope * slope - b)
            value -= STEP * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-9)
    return Machine(terms, float(values[0][0]), values[1], values[2])


def sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of a bounded sample of the labelled documents that aren't held out."""
    rows = training_sample(docs, labels, label, limit, SAMPLE_CHARS)

    def featured(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for b in rows:
            found = [features(t, known).tobytes() for t in texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.binary()), b.column("_label")], names=["doc_id", "x", "y"])

    found = rows.mapInArrow(featured, "doc_id long, x binary, y int").toArrow().sort_by([("doc_id", "ascending"), ("x", "ascending")])
    return [np.frombuffer(x, np.int32) for x in found["x"].to_pylist()], found["y"].to_numpy().astype(np.int64)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = SAMPLE) -> Machine:
    """Fit on ``docs(doc_id, text)`` and ``labels(doc_id, <label>)``; see ``sample`` for the bound."""
    return fit(*sample(docs, labels, label, limit))


class Scorer:
    """Scores of whole texts by a machine; words are looked up once."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.place = {int(t): i for i, t in enumerate(machine.terms)}
        self.useful = {t & ~1 for t in self.place}
        self.known: dict[str, tuple[int, ...]] = {}

    def row(self, text: str) -> np.ndarray:
        once: set[int] = set()
        twice: set[int] = set()
        for w in WORDS.findall(text.lower()):
            got = self.known.get(w)
            if got is None:
                got = tuple(t for t in terms_of(w) if t in self.useful)
                if len(self.known) < CACHED_WORDS:
                    self.known[w] = got
            for t in got:
                if t in once:
                    twice.add(t + 1)
                else:
                    once.add(t)
        return np.array(sorted(self.place[t] for t in once | twice if t in self.place), np.int64)

    def scores(self, found: list[str]) -> np.ndarray:
        return logistic(self.machine.margin([self.row(t) for t in found]))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``docs(doc_id, text, ...)`` to (doc_id, score) of every row, whole texts, no shuffle.

    Null texts are empty and score the bias; null ids, repeated rows and other columns are kept apart; an empty
    table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def scored(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for b in rows:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scorer.scores(texts(b.column("text"))), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).mapInArrow(scored, "doc_id long, score double")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that a machine learned from ``labels`` scores below the threshold. Null texts
    are empty; null ids and repeated rows are judged like others; an empty table gives no rows."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def clean(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for b in rows:
            yield b.filter(pa.array(scorer.scores(texts(b.column("text"))) < threshold))

    return docs.mapInArrow(clean, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, with a machine learned from ``labels``. Of an id's labels
    the greatest counts."""
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
