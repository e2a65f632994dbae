"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad from bucketed features of itself and of the lines before and after it. The
document's score aggregates the forward-backward marginals, weighted by line lengths, through a fitted logistic. Only
documents have labels: in training every line has its document's, so weights of transitions are learned from pure
documents, and lines of mixed ones from all those that look like them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import held_out, texts, training_sample, whole

#: The most labelled documents, and code points in them, that are gathered to fit the field.
SAMPLE, SAMPLE_CHARS = 6_000, 40_000_000
THRESHOLD = 0.3
EPOCHS, STEP, DECAY = 120, 0.05, 1e-3

#: Bucket edges of each numeric feature of a line.
EDGES = {
    "upper": [0.02, 0.05, 0.1, 0.2, 0.4, 0.7],
    "symbol": [0.002, 0.02, 0.05, 0.1, 0.2, 0.3],
    "shout": [0.002, 0.02, 0.05, 0.1, 0.2],
    "digit": [0.002, 0.02, 0.05, 0.1, 0.3],
    "unique": [0.03, 0.1, 0.2, 0.3, 0.5, 0.65, 0.75, 0.85, 0.95],
    "words": [0.5, 1.5, 2.5, 4.5, 9.5, 19.5, 49.5, 99.5, 199.5],
    "word_length": [2, 3, 4, 5, 6, 8, 10, 15],
    "repeats": [1.5, 2.5, 4.5],
    "closed": [0.5],
    "lines": [1.5, 2.5, 5.5, 10.5, 20.5, 50.5],
}
#: The features whose values in the neighbouring lines count too.
BESIDE = ("upper", "symbol", "unique", "words", "repeats")
CLOSED = re.compile(r"[.!?:;\"')\]]\s*\Z")


def _layout() -> tuple[dict[str, int], int]:
    """First slot of each feature, own ones before the previous and next line's; slots in all."""
    at, n = {}, 1  # slot 0 is the bias
    for name, edges in EDGES.items():
        at[name] = n
        n += len(edges) + 1
    for side in ("before", "after"):
        for name in BESIDE:
            at[f"{side} {name}"] = n
            n += len(EDGES[name]) + 2  # the last: no such line
    return at, n


SLOT, SLOTS = _layout()


def _classes() -> np.ndarray:
    """Class of each code point below 65536: 0 other, 1 upper-case letter, 2 other letter, 3 digit, 4 symbol, 5 ! or ?"""
    out = np.zeros(65536, np.uint8)
    for i in range(65536):
        c = chr(i)
        if c.isalpha():
            out[i] = 1 if c.isupper() else 2
        elif c.isdigit():
            out[i] = 3
        elif c in "!?":
            out[i] = 5
        elif not c.isspace() and c not in ".,;:'\"-()":
            out[i] = 4
    return out


_table: list[np.ndarray] = []


def line_slots(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Active slots (lines x features) and lengths of the lines of a whole text; an empty text is one empty line."""
    if not _table:
        _table.append(_classes())
    lines = text.split("\n")
    n = len(lines)
    length = np.fromiter(map(len, lines), np.int64, n)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _table[0][np.minimum(codes, 65535)]
    ends = np.cumsum(length + 1) - 1
    starts = ends - length
    count = {}
    for k in (1, 2, 3, 4, 5):
        total = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)])
        count[k] = total[ends] - total[starts]
    split = [x.split() for x in lines]
    words = np.fromiter(map(len, split), np.float64, n)
    unique = np.fromiter((len(set(x)) for x in split), np.float64, n)
    seen = Counter(lines)
    size = np.maximum(length, 1)
    values = {
        "upper": count[1] / np.maximum(count[1] + count[2], 1),
        "symbol": count[4] / size,
        "shout": count[5] / size,
        "digit": count[3] / size,
        "unique": unique / np.maximum(words, 1),
        "words": words,
        "word_length": length / np.maximum(words, 1),
        "repeats": np.fromiter((seen[x] if x.strip() else 1 for x in lines), np.float64, n),
        "closed": np.fromiter((CLOSED.search(x, max(0, len(x) - 9)) is not None for x in lines), np.float64, n),
        "lines": np.full(n, float(n)),
    }
    bucket = {k: np.searchsorted(EDGES[k], v, "right") for k, v in values.items()}
    out = [np.zeros(n, np.int64)] + [SLOT[k] + bucket[k] for k in EDGES]
    for side, step in (("before", 1), ("after", -1)):
        for k in BESIDE:
            x = np.roll(bucket[k], step)
            x[0 if step == 1 else -1] = len(EDGES[k]) + 1
            out.append(SLOT[f"{side} {k}"] + x)
    return np.stack(out, 1).astype(np.int16), length


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Chains:
    """Chains of different lengths laid out by time step, longest first, so that a step works on all at once."""

    def __init__(self, lengths: np.ndarray):
        self.n = len(lengths)
        order = np.argsort(-lengths, kind="stable")
        steps = int(lengths.max()) if self.n else 0
        self.active = np.searchsorted(-lengths[order], -np.arange(steps), "left")  # chains longer than t
        first = np.concatenate([[0], np.cumsum(lengths)])[:-1][order]
        self.rows = [first[:k] + t for t, k in enumerate(self.active.tolist())]

    def messages(self, e: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of good by all lines up to and with each line (a), and by all lines after it (b).
        e: log-odds by the line's own features; move[i, j]: weight of label j after label i."""
        a, b = e.copy(), np.zeros_like(e)
        for t in range(1, len(self.rows)):
            x, now = a[self.rows[t - 1][: self.active[t]]], self.rows[t]
            a[now] += np.logaddexp(x + move[1, 1], move[0, 1]) - np.logaddexp(x + move[1, 0], move[0, 0])
        for t in range(len(self.rows) - 2, -1, -1):
            nxt = self.rows[t + 1]
            x = e[nxt] + b[nxt]
            b[self.rows[t][: len(nxt)]] = np.logaddexp(x + move[1, 1], move[1, 0]) - np.logaddexp(x + move[0, 1], move[0, 0])
        return a, b


@dataclass
class Field:
    """weights: log-odds of good for each slot; move: transitions; scale, shift: the final logistic."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(SLOTS))
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    scale: float = 1.0
    shift: float = 0.0

    def goodness(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Length-weighted mean marginal of good of each document."""
        if not docs:
            return np.empty(0)
        lengths = np.array([len(n) for _, n in docs])
        e = self.weights[np.concatenate([s for s, _ in docs])].sum(1)
        a, b = Chains(lengths).messages(e, self.move)
        p, w = logistic(a + b), np.concatenate([n for _, n in docs]) + 1.0
        first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        return np.add.reduceat(p * w, first) / np.add.reduceat(w, first)

    def score(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return logistic(self.scale * _odds(self.goodness(docs)) + self.shift)


def _odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Field:
    """Maximise the conditional likelihood of each document's label on all its lines (each document counts once),
    then fit the final logistic on the documents. Without both classes the score is the smoothed share of label 1."""
    n, ones = len(docs), int(labels.sum())
    if not 0 < ones < n:
        return Field(scale=0.0, shift=float(np.log((ones + 0.5) / (n - ones + 0.5))))
    lengths = np.array([len(x) for _, x in docs])
    slots = np.concatenate([s for s, _ in docs])
    of = np.repeat(np.arange(n), lengths)
    y, share = labels[of].astype(float), 1.0 / lengths[of] / n
    chains = Chains(lengths)
    there = np.concatenate([*chains.rows[1:], np.empty(0, np.int64)]).astype(np.int64)  # lines after another one
    here = there - 1
    model = Field()
    value = np.concatenate([model.weights, model.move.ravel()])
    m, s = np.zeros_like(value), np.zeros_like(value)
    for t in range(1, EPOCHS + 1):
        w, move = value[:SLOTS], value[SLOTS:].reshape(2, 2)
        e = w[slots].sum(1)
        a, b = chains.messages(e, move)
        g = (logistic(a + b) - y) * share
        slope = np.bincount(slots.ravel(), np.repeat(g, slots.shape[1]), SLOTS)
        after = e[there] + b[there]
        z = np.stack([i * a[here] + move[i, j] + j * after for i in (0, 1) for j in (0, 1)], 1)
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        truth = np.stack([(y[here] == i) & (y[there] == j) for i in (0, 1) for j in (0, 1)], 1)
        moves = ((z - truth) * share[here, None]).sum(0)
        slope = np.concatenate([slope, moves]) + DECAY * value
        m += 0.1 * (slope - m)
        s += 0.01 * (slope * slope - s)
        value -= STEP * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
    model.weights, model.move = value[:SLOTS], value[SLOTS:].reshape(2, 2)
    x, scale, shift = _odds(model.goodness(docs)), 1.0, 0.0
    for _ in range(50):  # Newton steps with a little ridge
        p = logistic(scale * x + shift)
        g = np.array([((p - labels) * x).sum() + 0.1 * (scale - 1), (p - labels).sum()])
        q = p * (1 - p)
        h = np.array([[(q * x * x).sum() + 0.1, (q * x).sum()], [(q * x).sum(), q.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        scale, shift = scale - float(np.clip(d[0], -1, 1)), shift - float(np.clip(d[1], -1, 1))
    model.scale, model.shift = max(scale, 0.05), shift
    return model


def sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Line features and labels of a bounded sample of the labelled documents that aren't held out."""
    rows = training_sample(docs, labels, label, limit, SAMPLE_CHARS)

    def featured(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            found = [line_slots(t) for t in texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([s.tobytes() for s, _ in found], pa.binary()), pa.array([n.tobytes() for _, n in found], pa.binary()), b.column("_label")],
                names=["doc_id", "slots", "lengths", "y"],
            )

    got = rows.mapInArrow(featured, "doc_id long, slots binary, lengths binary, y int").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("slots", "ascending"), ("lengths", "ascending")])
    width = 1 + len(EDGES) + 2 * len(BESIDE)
    found = [(np.frombuffer(s, np.int16).reshape(-1, width), np.frombuffer(n, np.int64)) for s, n in zip(got["slots"].to_pylist(), got["lengths"].to_pylist(), strict=True)]
    return found, got["y"].to_numpy().astype(np.int64)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = SAMPLE) -> Field:
    return fit(*sample(docs, labels, label, limit))


def score(docs: DataFrame, model: Field) -> DataFrame:
    """``docs(doc_id, text, ...)`` to (doc_id, score) of every row, whole texts, no shuffle.

    Null texts are empty, one empty line; null ids and repeated rows are kept; other columns are ignored; an empty
    table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            all_texts, s, group, held = texts(b.column("text")), [], [], 0
            for t in all_texts:
                group.append(line_slots(t))
                held += len(group[-1][1])
                if held > 20_000:
                    s.append(sent.value.score(group))
                    group, held = [], 0
            s.append(sent.value.score(group))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(s), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).mapInArrow(scored, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, with a field learned from ``labels``. Of an id's labels
    the greatest counts."""
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
