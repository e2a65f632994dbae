"""Fusion, gates, scores, quotas and selection over ranked candidates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import text as T


def fuse(ranked: DataFrame, k: int = 60, by: str = "question_id") -> DataFrame:
    """Reciprocal rank fusion of (question_id, channel, point_id, rank); a point's best rank in a channel counts."""
    best = ranked.groupBy(by, "channel", "point_id").agg(F.min("rank").alias("rank"))
    rows = best.groupBy(by, "point_id").agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("_r"), F.sort_array(F.collect_list("channel")).alias("sources"))
    return rows.withColumn("rrf", F.round("_r", 9)).drop("_r")


def interleaved(rows: DataFrame, by: str, group: str, rank: str, point: str) -> DataFrame:
    """Round-robin over groups: first occurrences by (rank, group), numbered from 1."""
    once = rows.withColumn("_k", F.row_number().over(Window.partitionBy(by, point).orderBy(rank, group))).where("_k = 1").drop("_k")
    fresh = once.withColumn("_turn", F.row_number().over(Window.partitionBy(by, group).orderBy(rank)))
    return fresh.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy("_turn", group)).cast("long")).drop("_turn")


def admit(rows: DataFrame, limit: int, floor: int = 2) -> DataFrame:
    """Admission to reranking: the first ``floor`` of each group, then the rest by rrf, ``limit`` of a question."""
    rows = rows.withColumn("_g", F.row_number().over(Window.partitionBy("question_id", "kb_id").orderBy(F.desc("rrf"), "point_id")))
    first = F.when(F.col("_g") <= floor, 0).otherwise(1)
    order = Window.partitionBy("question_id").orderBy(first, F.desc("rrf"), "point_id")
    return rows.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= limit).drop("_g")


def margin_weight(score: Column, threshold: float) -> Column:
    """A soft shoulder above a gate, from 0 at the threshold to 1 half way to 1."""
    if not 0 < threshold < 1:
        return F.lit(1.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * (score - threshold) / (1 - threshold)))


def gate(rows: DataFrame, threshold: float = 0.1, lowered: float = 0.7) -> DataFrame:
    """accepted at the threshold; if a question has none, at 0.7 of it (floor_lowered); below it diagnostic."""
    best = F.max("score").over(Window.partitionBy("question_id"))
    floor = F.when(best >= threshold, threshold).when(best >= threshold * lowered, threshold * lowered)
    status = F.when(F.col("score") >= floor, F.when(best >= threshold, "accepted").otherwise("floor_lowered")).otherwise("diagnostic")
    return rows.withColumn("status", status)


def boilerplate(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike(r"copyright|licen[sc]ed? under|all rights reserved|table of contents"), F.lit(False))


def final_score(rerank: Column, cover: Column, is_boilerplate: Column) -> Column:
    return F.round((0.8 * rerank + 0.2 * cover) * F.when(is_boilerplate, 0.5).otherwise(1.0), 4)


def route(evidence: DataFrame, gap: float = 0.2, most: int = 2, floor: float = 0.45, lexical: float = 0.3) -> DataFrame:
    """Libraries within ``gap`` of the best after each quantity is divided by its maximum; weak if the best vector
    evidence is under the floor."""
    w = Window.partitionBy("question_id")
    share = lambda c: F.coalesce(F.col(c) / F.nullif(F.max(c).over(w), F.lit(0.0)), F.lit(0.0))
    rows = evidence.withColumn("routed", F.round((1 - lexical) * share("vector") + lexical * share("lexical"), 6)).withColumn("weak", F.max("vector").over(w) < floor)
    rows = rows.withColumn("_top", F.max("routed").over(w)).where(F.col("routed") >= F.col("_top") - gap).drop("_top")
    rows = rows.withColumn("place", F.row_number().over(w.orderBy(F.desc("routed"), "kb_id")).cast("long"))
    return rows.where(F.col("place") <= most)


def quota(rows: DataFrame, bucket: str, k: int, least: int = 2) -> DataFrame:
    """The first ``least`` rows of every bucket, then the best of the others, k of a question."""
    rows = rows.withColumn("_b", F.row_number().over(Window.partitionBy("question_id", bucket).orderBy(F.desc("score"), "point_id")))
    order = Window.partitionBy("question_id").orderBy(F.when(F.col("_b") <= least, 0).otherwise(1), F.desc("score"), "point_id")
    return rows.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k).drop("_b")


def widened(rows: DataFrame, routes: DataFrame, threshold: float) -> DataFrame:
    """Accepted rows in the libraries that a question was routed to; where these hold none, those of all libraries,
    marked. ``routes`` has question_id and kb_id."""
    marked = rows.where(F.col("score") >= threshold).join(routes.select("question_id", "kb_id", F.lit(True).alias("_in")).distinct(), ["question_id", "kb_id"], "left")
    marked = marked.withColumn("_any", F.count("_in").over(Window.partitionBy("question_id")) > 0)
    return marked.where("not _any or _in").withColumn("widened", ~F.col("_any")).drop("_in", "_any")


def numbered_sources(rows: DataFrame) -> DataFrame:
    """Rows of a question (place, doc_id) with the number of their source: documents count from 1 in the order in which
    they first appear."""
    first = rows.groupBy("question_id", "doc_id").agg(F.min("place").alias("_first"))
    numbers = first.withColumn("source_no", F.row_number().over(Window.partitionBy("question_id").orderBy("_first", "doc_id")).cast("long"))
    return rows.join(numbers.drop("_first"), ["question_id", "doc_id"])


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def mmr(rows: DataFrame, k: int, balance: float = 0.7) -> DataFrame:
    """Maximal marginal relevance over a question's admitted pool (64 rows by contract): each time the row with the
    highest balance * score - (1 - balance) * largest token Jaccard to a chosen row; ties by point."""

    def select(pool: pd.DataFrame) -> pd.DataFrame:
        left = [(r.point_id, float(r.score), frozenset(r.tokens)) for r in pool.sort_values("point_id").itertuples()]
        chosen: list[tuple] = []
        while left and len(chosen) < k:
            def worth(x):
                near = max((len(x[2] & c[2]) / len(x[2] | c[2]) if x[2] | c[2] else 0.0 for c in chosen), default=0.0)
                return balance * x[1] - (1 - balance) * near

            best = max(left, key=worth)
            chosen.append(best)
            left.remove(best)
        return pd.DataFrame({"question_id": pool["question_id"].iloc[0], "point_id": [c[0] for c in chosen], "place": range(1, len(chosen) + 1)})

    pool = rows.select("question_id", "point_id", "score", T.content_tokens("text").alias("tokens"))
    return pool.groupBy("question_id").applyInPandas(select, "question_id long, point_id string, place long")


def overlap_pairs(rows: DataFrame, threshold: float = 0.85, adjacency: int = 2) -> DataFrame:
    """Near chunks of one document whose trigrams overlap: shared / smaller set. The band is spelled out as keys. Texts
    meet, not their trigrams, and a trigram is one number of its three code points."""
    rows = rows.select("doc_id", "chunk_index", "text")
    after = rows.select("doc_id", F.col("chunk_index").alias("earlier"), F.col("text").alias("_before"), F.explode(F.sequence(F.lit(1), F.lit(adjacency))).alias("step"))
    met = rows.join(after.select("doc_id", "earlier", "_before", (F.col("earlier") + F.col("step")).alias("chunk_index")), ["doc_id", "chunk_index"])

    def grams(text: str) -> np.ndarray:
        x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
        x = x if len(x) >= 3 else np.concatenate([x, np.zeros(3 - len(x), np.int64)])  # a shorter text is its own gram
        return np.unique(x[:-2] << 42 | x[1:-1] << 21 | x[2:])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = lru_cache(16)(grams)  # a text's pairs come one after another
        for b in batches:
            shared, least = [], []
            for one, two in zip(b.column("_before"), b.column("text"), strict=True):
                x, y = recent(one.as_py()), recent(two.as_py())
                shared.append(len(np.intersect1d(x, y, assume_unique=True)))
                least.append(min(len(x), len(y)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("earlier"), b.column("later"), pa.array(shared, pa.int64()), pa.array(least, pa.int64())], names=["doc_id", "earlier", "later", "shared", "least"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = met.where("text is not null and _before is not null").select("doc_id", "earlier", F.col("chunk_index").alias("later"), "_before", "text").mapInArrow(compare, f"doc_id {kind}, earlier long, later long, shared long, least long")
    return counts.withColumn("overlap", F.round(F.col("shared") / F.col("least"), 6)).where(F.col("overlap") >= threshold).select("doc_id", "earlier", "later", "overlap")


def budgeted(rows: DataFrame, budget: int, tokens: str = "tokens") -> DataFrame:
    """Rows of a question in order of place while they fit: one that does not is skipped and later ones may. A question's
    rows are a short list, the picks of a quota."""
    listed = F.array_sort(F.collect_list(F.struct(F.col("place").alias("_place"), F.col(tokens).cast("long").alias("_cost"), F.struct(*rows.columns).alias("_row"))))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<boolean>").alias("taken"))
    fits = lambda s, x: x["_cost"] <= s["left"]
    step = lambda s, x: F.struct(F.when(fits(s, x), s["left"] - x["_cost"]).otherwise(s["left"]).alias("left"), F.concat(s["taken"], F.array(fits(s, x))).alias("taken"))
    own = rows.groupBy("question_id").agg(listed.alias("_l")).select("_l", F.aggregate("_l", start, step)["taken"].alias("_t"))
    return own.select(F.explode(F.arrays_zip("_l", "_t")).alias("_z")).where("_z._t").select("_z._l._row.*")


def window_scores(rows: DataFrame, size: int, overlap: int) -> DataFrame:
    """Sentence windows of about ``size`` tokens with an overlap, for scorers that read short passages."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for point, parts in zip(f["point_id"], f["sentences"], strict=True):
                held, used, n = [], 0, 0
                for s in parts:
                    cost = max(1, len(s) // 4)
                    if held and used + cost > size:
                        out.append((point, n, " ".join(held)))
                        n += 1
                        while held and used > overlap:
                            used -= max(1, len(held.pop(0)) // 4)
                    held.append(s)
                    used += cost
                if held:
                    out.append((point, n, " ".join(held)))
            yield pd.DataFrame(out, columns=["point_id", "window", "text"])

    return rows.select("point_id", T.sentences("text").alias("sentences")).mapInPandas(cut, "point_id string, window long, text string")
