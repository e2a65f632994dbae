"""Evidence for readers: covers of a question, stitched hits, excerpts and derived pages."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators.chunking import approx_tokens, sentences
from quillmark.operators.recall import neighbours


def cover(rows: DataFrame, limit: int) -> DataFrame:
    """Greedy cover of a question's tokens by a bounded pool of its rows: each time the row with the most tokens not
    yet covered, ties to the higher score and then the smaller point; the rest follow by score.
    rows(question_id, question, point_id, score, text)."""

    def choose(pool: pd.DataFrame) -> pd.DataFrame:
        need = set(pool["needles"].iloc[0])
        left = [(r.point_id, float(r.score), set(r.tokens)) for r in pool.sort_values("point_id").itertuples()]
        chosen: list[str] = []
        while left and need and len(chosen) < limit:
            best = max(left, key=lambda x: (len(x[2] & need), x[1]))
            if not best[2] & need:
                break
            chosen.append(best[0])
            left.remove(best)
            need -= best[2]
        order = (chosen + [x[0] for x in sorted(left, key=lambda x: -x[1])])[: max(limit, len(chosen))]
        return pd.DataFrame({"question_id": pool["question_id"].iloc[0], "point_id": order, "place": range(1, len(order) + 1)})

    pool = rows.select("question_id", "point_id", "score", T.content_tokens("question").alias("needles"), T.content_tokens("text").alias("tokens"))
    return pool.groupBy("question_id").applyInPandas(choose, "question_id long, point_id string, place long")


def stitched(hits: DataFrame, chunks: DataFrame, least: int = 350, most: int = 850, span: int = 3) -> DataFrame:
    """(doc_id, hit, first, last, text): hits shorter than ``least`` characters grow by neighbours, the next before the
    previous at each distance, while they stay short and the whole stays within ``most``; growth on a side ends at the
    first that does not fit."""
    near = neighbours(hits, chunks.select("doc_id", "chunk_index", "text"), span)
    own = hits.select("doc_id", F.col("chunk_index").alias("hit"), "chunk_index").join(chunks.select("doc_id", "chunk_index", "text"), ["doc_id", "chunk_index"])
    rows = own.unionByName(near.select("doc_id", "hit", "chunk_index", "text"))

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        hit = int(group["hit"].iloc[0])
        texts = dict(zip(group["chunk_index"].astype(int), group["text"], strict=True))
        first = last = hit
        total, open_sides = len(texts[hit]), {1, -1}
        while total < least and open_sides:
            for side in (1, -1):
                if side not in open_sides or total >= least:
                    continue
                at = last + 1 if side == 1 else first - 1
                if at not in texts or total + 1 + len(texts[at]) > most:
                    open_sides.discard(side)
                    continue
                total += 1 + len(texts[at])
                first, last = min(first, at), max(last, at)
        return pd.DataFrame({"doc_id": [group["doc_id"].iloc[0]], "hit": [hit], "first": [first], "last": [last], "text": ["\n".join(texts[i] for i in range(first, last + 1))]})

    return rows.groupBy("doc_id", "hit").applyInPandas(grow, "doc_id long, hit long, first long, last long, text string")


def excerpt(text: str, question: set[str], most: int) -> str:
    """One run of sentences within the budget that covers most of the question's tokens; the earliest wins."""
    parts = sentences(text)
    held = [set(re.findall(r"\w+", p.lower())) & question for p in parts]
    cost = [approx_tokens(p) for p in parts]
    best, found = -1, ""
    for i in range(len(parts)):
        used, seen, j = 0, set(), i
        while j < len(parts) and used + cost[j] <= most:
            used, seen, j = used + cost[j], seen | held[j], j + 1
        if j > i and len(seen) > best:
            best, found = len(seen), " ".join(parts[i:j])
    return found or text[: most * 4]


def subject_pages(facts: DataFrame, most: int = 80, least: int = 3) -> DataFrame:
    """(subject, page): a page of ordered fact lines for the subjects with most facts, three or more each. The score
    of a subject is three for a fact and two for a document."""
    scored = facts.groupBy("subject").agg(F.count("*").alias("n"), (3 * F.count("*") + 2 * F.countDistinct("doc_id")).alias("score")).where(F.col("n") >= least)
    chosen = scored.orderBy(F.desc("score"), "subject").limit(most)
    line = F.concat(F.lit("- "), "axis", F.lit(" "), "property", F.lit(": "), F.format_number("value_num", 2), F.lit(" "), "unit")
    rows = facts.join(F.broadcast(chosen.select("subject", "score")), "subject").select("subject", "score", "axis", line.alias("line")).distinct()
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("axis", "line"))), lambda x: x["line"])
    return rows.groupBy("subject", "score").agg(F.array_join(ordered, "\n").alias("lines")).select("subject", "score", F.concat(F.lit("# "), "subject", F.lit("\n"), "lines").alias("page"))


def readback(locators: DataFrame, chunks: DataFrame, most: int = 24, budget: int = 2400) -> DataFrame:
    """Chunks at up to ``most`` locators (question_id, doc_id, chunk_index, weight), rotated across documents, within a
    running token budget in that order."""
    turn = Window.partitionBy("question_id", "doc_id").orderBy(F.desc("weight"), "chunk_index")
    rows = locators.withColumn("_turn", F.row_number().over(turn))
    place = Window.partitionBy("question_id").orderBy("_turn", "doc_id", "chunk_index")
    rows = rows.withColumn("place", F.row_number().over(place).cast("long")).where(F.col("place") <= most).drop("_turn")
    rows = rows.join(chunks.select("doc_id", "chunk_index", "text"), ["doc_id", "chunk_index"]).withColumn("tokens", T.approx_tokens("text"))
    used = F.sum("tokens").over(Window.partitionBy("question_id").orderBy("place"))
    return rows.withColumn("used", used).where(F.col("used") <= budget).select("question_id", "doc_id", "chunk_index", "place", "tokens")
