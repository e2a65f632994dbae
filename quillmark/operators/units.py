"""Extraction units: runs of consecutive chunks, their ids and kinds, and samples of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.chunking import drop_repeat


def numbered_units(chunks: DataFrame, size: int = 3) -> DataFrame:
    """Every ``size`` consecutive chunks of a document as a unit; order-independent."""
    rows = chunks.withColumn("unit", F.floor(F.col("chunk_index") / size))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"])
    return rows.groupBy("doc_id", "unit").agg(F.array_join(parts, "\n\n").alias("text"), F.count("*").alias("chunks"))


def sectioned_units(chunks: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, ord, text, chunk_from, chunk_to): runs of up to ``size`` chunks; a change of section cuts once a unit is
    half full, and chunks that go on from the last drop what they repeat. One document to a group."""
    half = max(1, (size + 1) // 2)

    def build(doc: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        last = None
        for r in doc.sort_values("chunk_index").itertuples():
            held = int(last.chunk_index) - out[-1][3] + 1 if out else 0
            if not out or held >= size or (r.section != first_section and held >= half):
                out.append([r.doc_id, len(out), r.text, int(r.chunk_index), int(r.chunk_index)])
                first_section = r.section
            else:
                out[-1][2] += "\n\n" + drop_repeat(out[-1][2], r.text)
                out[-1][4] = int(r.chunk_index)
            last = r
        return pd.DataFrame(out, columns=["doc_id", "ord", "text", "chunk_from", "chunk_to"])

    return chunks.select("doc_id", "chunk_index", "section", "text").groupBy("doc_id").applyInPandas(build, "doc_id long, ord long, text string, chunk_from long, chunk_to long")


def farthest(pool: DataFrame, by: str, n: int) -> DataFrame:
    """(by, key, place): of each stratum's bounded pool (by, key, vector) the smallest key, then each time the one whose
    nearest chosen vector is farthest by cosine, ties to the smaller key. Null and zero vectors are not chosen."""

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")
        x = np.stack([np.array(v, float) for v in rows["vector"]])
        size = np.linalg.norm(x, axis=1)
        keys, x = rows["key"].to_numpy()[size > 0], x[size > 0] / size[size > 0, None]
        near, chosen = np.full(len(x), -2.0), []
        while len(chosen) < min(n, len(x)):
            at = int(np.argmin(near)) if chosen else 0
            chosen.append(at)
            near = np.maximum(near, np.round(x @ x[at], 6))
            near[chosen] = 2.0
        return pd.DataFrame({by: rows[by].iloc[0], "key": keys[chosen], "place": range(1, len(chosen) + 1)})

    kind = pool.schema[by].dataType.simpleString()
    return pool.where("vector is not null").select(by, "key", "vector").groupBy(by).applyInPandas(choose, f"{by} {kind}, key long, place long")


def unit_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def signals(text: Column) -> dict[str, Column]:
    """Counts and shares of a unit's structure."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    tables = F.filter(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2)
    prose = F.aggregate(F.filter(lines, lambda x: (F.length(x) >= 40) & F.contains(x, F.lit(" "))), F.lit(0), lambda s, x: s + F.length(x))
    total = F.aggregate(lines, F.lit(0), lambda s, x: s + F.length(x))
    return {
        "toc": F.size(F.regexp_extract_all(text, F.lit(r"(\.{4,}\s*\d+)"), 1)),
        "dates": F.size(F.regexp_extract_all(text, F.lit(r"(\d{4}-\d{2}-\d{2})"), 1)),
        "table_ratio": F.coalesce(F.round(F.size(tables) / F.nullif(F.size(lines), F.lit(0)), 3), F.lit(0.0)),
        "prose_ratio": F.round(prose / F.greatest(total, F.lit(1)), 3),
    }


def kind(text: Column) -> Column:
    """boilerplate, listing, conclusion or body by an ordered list of rules."""
    s = signals(text)
    head = F.lower(F.substring(text, 1, 160))
    return (
        F.when(s["toc"] >= 5, "boilerplate")
        .when(head.rlike(r"copyright|licen[sc]ed under|all rights reserved|disclaimer|revision history"), "boilerplate")
        .when((s["dates"] >= 3) & head.rlike("revision"), "boilerplate")
        .when((s["table_ratio"] >= 0.5) & (s["prose_ratio"] < 0.4), "listing")
        .when(head.rlike(r"conclusion|summary|recommendation"), "conclusion")
        .otherwise("body")
    )


def combined_kind(structural: Column, model: Column) -> Column:
    """Boilerplate if either says so, listing only by structure, conclusion by either."""
    both = F.array(F.coalesce(structural, F.lit("body")), F.coalesce(model, F.lit("body")))
    return F.when(F.array_contains(both, "boilerplate"), "boilerplate").when(structural == "listing", "listing").when(F.array_contains(both, "conclusion"), "conclusion").otherwise("body")


def quotas(sizes: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """(key, quota): one for each and the rest by the square root of the size, largest remainders first; no more than
    the size. Sizes below the total's share keep theirs."""
    w = Window.partitionBy()
    n = F.count("*").over(w)
    raw = 1 + F.sqrt(F.greatest(F.col(size), F.lit(1)).cast("double")) * (total - n) / F.sum(F.sqrt(F.greatest(F.col(size), F.lit(1)).cast("double"))).over(w)
    rows = sizes.select(key, size, F.round(raw, 9).alias("_raw"))
    rows = rows.withColumn("_base", F.floor("_raw")).withColumn("_left", total - F.sum("_base").over(w))
    place = F.row_number().over(Window.orderBy(F.desc(F.col("_raw") - F.col("_base")), key))
    return rows.withColumn("quota", F.least(F.col(size), F.col("_base") + (place <= F.col("_left")).cast("long"))).select(key, "quota")


def spread(rows: DataFrame, by: str, order: str, k: int) -> DataFrame:
    """k rows of each key at even spacing: those at i * n // k."""
    at, n = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1, F.count("*").over(Window.partitionBy(by))
    rows = rows.withColumn("_at", at).withColumn("_n", n)
    return rows.where(F.expr(f"_n <= {k} or exists(sequence(0, {k - 1}), i -> (i * _n) div {k} = _at)")).drop("_at", "_n")


def labelled_rows(table: Column) -> Column:
    """Rows of a pipe table as 'column: value' texts."""
    lines = F.filter(F.split(table, "\n"), lambda x: ~x.rlike(r"^[\s|:-]*$"))
    cells = lambda line: F.transform(F.split(F.regexp_replace(line, r"^\s*\||\|\s*$", ""), r"\|"), lambda c: F.trim(c))
    return F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda row: F.array_join(F.zip_with(cells(F.get(lines, F.lit(0))), cells(row), lambda n, c: F.concat_ws(": ", n, c)), "; "))
