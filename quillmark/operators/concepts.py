"""Concepts of facts: norms, buckets, compatibility and guarded merging of near names."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.operators.resolution import POLARITY

# Fixed words of measures that a concept's name does not need, and words that set measures apart.
MEASURE_WORDS = ("value", "rate", "level", "amount", "number", "reading")
CONTRASTS = ("absolute", "relative", "typical", "average", "peak", "total", "net", "gross", "static", "dynamic")


def norm(prop: Column, symbol: Column) -> Column:
    """The symbol if there is one, qualified by the property when it has two letters or fewer; else the property
    without trailing measure words."""
    p = F.trim(F.regexp_replace(F.lower(prop), r"(\s+(" + "|".join(MEASURE_WORDS) + r"))+$", ""))
    s = F.lower(F.regexp_replace(F.coalesce(symbol, F.lit("")), r"[\s_{}]", ""))
    return F.when(s == "", p).when(F.length(s) <= 2, F.concat_ws(":", s, p)).otherwise(s)


def compatible(a: str, b: str) -> str:
    """ok, or why two names are not one concept: polarity, contrast or measure (different numbers or units)."""
    x, y = set(re.findall(r"\w+", a.lower())), set(re.findall(r"\w+", b.lower()))
    if any((p in x and q in y) or (q in x and p in y) for p, q in POLARITY):
        return "polarity"
    if (x ^ y) & set(CONTRASTS):
        return "contrast"
    if {w for w in x if w.isdigit()} != {w for w in y if w.isdigit()}:
        return "measure"
    return "ok"


def build(names: DataFrame, pairs: DataFrame) -> DataFrame:
    """(name, concept): names (name, unit, n) joined by judged pairs (a, b, similarity), the most similar first. A join
    that would put two units or incompatible names into one concept is skipped; the label is the most frequent name.
    Only the names of one weak component meet."""
    from quillmark.operators.graph import components, settle

    ids = names.select("name", "unit", "n", F.xxhash64("name").alias("id"))
    ends = pairs.select(F.xxhash64("a").alias("u"), F.xxhash64("b").alias("v"))
    loose = components(ends)
    group = settle(loose.unionByName(loose.select(F.col("v").alias("u"), "v").distinct()).select(F.col("u").alias("id"), F.col("v").alias("part")), "concept-groups")
    members = settle(ids.join(group, "id", "left").withColumn("part", F.coalesce("part", "id")).select("part", "name", "unit", "n"), "concept-members")
    inner = settle(pairs.withColumn("id", F.xxhash64("a")).join(group, "id").select("part", "a", "b", "similarity"), "concept-pairs")

    def merge(rows: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        info = {r.name_: (r.unit or "", int(r.n)) for r in rows.rename(columns={"name": "name_"}).itertuples()}
        held = {k: [k] for k in info}
        of = {k: k for k in info}
        for a, b, _ in sorted(zip(links["a"], links["b"], links["similarity"], strict=True), key=lambda x: (-x[2], x[0], x[1])):
            x, y = of.get(a), of.get(b)
            if x is None or y is None or x == y:
                continue
            units = {info[k][0] for k in held[x] + held[y]} - {""}
            if len(units) > 1 or any(compatible(p, q) != "ok" for p in held[x] for q in held[y]):
                continue
            for k in held[y]:
                of[k] = x
            held[x] += held.pop(y)
        label = {x: min(ks, key=lambda k: (-info[k][1], k)) for x, ks in held.items()}
        return pd.DataFrame({"name": list(info), "concept": [label[of[k]] for k in info]})

    return members.groupBy("part").cogroup(inner.groupBy("part")).applyInPandas(merge, "name string, concept string")


# Fixed forms of fiscal and calendar periods in text.
PERIOD = re.compile(r"\b(?:(FY)\s?(\d{4})|(Q[1-4])\s+(?:FY\s?)?(\d{4})|year ended (\d{4})-(\d{2})-(\d{2}))", re.I)


def time_contexts(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, period): the last period declared in the document up to each chunk. A quarter of a fiscal
    year whose end the document has not declared stays unknown."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for doc, parts in zip(f["doc_id"], f["parts"], strict=True):
                period, closes = "", ""
                for p in sorted(parts, key=lambda p: p["chunk_index"]):
                    for m in PERIOD.finditer(p["text"]):
                        if m[5]:
                            closes = f"{m[6]}-{m[7]}"
                            period = f"{m[5]}-{closes}"
                        elif m[1]:
                            period = f"FY{m[2]}" + (f" to {m[2]}-{closes}" if closes else "")
                        else:
                            period = f"{m[3].upper()} {m[4]}" if closes or "FY" not in m[0].upper() else "unknown"
                    out.append((doc, int(p["chunk_index"]), period))
            yield pd.DataFrame(out, columns=["doc_id", "chunk_index", "period"])

    docs = chunks.groupBy("doc_id").agg(F.collect_list(F.struct("chunk_index", "text")).alias("parts"))
    return docs.mapInPandas(run, "doc_id long, chunk_index long, period string")
