"""Small driver-side dimension tables: schemas, their interchange form, and declarative corrections."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.facts import name_key


def normalised(model: dict) -> dict:
    """Types and predicates with trimmed names; unknown parents go, cycles are an error, ends are known types."""
    types = {t["name"].strip(): (t.get("is_a") or "").strip() for t in model.get("types", []) if t.get("name", "").strip()}
    types = {n: p if p in types and p != n else "" for n, p in types.items()}
    for name in types:
        seen, at = set(), name
        while at:
            if at in seen:
                raise ValueError(f"types form a cycle at {name}")
            seen.add(at)
            at = types[at]
    ends = lambda xs: sorted({x for x in xs or () if x in types or x == "*"})
    predicates = [{"name": re.sub(r"\W+", "_", p["name"].strip().lower()).strip("_"), "source": ends(p.get("source")), "target": ends(p.get("target"))} for p in model.get("predicates", []) if p.get("name", "").strip()]
    return {"types": [{"name": n, "is_a": p} for n, p in sorted(types.items())], "predicates": predicates}


def to_linkml(model: dict, name: str, version: str) -> str:
    classes = {t["name"]: {"is_a": t["is_a"]} if t["is_a"] else {} for t in model["types"]}
    slots = {p["name"]: {"domain_of": p["source"], "any_of": [{"range": x} for x in p["target"]]} for p in model["predicates"]}
    return json.dumps({"id": f"urn:{name}", "name": name, "version": version, "classes": classes, "slots": slots}, ensure_ascii=False, sort_keys=True)


def from_linkml(text: str) -> dict:
    doc = json.loads(text)
    types = [{"name": n, "is_a": c.get("is_a", "")} for n, c in doc.get("classes", {}).items()]
    predicates = [{"name": n, "source": s.get("domain_of", []), "target": [x["range"] for x in s.get("any_of", [])]} for n, s in doc.get("slots", {}).items()]
    return normalised({"types": types, "predicates": predicates})


def apply_corrections(entities: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules (action, name, value) by normalised title: reject drops an entity, type and title replace theirs. Rules
    are the caller's small table; the last by name of each action counts."""
    r = rules.withColumn("_k", name_key("name")).groupBy("_k").pivot("action", ["reject", "type", "title"]).agg(F.max(F.coalesce("value", F.lit("yes"))))
    rows = entities.withColumn("_k", name_key("title")).join(F.broadcast(r.select("_k", F.col("reject").alias("_reject"), F.col("type").alias("_type"), F.col("title").alias("_title"))), "_k", "left")
    rows = rows.where("_reject is null").withColumn("type", F.coalesce("_type", "type")).withColumn("title", F.coalesce("_title", "title"))
    return rows.drop("_k", "_reject", "_type", "_title")


def resolved(records: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Governance records with the number of rows their selector finds: valid only with exactly one."""
    n = rows.groupBy(key).agg(F.count("*").alias("_n"))
    return records.join(n, key, "left").withColumn("state", F.when(F.col("_n").isNull(), "missing").when(F.col("_n") == 1, "valid").otherwise("ambiguous")).drop("_n")


def row_status(rows: DataFrame, statuses: DataFrame) -> DataFrame:
    """(key, current): a row is not current only if all of its documents are not. rows(key, doc_id)."""
    joined = rows.join(statuses, "doc_id", "left")
    return joined.groupBy("key").agg((~F.every(F.coalesce("status", F.lit("current")) != "current")).alias("current"))
