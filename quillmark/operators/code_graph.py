"""Deterministic graph of source files: modules, symbols, definitions, imports and their resolution."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _relations(source: str) -> list[tuple[str, str, int]]:
    """(predicate, name, line) of imports, definitions and calls; source that does not parse gives none."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    out = []
    for x in ast.walk(tree):
        if isinstance(x, ast.Import):
            out += [("imports", a.name, x.lineno) for a in x.names]
        elif isinstance(x, ast.ImportFrom) and x.module and not x.level:
            out.append(("imports", x.module, x.lineno))
        elif isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            out.append(("defines", x.name, x.lineno))
        elif isinstance(x, ast.Call):
            f = x.func
            name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""
            out += [("calls", name, x.lineno)] if name else []
    return sorted(set(out), key=lambda r: (r[2], r[0], r[1]))


def relations(files: DataFrame) -> DataFrame:
    """(path, predicate, name, line) of Python files (path, source)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(p, *r) for p, s in zip(f["path"], f["source"], strict=True) for r in _relations(s or "")], columns=["path", "predicate", "name", "line"])

    return files.select("path", "source").mapInPandas(run, "path string, predicate string, name string, line long")


def resolved_imports(found: DataFrame, files: DataFrame) -> DataFrame:
    """(path, name, state, target): internal if exactly one file is the module, ambiguous if several are, else
    external. A module a.b is the file a/b.py or a/b/__init__.py below any root."""
    module = F.regexp_replace(F.regexp_replace("path", r"(/__init__)?\.py$", ""), "/", ".")
    parts = F.split(module, r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    known = files.select(F.col("path").alias("target"), F.explode(tails).alias("name"))
    single = known.groupBy("name").agg(F.count("*").alias("n"), F.min("target").alias("target"))
    rows = found.where("predicate = 'imports'").select("path", "name").distinct().join(single, "name", "left")
    state = F.when(F.col("n").isNull(), "external").when(F.col("n") == 1, "internal").otherwise("ambiguous")
    return rows.select("path", "name", state.alias("state"), F.when(F.col("n") == 1, F.col("target")).alias("target"))


def calls_to_definitions(found: DataFrame) -> DataFrame:
    """(caller, name, callee): calls of names that exactly one file defines."""
    one = found.where("predicate = 'defines'").select("name", F.col("path").alias("callee")).distinct()
    one = one.withColumn("_n", F.count("*").over(Window.partitionBy("name"))).where("_n = 1").drop("_n")
    return found.where("predicate = 'calls'").select(F.col("path").alias("caller"), "name").distinct().join(one, "name").where("caller <> callee")
