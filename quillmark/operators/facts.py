"""Facts: comparison groups, series, trends, conflicts, scopes and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.facts import equal_numbers
from quillmark.operators.graph import components

GROUP = ["subject", "property", "conditions", "unit"]


def comparison_groups(facts: DataFrame) -> DataFrame:
    return facts.groupBy(*GROUP).agg(F.count("*").alias("facts"), F.countDistinct("doc_id").alias("docs"), F.countDistinct("axis").alias("axes"))


def series(facts: DataFrame) -> DataFrame:
    """Facts of groups with two axis values or more, with the place of theirs and the number of places."""
    w = Window.partitionBy(*GROUP)
    rows = facts.withColumn("series_index", F.dense_rank().over(w.orderBy("axis")).cast("long") - 1)
    return rows.withColumn("series_len", F.max("series_index").over(w) + 1).where("series_len >= 2")


def trends(facts: DataFrame) -> DataFrame:
    """up, down, flat or mixed by the differences between consecutive axis values; mixed if one has several values."""
    points = facts.groupBy(*GROUP, "axis").agg(F.countDistinct("value_num").alias("values"), F.min("value_num").alias("value"))
    w = Window.partitionBy(*GROUP).orderBy("axis")
    steps = points.withColumn("step", F.col("value") - F.lag("value").over(w))
    out = steps.groupBy(*GROUP).agg(
        F.count("*").alias("axes"), F.max("values").alias("most"), F.min("step").alias("low"), F.max("step").alias("high"), F.min_by("value", "axis").alias("first_value"), F.max_by("value", "axis").alias("last_value")
    )
    trend = F.when(F.col("most") > 1, "mixed").when(F.col("low") > 0, "up").when(F.col("high") < 0, "down").when((F.col("low") > -1e-9) & (F.col("high") < 1e-9), "flat").otherwise("mixed")
    return out.where("axes >= 2").select(*GROUP, "axes", "first_value", "last_value", trend.alias("trend"))


def conflicts(facts: DataFrame) -> DataFrame:
    """(fact_id, conflict_group): components of facts of one group and axis that differ between documents.

    Facts with equal document and value are alike. No pairs are formed: a fact that differs from any of another document
    also differs from the least or the greatest value there is, or, where that is in its own document, from the least or
    greatest value outside it. So each fact meets four others, those two and the least and greatest of all documents but
    theirs, and the links that come of it have the components of all links."""
    keys = [*GROUP, "axis"]
    nodes = facts.groupBy(*keys, "doc_id", "value_num").agg(F.min("fact_id").alias("node"))
    ends = nodes.groupBy(*keys, "doc_id").agg(F.min(F.struct("value_num", "node")).alias("low"), F.max(F.struct("value_num", "node")).alias("high"))
    w = Window.partitionBy(*keys)
    ends = ends.withColumn("_low", F.row_number().over(w.orderBy("low"))).withColumn("_high", F.row_number().over(w.orderBy(F.desc("high"))))
    of = lambda name: ends.where(F.col(f"_{name}") <= 2).select(*keys, F.col("doc_id").alias("d2"), F.col(f"{name}.value_num").alias("v2"), F.col(f"{name}.node").alias("v"))
    witnesses = of("low").unionByName(of("high"))
    rows = nodes.join(witnesses, keys).where((F.col("doc_id") != F.col("d2")) & ~equal_numbers(F.col("value_num"), F.col("v2")))
    found = components(rows.select(F.col("node").alias("u"), "v"))
    members = found.unionByName(found.select(F.col("v").alias("u"), "v").distinct()).select(F.col("u").alias("node"), F.col("v").alias("conflict_group"))
    rows = facts.join(nodes, [*keys, "doc_id", "value_num"]).join(members, "node")
    return rows.select("fact_id", "conflict_group")


def overlapping(states: DataFrame, key: str, by: list[str], start: str, end: str, width: int) -> DataFrame:
    """(by, a, b) of states that share a day, a < b. Each is in the stretches of ``width`` days that it touches, and a
    pair is taken in the stretch in which it begins, so states meet only near in time."""
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01"))
    stretch = lambda c: F.floor(day(c) / width).cast("int")
    rows = states.where(F.col(start) <= F.col(end)).withColumn("_s", F.explode(F.sequence(stretch(start), stretch(end))))
    a = rows.select(*by, "_s", F.col(key).alias("a"), F.col(start).alias("af"), F.col(end).alias("au"))
    b = rows.select(*by, "_s", F.col(key).alias("b"), F.col(start).alias("bf"), F.col(end).alias("bu"))
    both = a.join(b, [*by, "_s"]).where("a < b and af <= bu and bf <= au")
    return both.where(F.col("_s") == F.floor(F.greatest(day("af"), day("bf")) / width)).select(*by, "a", "b")


def distinct_facts(facts: DataFrame) -> DataFrame:
    """Facts of equal content collapse: the first id, how many, and the documents in order."""
    keys = [*GROUP, "axis", "value_num"]
    return facts.groupBy(*keys).agg(F.min("fact_id").alias("fact_id"), F.count("*").alias("mentions"), F.array_join(F.transform(F.array_sort(F.collect_set("doc_id")), lambda x: x.cast("string")), ",").alias("docs"))


def melt(table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A table as facts: (subject, property, value) for each key and column that has a value."""
    rows = table.select(F.col(key).cast("string").alias("subject"), *(F.col(c).cast("string").alias(c) for c in columns))
    return rows.unpivot(["subject"], columns, "property", "value").where("value is not null")


def key_columns(table: DataFrame, columns: list[str], least: float = 0.9) -> DataFrame:
    """Share of distinct values of each column, and whether it may be a key: most values differ, and they are not
    a mere running number."""
    parts = [table.agg(F.count(c).alias("n"), F.countDistinct(c).alias("k"), (F.max(F.col(c).try_cast("bigint")) - F.min(F.col(c).try_cast("bigint")) + 1).alias("span")).select(F.lit(c).alias("name"), "n", "k", "span") for c in columns]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    running = F.coalesce(F.col("span") == F.col("n"), F.lit(False))
    return rows.select("name", F.round(F.col("k") / F.col("n"), 4).alias("uniqueness"), ((F.col("k") / F.col("n") >= least) & ~running).alias("is_key"))
