"""Graph operators on entity and relation tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows that may be broadcast by a counted join, and the bytes they may take (rows times the stated width).
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share, spark.checkpoint.dir. Only a local session may do without it."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(where or f'file://{tempfile.gettempdir()}/quillmark-scratch').rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage by a written table; survives the loss of executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_join(big: DataFrame, small: DataFrame, on: list[str], how: str, width: int) -> DataFrame:
    """Join on equal keys. ``small`` is counted and broadcast only if its rows times ``width`` bytes are within the
    bound; otherwise the join shuffles and skewed keys are split at run time."""
    n = small.count()
    return big.join(F.broadcast(small) if n <= BROADCAST_ROWS and n * width <= BROADCAST_BYTES else small, on, how)


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more, to give their disk back."""
    for t in tables:
        context = t.sparkSession.sparkContext
        for f in {os.path.dirname(x) for x in t.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


class Forest:
    """Union-find over the dense numbers 0..n-1; the smaller root wins."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        return True


def _stars(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of each batch by a star to the smallest member of each of its components."""
    for b in rows:
        u, v = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(u):
            continue
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        f = Forest(len(ids))
        for x, y in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
            f.join(x, y)
        roots = np.fromiter((f.root(x) for x in range(len(ids))), np.int64, len(ids))
        keep = np.flatnonzero(roots != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(x, b.schema.field(0).type) for x in (ids[keep], ids[roots[keep]])], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(u, v) with v the smallest node reachable from u, for nodes that are not the smallest themselves. Large-star
    and small-star steps alternate until all edges point to the smallest; each step is a written table, and each
    batch of edges is thinned to stars before it is shuffled. Loops, repeated edges and null ends don't count."""
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e = settle(e, "edges")
    kind = e.schema["u"].dataType.simpleString()
    while True:
        stars = e.groupBy("u").agg(F.count("*").alias("n"), F.lit(0).alias("k")).unionByName(e.groupBy("v").agg(F.lit(0).alias("n"), F.lit(1).alias("k")).withColumnRenamed("v", "u"))
        if stars.groupBy("u").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).where("n > 1 or (n > 0 and k > 0)").isEmpty():
            return e
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = settle(small.unionByName(low.select("u", F.col("m").alias("v"))).mapInArrow(_stars, f"u {kind}, v {kind}").distinct(), "edges")
        discard(e)
        e = nxt


def symmetric(edges: DataFrame, *keep: str) -> DataFrame:
    """Both directions of (source, target, ...), without loops."""
    forth = edges.select("source", "target", *keep).where("source <> target")
    return forth.unionByName(forth.select(F.col("target").alias("source"), F.col("source").alias("target"), *keep))


def degrees(edges: DataFrame) -> DataFrame:
    return symmetric(edges).groupBy(F.col("source").alias("key")).agg(F.countDistinct("target").alias("degree"))


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 60, damping: float = 0.85, every: int = 10) -> DataFrame:
    """(key, rank) of the undirected weighted graph; loops and weights of 0 or less go, dangling mass is shared out and
    ranks are normalised in each step. Lineage is cut every few steps by a written table."""
    links = symmetric(edges.where("weight > 0"), "weight").groupBy("source", "target").agg(F.sum("weight").alias("weight"))
    out = links.groupBy("source").agg(F.sum("weight").alias("total"))
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = settle(links.join(out, "source").select("source", "target", (F.col("weight") / F.col("total")).alias("share")), "shares")
    nodes = settle(nodes.select("key").join(out.select(F.col("source").alias("key"), F.lit(True).alias("linked")), "key", "left"), "nodes")
    # Dealt by key once and kept, so that a step shuffles no edges, only what the edges carry, added up before.
    links, nodes = links.repartition(parts, "source").persist(), nodes.repartition(parts, "key").persist()
    n = nodes.count()
    if not n:
        return nodes.select("key", F.lit(0.0).alias("rank"))
    # Nodes without links all have one rank, which no edge changes, so their mass is a number.
    alone, rank = nodes.where("linked is null").count(), 1.0 / n
    ranks = nodes.select("key", F.lit(1.0 / n).alias("rank"))
    for i in range(iterations):
        pushed = links.join(ranks.select(F.col("key").alias("source"), "rank"), "source").groupBy(F.col("target").alias("key")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        rank = (1 - damping) / n + damping * alone * rank / n
        ranks = nodes.join(pushed, "key", "left").select("key", (F.lit(rank) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if i % every == every - 1 or i == iterations - 1:
            ranks = settle(ranks, "ranks")
    total = ranks.agg(F.sum("rank").alias("total"))
    return ranks.crossJoin(F.broadcast(total)).select("key", (F.col("rank") / F.col("total")).alias("rank"))


def npmi(edges: DataFrame, mentions: DataFrame, n_units: Column) -> DataFrame:
    """(source, target, cooccur, npmi) from (key, unit) mentions: 1 if both are in every unit, 0 without a shared one.
    Only the pairs of the edges are counted."""
    own = mentions.distinct()
    p = own.groupBy("key").agg(F.count("*").alias("p"))
    pairs = edges.select("source", "target").distinct()
    with_units = pairs.join(own.select(F.col("key").alias("source"), "unit"), "source").join(own.select(F.col("key").alias("target"), F.col("unit")), ["target", "unit"])
    both = with_units.groupBy("source", "target").agg(F.count("*").alias("cooccur"))
    rows = pairs.join(both, ["source", "target"], "left").join(p.select(F.col("key").alias("source"), F.col("p").alias("ps")), "source").join(p.select(F.col("key").alias("target"), F.col("p").alias("pt")), "target")
    rows = rows.fillna(0, ["cooccur"]).withColumn("_n", n_units)
    joint = F.col("cooccur") / F.col("_n")
    value = F.when(F.col("cooccur") == 0, 0.0).when(joint >= 1, 1.0).otherwise(F.log(joint * F.col("_n") * F.col("_n") / (F.col("ps") * F.col("pt"))) / -F.log(joint))
    return rows.select("source", "target", "cooccur", F.round(value, 6).alias("npmi"))


def edge_weight(strength: Column, most_strength: Column, cooccur: Column, most_cooccur: Column, npmi: Column) -> Column:
    share = 0.5 * strength / most_strength + 0.3 * cooccur / most_cooccur + 0.2 * (npmi + 1) / 2
    return F.round(1 + 9 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)), 4)


def one_hop(edges: DataFrame, seeds: DataFrame, limit: int = 100) -> DataFrame:
    """The strongest neighbours of each seed key, in either direction, numbered by weight and key."""
    rows = small_join(symmetric(edges, "weight"), seeds.select(F.col("key").alias("source")), ["source"], "inner", 64)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("weight"), "target")).cast("long")).where(F.col("place") <= limit)


def expand(edges: DataFrame, seeds: DataFrame, hops: int, per_node: int) -> DataFrame:
    """(key, hop, score): seeds at hop 0; each hop keeps the strongest neighbours of a node and the best score of a
    node first reached: score / (2 + hop) * (0.5 + 0.5 / place), less for hubs."""
    degree = degrees(edges)
    found = seeds.select("key", F.lit(0).alias("hop"), "score")
    frontier = found
    for hop in range(hops):
        near = one_hop(edges, frontier, per_node).join(frontier.select(F.col("key").alias("source"), F.col("score").alias("base")), "source")
        near = near.join(degree.withColumnRenamed("key", "target"), "target")
        penalty = 1 / (1 + F.log1p(F.greatest(F.lit(0), F.col("degree") - 20)))
        scored = near.select(F.col("target").alias("key"), (F.col("base") / (2 + hop) * (0.5 + 0.5 / F.col("place")) * penalty).alias("score"))
        frontier = scored.groupBy("key").agg(F.max("score").alias("score")).join(found.select("key"), "key", "left_anti").select("key", F.lit(hop + 1).alias("hop"), "score")
        found = found.unionByName(frontier)
    return found


def closure(parents: DataFrame, depth: int) -> DataFrame:
    """(name, ancestor, distance) of an is-a table (name, parent) by walking it up to ``depth`` steps."""
    step = parents.select("name", F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    found = step
    for k in range(2, depth + 1):
        up = parents.select(F.col("name").alias("ancestor"), F.col("parent").alias("next"))
        step = step.join(up, "ancestor").select("name", F.col("next").alias("ancestor"), F.lit(k).alias("distance"))
        found = found.unionByName(step)
    return found.groupBy("name", "ancestor").agg(F.min("distance").alias("distance"))


def chunk_scores(entity: DataFrame, evidence: DataFrame, hubs: DataFrame) -> DataFrame:
    """(point_id, score): the five strongest evidence weights plus half the three strongest entity weights, less for
    chunks that many edges point to. Inputs (point_id, weight) and hubs (point_id, hub, mean_hub)."""

    def strongest(rows: DataFrame, k: int, name: str) -> DataFrame:
        w = Window.partitionBy("point_id").orderBy(F.desc("weight"))
        return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).groupBy("point_id").agg(F.sum("weight").alias(name))

    both = strongest(evidence, 5, "e").join(strongest(entity, 3, "n"), "point_id", "full").join(hubs, "point_id")
    score = F.coalesce("e", F.lit(0.0)) + 0.5 * F.coalesce("n", F.lit(0.0)) / (1 + F.log1p(F.col("hub") / F.col("mean_hub")))
    return both.select("point_id", F.round(score, 6).alias("score"))


def compare(before: DataFrame, after: DataFrame, keys: list[str], content: Column) -> DataFrame:
    """(keys, change): added, removed or changed rows of two versions by the hash of their content."""
    a = before.select(*keys, content.alias("_a"))
    b = after.select(*keys, content.alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, keys, "full").withColumn("change", change).where("change is not null").select(*keys, "change")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ends = nodes.select("key")
    whole = edges.join(ends.withColumnRenamed("key", "source"), "source", "left_semi").join(ends.withColumnRenamed("key", "target"), "target", "left_semi")
    return edges.join(whole.select("source", "target").distinct(), ["source", "target"], "left_anti")


def majority(votes: DataFrame, by: str, value: str) -> DataFrame:
    """The value with the most votes, ties to the greater name."""
    counted = votes.groupBy(by, value).agg(F.count("*").alias("n"))
    return counted.groupBy(by).agg(F.max(F.struct("n", value)).alias("top")).select(by, F.col(f"top.{value}").alias(value), F.col("top.n").alias("votes"))


def sliding_pairs(entities: DataFrame, by: list[str], window: int) -> DataFrame:
    """Pairs of entities at most ``window`` places apart in the order of their titles within each group. The rows are
    sorted over all tasks by ranges, and a row's place is its place in its range and the rows of the ranges before, so
    a group of any size is no task of its own. The places are the keys of an equi-join, so the pairs grow with the
    entities times the window."""
    order = [*by, "title", "key"]
    parts = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = entities.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = settle(ranged.withColumn("_id", F.monotonically_increasing_id()), "ranges").withColumn("_range", F.shiftright("_id", 33)).withColumn("_in", F.col("_id").bitwiseAND((1 << 33) - 1))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_range", before.alias("_before"))  # a row for each range
    ranked = ranged.join(F.broadcast(starts), "_range").withColumn("_at", F.col("_before") + F.col("_in"))
    left = ranked.select(*by, F.col("key").alias("a"), F.col("title").alias("ta"), F.explode(F.sequence(F.col("_at") + 1, F.col("_at") + window)).alias("_at"))
    return left.join(ranked.select(*by, F.col("key").alias("b"), F.col("title").alias("tb"), "_at"), [*by, "_at"]).drop("_at")
