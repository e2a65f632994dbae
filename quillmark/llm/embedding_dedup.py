"""Near-duplicate embeddings by an exact metric range join.

Unit vectors with a cosine of at least t lie within r = sqrt(2 - 2 t) of each other. Pivots cut the vectors of a label
into cells, each vector at home in the cell of its nearest pivot. A vector x at home with pivot p is on p's side of the
plane midway between p and any other pivot q. By the triangle inequality a vector y within r of x is then no farther
than r beyond that plane, and its distance to the plane is (d(y, p)^2 - d(y, q)^2) / (2 d(p, q)); with q the nearest
pivot of y that decides to which cells y is copied. It never exceeds the bound d(y, p) <= d(y, q) + 2 r of the distances
alone. Each cell then compares its own vectors with all it holds, independently of other cells, so every link is found
where either end is at home, and the count of links at a vector's home is complete.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import Forest, components, settle, small_join

#: Vectors of a label from which pivots cut it, the most pivots of a label, and vectors sampled for each pivot.
CELL, PIVOTS, SAMPLED = 4_000, 64, 8
#: Vectors at home in one task, and vectors compared with them at once.
ANCHORS, STRIP = 2_000, 2_048
#: Slack for rounding in the choice of cells; links themselves are decided by the dot product alone.
SLACK = 1e-9

UNIT = "id long, label string, dim int, h1 long, h2 long, unit binary"


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """One row for each row: its unit vector in double precision, or null where it cannot link."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            dims, h1, h2, units = [], [], [], []
            for key, label, x in zip(b.column("id").to_pylist(), b.column("label").to_pylist(), b.column("embedding"), strict=True):
                v = None
                if key is not None and label is not None and x.is_valid and not x.values.null_count and len(x.values):
                    v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    top = np.abs(v).max()
                    v = v / top if np.isfinite(top) and top > 0 else None
                unit = None if v is None else (v / math.sqrt(float(v @ v))).tobytes()
                a, c = (None, None) if unit is None else np.frombuffer(xxhash.xxh3_128_digest(unit), np.int64).tolist()
                dims.append(None if v is None else len(v))
                h1.append(a)
                h2.append(c)
                units.append(unit)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("label"), pa.array(dims, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(units, pa.binary())],
                names=["id", "label", "dim", "h1", "h2", "unit"],
            )

    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, UNIT)


def pivots(classes: DataFrame) -> DataFrame:
    """(label, dim, pivots array<binary>) of the labels that are cut: a bounded sample in hash order, from which the
    farthest from those before is taken each time. The choice moves work between cells and never the result."""
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > CELL)
    sizes = sizes.withColumn("k", F.least(F.lit(PIVOTS), F.ceil(F.col("n") / CELL)).cast("int"))
    hashed = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) / (1 << 30)
    drawn = classes.join(sizes, ["label", "dim"]).where(hashed * F.col("n") < 2 * SAMPLED * F.col("k"))
    ranked = drawn.withColumn("at", F.row_number().over(Window.partitionBy("label", "dim").orderBy(F.xxhash64("id", F.lit(11)), "id")))
    listed = ranked.where(F.col("at") <= SAMPLED * F.col("k")).groupBy("label", "dim").agg(F.first("k").alias("k"), F.sort_array(F.collect_list(F.struct("at", "unit"))).alias("s"))

    def choose(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            out = []
            for k, s in zip(b.column("k").to_pylist(), b.column("s").to_pylist(), strict=True):
                x = np.stack([np.frombuffer(r["unit"]) for r in s])
                far, chosen = np.full(len(x), np.inf), []
                for _ in range(min(k, len(x))):
                    at = int(far.argmax()) if chosen else 0
                    chosen.append(x[at].tobytes())
                    far = np.minimum(far, ((x - x[at]) ** 2).sum(1))
                out.append(chosen)
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("dim"), pa.array(out, pa.list_(pa.binary()))], names=["label", "dim", "pivots"])

    return listed.select("label", "dim", "k", "s").mapInArrow(choose, "label string, dim int, pivots array<binary>")


def cells(classes: DataFrame, cut: DataFrame, radius: float) -> DataFrame:
    """Copies of each vector: (label, dim, cell, home, id, mult, unit)."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for b in rows:
            label, dim = b.column("label").to_pylist(), b.column("dim").to_pylist()
            unit, cut = b.column("unit"), b.column("pivots")
            take, cell, home = [], [], []
            for i in range(b.num_rows):
                if not cut[i].is_valid:
                    take.append(i)
                    cell.append(0)
                    home.append(True)
                    continue
                key = (label[i], dim[i])
                if key not in known:
                    if len(known) > 256:
                        known.clear()
                    at = np.stack([np.frombuffer(x) for x in cut[i].as_py()])
                    known[key] = at, np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))
                at, between = known[key]
                d = ((at - np.frombuffer(unit[i].as_py())) ** 2).sum(1)
                own = int(d.argmin())
                for p in np.flatnonzero(d - d[own] <= 2 * between[own] * radius + SLACK).tolist():
                    take.append(i)
                    cell.append(p)
                    home.append(p == own)
            t = b.select(["label", "dim", "id", "mult", "unit"]).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(cell, pa.int32()), pa.array(home), *t.columns[2:]], names=["label", "dim", "cell", "home", "id", "mult", "unit"])

    joined = small_join(classes, cut, ["label", "dim"], "left", PIVOTS * 520)
    rows = joined.select("label", "dim", "id", "mult", "unit", "pivots")
    return rows.mapInArrow(run, "label string, dim int, cell int, home boolean, id long, mult long, unit binary")


def cell_links(copies: DataFrame, least: float) -> DataFrame:
    """Each cell's own vectors, in blocks, against all the cell holds. Rows (kind, a, b): kind 0 says that class a
    has b linked vectors in other classes, kind 1 is an edge; the edges span each task's links and never list pairs."""
    sizes = copies.where("home").groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / ANCHORS).cast("int").alias("g"))
    rows = copies.join(sizes, ["label", "dim", "cell"])
    own = F.when(F.col("home"), F.pmod(F.xxhash64("id"), F.col("g")).cast("int"))
    rows = rows.withColumn("own", own).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rows = rows.withColumn("anchor", F.coalesce(F.col("own") == F.col("block"), F.lit(False)))
    # A number for each task's rows, so that runs are found by one comparison; equal numbers of two tasks would only
    # join their rows, and the labels are compared as well.
    rows = rows.withColumn("task", F.xxhash64("label", "dim", "cell", "block"))

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}

        def finish() -> pa.RecordBatch | None:
            if not state.get("ids"):
                return None
            ids, links, edges = state["ids"], state["links"], state["edges"]
            a = ids + [u for u, _ in edges]
            c = links.tolist() + [v for _, v in edges] if links is not None else [0] * len(ids)
            kind = [0] * len(ids) + [1] * len(edges)
            return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["kind", "a", "b"])

        def compare(ids: np.ndarray, mult: np.ndarray, y: np.ndarray) -> None:
            if state["x"] is None:
                state["x"] = np.stack(state["units"])
                state["units"] = []
                state["links"] = np.zeros(len(state["ids"]), np.int64)
                state["forest"] = Forest(len(state["ids"]))
                state["array"] = np.array(state["ids"])
            for lo in range(0, len(ids), STRIP):
                near = state["x"] @ y[lo : lo + STRIP].T >= least
                near &= state["array"][:, None] != ids[None, lo : lo + STRIP]
                state["links"] += near @ mult[lo : lo + STRIP]
                for c in np.flatnonzero(near.any(0)).tolist():
                    linked = np.flatnonzero(near[:, c])
                    first = int(linked[0])
                    state["edges"].append((int(ids[lo + c]), state["ids"][first]))
                    for other in linked[1:].tolist():
                        if state["forest"].join(first, other):
                            state["edges"].append((state["ids"][other], state["ids"][first]))

        for b in rows:
            if not b.num_rows:
                continue
            task = b.column("task").to_numpy()
            anchor = b.column("anchor").to_numpy(zero_copy_only=False)
            ids, mult, unit = b.column("id").to_numpy(), b.column("mult").to_numpy(), b.column("unit")
            label, dim = b.column("label"), b.column("dim")
            edge = np.concatenate([[0], np.flatnonzero((task[1:] != task[:-1]) | (anchor[1:] != anchor[:-1])) + 1, [len(task)]]).tolist()
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                key = (int(task[lo]), label[lo].as_py(), dim[lo].as_py())
                if state.get("key") != key:
                    if done := finish():
                        yield done
                    state = {"key": key, "ids": [], "units": [], "x": None, "links": None, "edges": []}
                y = np.stack([np.frombuffer(u) for u in unit.slice(lo, hi - lo).to_pylist()])
                if anchor[lo]:
                    state["ids"] += ids[lo:hi].tolist()
                    state["units"] += list(y)
                elif state["ids"]:
                    compare(ids[lo:hi], mult[lo:hi], y)
        if done := finish():
            yield done

    # Anchors come first in a task and then, once more, as vectors to compare with.
    twice = rows.withColumn("anchor", F.explode(F.when(F.col("anchor"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    dealt = twice.repartition("task").sortWithinPartitions("task", "label", "dim", F.desc("anchor"), "id")
    return dealt.select("task", "label", "dim", "anchor", "id", "mult", "unit").mapInArrow(run, "kind int, a long, b long")


def linked_vectors(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors(vec_id, embedding, label)``.

    Vectors of equal labels and equal lengths are linked if their cosine is at least ``least``. Null, empty and zero
    vectors, those with null or non-finite components, and rows without a label or an id are linked with nothing and
    kept; component_id is then vec_id. Equal unit vectors of a label collapse into a class before the join and count
    one another. Every row has one row in the result, also where rows repeat an id, each by its own vector. Other
    columns are ignored; an empty table gives no rows.
    """
    rows = settle(unit_vectors(vectors).withColumn("row", F.monotonically_increasing_id()), "units")
    able = rows.where("unit is not null")
    # A class is named by the number of one of its rows: rows that repeat an id with another vector are in another class.
    named = settle(able.groupBy("label", "dim", "h1", "h2").agg(F.min("row").alias("row"), F.min("id").alias("least"), F.count("*").alias("mult")), "vector-names")
    units = able.select("row", "unit").join(named, "row")
    classes = settle(units.withColumnRenamed("row", "id"), "vector-classes")
    copies = settle(cells(classes, settle(pivots(classes), "pivots"), math.sqrt(max(0.0, 2 - 2 * least))), "cells")
    found = settle(cell_links(copies, least), "links")
    linked = components(found.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")))
    per = named.join(found.where("kind = 0").select(F.col("a").alias("row"), F.col("b").alias("links")), "row", "left")
    # Only classes in links can have another's smallest id.
    inside = linked.select(F.col("u").alias("row"), F.col("v").alias("root"))
    inside = inside.unionByName(inside.select(F.col("root").alias("row"), "root").distinct())
    smallest = inside.join(named.select("row", "least"), "row").groupBy("root").agg(F.min("least").alias("smallest"))
    per = per.join(inside.join(smallest, "root").select("row", "smallest"), "row", "left")
    per = per.select("label", "dim", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n"), F.coalesce("smallest", "least").alias("root"))
    joined = able.select("id", "label", "dim", "h1", "h2").join(per, ["label", "dim", "h1", "h2"])
    out = joined.select("id", "n", "root").unionByName(rows.where("unit is null").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("root")))
    return out.select(F.col("id").alias("vec_id"), F.col("n").alias("n_links"), F.col("root").alias("component_id"), F.col("id").eqNullSafe(F.col("root")).alias("kept"))
