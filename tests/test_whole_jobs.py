"""Queries over whole tables: rows that smaller windows or fixed subsets of ids would lose."""

import math
import re
from collections import defaultdict

from pyspark.sql import functions as F

from quillmark.operators import graph as G
from quillmark.operators import resolution as R
from quillmark.plans import document_queries as D
from quillmark.plans import registry

SF = "/root/testdata/sf0.001"


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def digits(t):
    return {t[i : i + 2] for i in range(len(t) - 1) if re.search(r"\d", t[i : i + 2])}


def test_similar_names_in_the_whole_window(spark):
    parts = spark.read.parquet(f"{SF}/part.parquet").collect()
    types: dict = {}
    for p in parts:
        types.setdefault(p.p_type, []).append((f"{p.p_name} {p.p_partkey % 40}", p.p_partkey))
    want, far = set(), 0
    for rows in types.values():
        rows.sort()
        for i, (ta, a) in enumerate(rows):
            for k, (tb, b) in enumerate(rows[i + 1 : i + 41], 1):
                if ta == tb or digits(ta) == digits(tb) and lev(ta, tb) <= min(len(ta), len(tb)) // 2:
                    want.add((a, b, lev(ta, tb)))
                    far += k > 10 or lev(ta, tb) > 2
    got = registry.QUERIES["similar_names"](spark, SF).collect()
    assert {(r.a, r.b, r.edits) for r in got} == want and len(got) == len(want) and far


def test_similar_rule(spark):
    cases = [
        ("Blue  Widget", "blue widget", True), ("blue widget", "blew widgets", True), ("VIH", "VIL", False), ("clock input", "clock output", False),
        ("rev 12 board", "rev 13 board", False), ("非易失性存储器", "非易失存储器", True), ("电源管理", "管理电源", False), ("可复用Skill", "Skill", False), ("", "", False),
    ]
    rows = spark.createDataFrame([c[:2] for c in cases], "a string, b string").select(R.name_features("a").alias("a"), R.name_features("b").alias("b"))
    assert [r[0] for r in rows.select(R.similar(F.col("a"), F.col("b"))).collect()] == [c[2] for c in cases]


def test_npmi_of_all_edges(spark):
    orders, weight = defaultdict(set), defaultdict(float)
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect():
        p, s = f"p{r.l_partkey}", f"s{r.l_suppkey}"
        orders[p].add(r.l_orderkey), orders[s].add(r.l_orderkey)
        weight[p, s] += float(r.l_quantity)
    n, most, want = len(set().union(*orders.values())), max(weight.values()), {}
    cooccur = {(p, s): len(orders[p] & orders[s]) for p, s in weight}
    for (p, s), c in cooccur.items():
        v = round(math.log(c * n / len(orders[p]) / len(orders[s])) / -math.log(c / n), 6)
        want[p, s] = c, v, 1 + 9 * max(0, min(1, 0.5 * weight[p, s] / most + 0.3 * c / max(cooccur.values()) + 0.2 * (v + 1) / 2))
    got = {(r.source, r.target): (r.cooccur, r.npmi, r.weight) for r in registry.QUERIES["npmi_weights"](spark, SF).collect()}
    assert got.keys() == want.keys() and len({t for _, t in got}) > 3
    for k, (c, v, w) in want.items():
        assert got[k][0] == c and abs(got[k][1] - v) < 2e-6 and abs(float(got[k][2]) - w) < 2e-4


def test_pagerank_takes_the_operators_steps(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(G, "pagerank", lambda nodes, edges, iterations=60: seen.append(iterations) or nodes.select("key", F.lit(0.0).alias("rank")))
    registry.QUERIES["pagerank"](spark, SF)
    assert seen == [60]


def test_readback_of_late_chunks_and_documents(spark, monkeypatch):
    rows = spark.createDataFrame([(doc, k, "a few words") for doc in (3, 403, 1003) for k in range(6)], "doc_id long, chunk_index int, text string")
    monkeypatch.setattr(D, "chunks", lambda spark, d: rows)
    got = sorted((r.place, r.doc_id, r.chunk_index) for r in D.graph_readback(spark, SF).collect())
    assert [(doc, k) for _, doc, k in got] == [(doc, k) for k in (5, 4, 3, 2, 1, 0) for doc in (3, 403, 1003)]


def test_code_relations_of_late_documents(spark, monkeypatch):
    monkeypatch.setattr(D, "load", lambda spark, d, name: spark.createDataFrame([(298,), (299,), (300,), (301,)], "doc_id long"))
    got = {(r.path, r.name): (r.state, r.callee) for r in D.code_relations(spark, SF).collect()}
    assert len(got) == 8 and all(got[f"src/pkg/m{k}.py", "os"][0] == "external" for k in range(298, 302))
    for k in (298, 299, 300):
        assert got[f"src/pkg/m{k}.py", f"pkg.m{k + 1}"] == ("internal", f"src/pkg/m{k + 1}.py")
    assert got["src/pkg/m301.py", "pkg.m302"] == ("external", None)


def test_name_conflicts_of_late_parts(spark, monkeypatch):
    monkeypatch.setattr(D, "load", lambda spark, d, name: spark.createDataFrame([(k, "ring") for k in range(190, 231)], "p_partkey long, p_name string"))
    assert {(r.conflict, r.contained): r.n for r in D.name_conflicts(spark, SF).collect()} == {(True, True): 40, (False, True): 39}


def test_dissolved_names_of_late_customers(spark, monkeypatch):
    monkeypatch.setattr(D, "load", lambda spark, d, name: spark.createDataFrame([(k,) for k in (10, 20, 100, 200, 300)], "c_custkey long"))
    got = {(r.combined, r.part) for r in D.dissolved_names(spark, SF).collect()}
    assert got == {("c10", "10"), ("c10", "20"), ("c100", "100"), ("c100", "200")}
