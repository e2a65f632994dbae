import numpy as np
import pytest

from quillmark.llm import embedding_dedup


def brute(rows, least=0.93):
    able = {}
    for k, v, label in rows:
        if k is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            able[k] = (label, np.array(v) / np.linalg.norm(v))
    links = {k: [] for k, *_ in rows if k is not None}
    for a, (la, x) in able.items():
        for b, (lb, y) in able.items():
            if a != b and la == lb and len(x) == len(y) and float(x @ y) >= least:
                links[a].append(b)
    root = {k: k for k in links}
    for _ in links:
        for a, bs in links.items():
            root[a] = min([root[a], *(root[b] for b in bs)])
    return {k: (len(links[k]), root[k]) for k in links}


@pytest.mark.parametrize(("cell", "anchors"), [(4_000, 2_000), (40, 7)])
def test_links_equal_all_pairs(spark, monkeypatch, cell, anchors):
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    monkeypatch.setattr(embedding_dedup, "ANCHORS", anchors)
    rng = np.random.default_rng(3)
    rows, k = [], 0
    for label in (0, 1, 2):
        for _ in range(60 if label else 120):
            base = rng.normal(size=8)
            for _ in range(rng.choice([1, 1, 1, 4])):
                rows.append((k * 2 + 1, (base + rng.normal(size=8) * rng.choice([0, 0.05, 0.2])).tolist(), label))
                k += 1
    got = embedding_dedup.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows) and len(got) == len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_odd_vectors(spark):
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], None), (4, None, 0), (5, [0.0, 0.0], 0), (6, [float("nan"), 1.0], 0), (7, [float("inf"), 1.0], 0),
        (8, [1.0, None], 0), (9, [], 0), (10, [1.0, 0.0, 0.0], 0), (11, [1e300, 1e-300], 0), (12, [1.0, 0.0], 1), (13, [-1.0, 0.0], 0),
    ]
    frame = spark.createDataFrame([(*r, 1, "u") for r in rows], "vec_id long, embedding array<double>, label int, id long, unit string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.linked_vectors(frame).collect()}
    assert got.pop(1) == (2, 1, True) and got.pop(2) == (2, 1, False) and got.pop(11) == (2, 1, False)
    assert all(v == (0, k, True) for k, v in got.items()) and len(got) == 10
    assert embedding_dedup.linked_vectors(frame.limit(0)).count() == 0


def test_rows_that_repeat_an_id(spark):
    rows = [(7, [1.0, 0.0], 0), (7, [0.0, 1.0], 0), (8, [1.0, 0.01], 0), (9, [0.01, 1.0], 0), (5, [0.0, 2.0], 0)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(5, 2, 5), (7, 1, 7), (7, 2, 5), (8, 1, 7), (9, 2, 5)]
