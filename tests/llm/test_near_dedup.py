import random
import re

import pytest

from quillmark.llm import near_dedup


def brute(rows, size, percent=80):
    """Smallest reachable id by all pairs of full sets."""
    sets = []
    for _, text in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", lowered) if x]
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]) and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return {rows[i][0]: (len(sets[i]), root[i]) for i in range(len(rows))}


def corpus(seed=1, n=150):
    rng = random.Random(seed)
    rows, k = [], 0
    for _ in range(n):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 3, 5, 30, 120]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 3])):
                own[rng.randrange(len(own))] = f"w{rng.randrange(400)}"
            rows.append((k * 3 + 5, (" " * rng.choice([1, 2])).join(own).upper() if rng.random() < 0.2 else "\n".join(own)))
            k += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("blocks", [2_000, 3])
def test_components_equal_all_pairs(spark, monkeypatch, blocks):
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", blocks)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 100 if blocks == 3 else 1_000_000)
    rows = corpus()
    got = near_dedup.clusters(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    want = brute(rows, 4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_hot_group_of_edited_copies(spark):
    rng = random.Random(2)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for k in range(120):
        own = list(base)
        for _ in range(6):
            own[rng.randrange(150)] = f"z{rng.randrange(10**6)}"
        rows.append((k, " ".join(own)))
    got = near_dedup.clusters(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 4)


def test_odd_rows(spark, odd_docs, no_docs):
    got = near_dedup.clusters(odd_docs, 4).collect()
    assert len(got) == odd_docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [(r.component_id, r.kept) for r in by[1]] == [(1, True)] * 2
    assert by[9][0].component_id == 1 and not by[9][0].kept
    assert by[5][0].component_id == 4
    for k in (2, 3, 6):
        assert (by[k][0].n_shingles, by[k][0].component_id, by[k][0].kept) == (0, k, True)
    assert all(r.component_id is None and r.kept for r in by[None])
    assert near_dedup.clusters(no_docs, 4).count() == 0


def test_one_of_each_keeps_columns(spark, odd_docs, no_docs):
    kept = near_dedup.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert [i for none, i in ids if not none] == [1, 2, 3, 4, 6, 7, 7]
    assert sum(none for none, _ in ids) == 2
    assert set(map(repr, kept.collect())) <= set(map(repr, odd_docs.collect()))
    assert near_dedup.one_of_each(no_docs).count() == 0


def test_rows_that_repeat_an_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(7, a), (7, b), (8, a + " tail"), (9, b + " tail"), (3, b + " end"), (7, a + " more")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.clusters(frame, 4).collect())
    assert got == [(3, 58, 3, True), (7, 57, 3, False), (7, 57, 7, True), (7, 58, 7, True), (8, 58, 7, False), (9, 58, 3, False)]
    kept = sorted(tuple(r) for r in near_dedup.one_of_each(frame).collect())
    assert len(kept) == 2 and kept[0] == (3, b + " end") and kept[1] in [(7, a), (7, a + " more")]
