"""Graph loops, guarded merges, selection, versions and streams."""

import random

import pytest

from quillmark.operators import fusion, graph, ontology, resolution
from quillmark.sources.catalog import Catalog
from quillmark.streaming import jobs


def test_pagerank_equals_power_iteration(spark):
    rng = random.Random(3)
    names = [f"n{i}" for i in range(30)]
    edges = [(rng.choice(names[:25]), rng.choice(names[:25]), rng.choice([0.0, 1.0, 2.5])) for _ in range(80)]
    got = {r.key: r["rank"] for r in graph.pagerank(spark.createDataFrame([(n,) for n in names], "key string"), spark.createDataFrame(edges, "source string, target string, weight double"), iterations=12).collect()}
    out = dict.fromkeys(names, 0.0)
    near = {n: [] for n in names}
    for a, b, w in edges:
        if a != b and w > 0:
            for x, y in ((a, b), (b, a)):
                out[x] += w
                near[x].append((y, w))
    rank = dict.fromkeys(names, 1 / 30)
    for _ in range(12):
        nxt = dict.fromkeys(names, 0.15 / 30 + 0.85 * sum(rank[n] for n in names if not out[n]) / 30)
        for n in names:
            for m, w in near[n]:
                nxt[m] += 0.85 * rank[n] * w / out[n]
        rank = {n: v / sum(nxt.values()) for n, v in nxt.items()}
    assert all(abs(got[n] - rank[n]) < 1e-9 for n in names)


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_merge_never_joins_conflicting_ids(spark):
    entities = [("a", "t", "alpha", "", 5), ("b", "t", "alpha b", "X1", 1), ("c", "t", "al", "X2", 9), ("d", "t", "alone", "", 1)]
    pairs = [("a", "b"), ("a", "c"), ("b", "c")]
    got = resolution.merged_entities(spark.createDataFrame(entities, "key string, type string, title string, external string, frequency long"), spark.createDataFrame(pairs, "a string, b string"))
    assert {tuple(r) for r in got.collect()} == {("a", "b"), ("b", "b"), ("c", "c")}


def test_selection_invariants(spark):
    rows = [(1, f"p{i:02}", 1 - i / 40, f"common words plus w{i % 3} extra{i}") for i in range(30)]
    got = fusion.mmr(spark.createDataFrame(rows, "question_id long, point_id string, score double, text string"), 5).orderBy("place").collect()
    assert [r.place for r in got] == [1, 2, 3, 4, 5] and got[0].point_id == "p00"
    taken = fusion.budgeted(spark.createDataFrame([(1, "a", 1, 50), (1, "b", 2, 60), (1, "c", 3, 40)], "question_id long, point_id string, place long, tokens long"), 100)
    assert {r.point_id for r in taken.collect()} == {"a", "c"}


def test_schema_round_trip_and_cycles():
    model = ontology.normalised({"types": [{"name": " part "}, {"name": "chip", "is_a": "part"}, {"name": "x", "is_a": "unknown"}], "predicates": [{"name": "Made Of", "source": ["chip", "no"], "target": ["*"]}]})
    assert ontology.from_linkml(ontology.to_linkml(model, "m", "1")) == model
    with pytest.raises(ValueError):
        ontology.normalised({"types": [{"name": "a", "is_a": "b"}, {"name": "b", "is_a": "a"}]})


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/c")
    rows = spark.range(10)
    first = catalog.write(rows, "t")
    staged = catalog.stage(spark.range(5), "t")
    with pytest.raises(ValueError):
        catalog.activate("t", staged, expect_rows=6)
    assert catalog.read("t").count() == 10
    catalog.upsert(spark.range(8, 12), "t", ["id"])
    assert catalog.read("t").count() == 12 and catalog.read("t", first).count() == 10
    catalog.activate("t", first)
    assert catalog.read("t").count() == 10
    assert len(catalog.expire("t", keep=1)) == 1 and catalog.read("t").count() == 10


def test_job_states_over_two_batches_equal_a_replay(spark, tmp_path):
    folder = f"{tmp_path}/in"
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.where("event_id < 500").coalesce(1).write.parquet(folder)
    out = f"file://{tmp_path}/out"
    jobs.drain_to(jobs.job_states(jobs.read_events(spark, folder)), "update", out)
    source.where("event_id >= 500").coalesce(1).write.mode("append").parquet(folder)
    rows = jobs.drain_to(jobs.job_states(jobs.read_events(spark, folder)), "update", out).collect()
    last = {}
    for r in sorted(rows, key=lambda r: r._batch):
        last[r.job] = (r.state, r.attempts, r.events)
    want = {}
    for e in sorted(source.collect(), key=lambda e: (e.event_id >= 500, e.ts, e.event_id)):
        name, attempts, n = want.get(f"job{e.user_id}", ("queued", 0, 0))
        if name != "dead" and e.event_type == "error":
            attempts += 1
            name = "dead" if attempts >= 5 else "queued"
        elif name != "dead" and e.event_type == "purchase":
            name = "running"
        want[f"job{e.user_id}"] = (name, attempts, n + 1)
    assert last == want
