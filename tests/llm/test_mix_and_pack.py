import random
import tracemalloc
from collections import Counter
from fractions import Fraction

import public_tokenizers
import pytest

from quillmark.llm import mixing, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


RNG = random.Random(12)


@pytest.mark.parametrize(
    "weights",
    [{"a": 1.0, "b": 1.0}, {"a": 5.0, "b": 2.0, "c": 0.1}, {"a": 0.9, "b": 0.0999, "c": 0.0001}, {"hot": 9e9**0.5, **{f"s{i}": (1e9 + i) ** 0.5 for i in range(19)}}, {f"r{i:03}": RNG.random() for i in range(60)}],
)
def test_targets_are_kept_in_every_phase(weights):
    """Against the given weights, at every slot, over a hundred rounds of the sources and to the end of all phases."""
    blocks = {n: RNG.randrange(1, 200) if k % 3 else 600 for k, n in enumerate(weights)}
    rows: dict = {n: [] for n in weights}
    for n, run, *columns in mixing.dealt(blocks, weights, run=7):
        assert run == len(rows[n]) // 7 and 0 < len(columns[0]) <= 7
        rows[n] += list(zip(*columns, strict=True))
    assert {n: len(x) for n, x in rows.items()} == blocks
    order = sorted((slot, n) for n, x in rows.items() for slot, _, _ in x)
    assert [slot for slot, _ in order] == list(range(sum(blocks.values())))
    assert all(release <= slot < deadline for x in rows.values() for slot, release, deadline in x)
    left, since, t, total = dict(blocks), dict.fromkeys(weights, 0), 0, sum(map(Fraction, weights.values()))
    for _, n in order:
        left[n] -= 1
        since[n] += 1
        t += 1
        for m in (weights if t % 13 == 0 else (n,)):
            assert m not in since or abs(since[m] - t * Fraction(weights[m]) / total) < 1
        if not left[n]:
            since = {m: 0 for m in left if left[m]}
            t, total = 0, sum(Fraction(weights[m]) for m in since)


def test_many_sources_take_little_memory():
    weights = {f"d{i}": (i + 1) ** 0.5 for i in range(10_000)}
    found = mixing.dealt(dict.fromkeys(weights, 10**9), weights, run=4)
    tracemalloc.start()
    next(found)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6


def docs(spark, n=400):
    rng = random.Random(8)
    rows = [(k, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([1, 20, 200, 3000]))), rng.choice(["hot", "hot", "a", "b", "c"])) for k in range(n)]
    rows += [(n + k, "the same words " * 40, "a") for k in range(30)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_schedule_and_order(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 2_000)
    monkeypatch.setattr(mixing, "GROUP", 90)
    frame = docs(spark)
    rows = mixing.schedule(frame).collect()
    assert sorted(r.doc_id for r in rows) == list(range(430))
    blocks = {(r.source, r.block): (r.slot, r.release, r.deadline) for r in rows}
    assert len({(r.source, r.block, r.slot) for r in rows}) == len(blocks)
    assert sorted(s for s, _, _ in blocks.values()) == list(range(len(blocks)))
    assert all(release <= slot < deadline for slot, release, deadline in blocks.values())
    place = {r.doc_id: (r.slot, r.within) for r in rows}
    ordered = [r.doc_id for r in mixing.mixed(frame).collect()]
    assert ordered == sorted(place, key=place.get)
    assert mixing.mixed(frame).columns == frame.columns


def test_blocks_cross_groups(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 1_000)
    rows = [(k, "x" * 90, "hot") for k in range(900)] + [(1000 + k, "y" * 90, "rare") for k in range(60)] + [(2000, "z" * 2500, "long"), (2001, "z" * 400, "long"), (2002, "z" * 400, "long")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = []
    for group in (20, 100_000):  # as in a large and in a small table
        monkeypatch.setattr(mixing, "GROUP", group)
        got = mixing.schedule(frame).collect()
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
        blocks = {s: Counter(r.block for r in got if r.source == s) for s in ("hot", "rare", "long")}
        assert sorted(blocks["rare"]) == list(range(6)) and all(blocks["rare"][b] in (11, 12) for b in range(5))
        assert all(n in (11, 12) for b, n in blocks["hot"].items() if b < 80) and sorted(blocks["hot"]) == list(range(81))
        assert sorted(blocks["long"]) == list(range(len(blocks["long"])))
        assert len({(r.source, r.within) for r in got}) == len(rows)
        found.append(sorted(got))
    assert found[0] == found[1]


def test_bins_equal_a_plain_best_fit():
    rng = random.Random(9)
    n, sources, clusters = [rng.choice([0, 3, 40, 90, 260]) + 1 for _ in range(300)], [rng.choice("aab") for _ in range(300)], [rng.randrange(40) for _ in range(300)]
    got = packing.pack_shard(n, sources, clusters, 100, 3)
    bins = []
    for i, k, at, size, b, before in got:
        fits = [x for x in bins if x["left"] >= size and x["sources"][sources[i]] < 3 and clusters[i] not in x["clusters"]]
        if fits:
            assert bins[b] in fits and bins[b]["left"] == min(x["left"] for x in fits)
        else:
            assert b == len(bins)
            bins.append({"left": 100, "sources": Counter(), "clusters": set()})
        assert before == 100 - bins[b]["left"]
        bins[b]["left"] -= size
        bins[b]["sources"][sources[i]] += 1
        bins[b]["clusters"].add(clusters[i])
    pieces = Counter()
    for i, _, _, size, _, _ in got:
        pieces[i] += size
    assert all(pieces[i] == n[i] for i in range(300))


def test_packed_rows(spark, tmp_path):
    frame = docs(spark)
    frame.repartition(3).write.parquet(f"{tmp_path}/d")
    spark.createDataFrame(frame.rdd.map(lambda r: (*r, r.doc_id % 300)), "doc_id long, text string, source string, cluster long").write.parquet(f"{tmp_path}/c")
    files = spark.read.parquet(f"{tmp_path}/d")
    assert packing.packed(frame, PATH, 1000, 2).count() == packing.packed(files, PATH, 1000, 2).count()
    for source, how in ((frame, {}), (frame, {"in_order": True}), (files, {}), (files, {"in_order": True}), (spark.read.parquet(f"{tmp_path}/c"), {"cluster": "cluster"})):
        rows = packing.packed(source, PATH, capacity=1000, per_source=2, **how).collect()
        by_bin: dict = {}
        for r in rows:
            by_bin.setdefault(r.bin_id, []).append(r)
        for members in by_bin.values():
            assert sum(r.n_tokens for r in members) <= 1000
            assert max(Counter(r.source for r in members).values()) <= 2
            assert how.get("cluster") or sum(r.doc_id >= 400 for r in members) <= 1  # copies keep apart
            assert not how.get("cluster") or max(Counter(r.doc_id % 300 for r in members if r.piece == 0).values(), default=1) == 1
        assert {r.doc_id for r in rows} == set(range(430))


def test_odd_rows(spark, odd_docs, no_docs):
    assert mixing.schedule(odd_docs).count() == odd_docs.count() == mixing.mixed(odd_docs).count()
    assert mixing.schedule(no_docs).count() == 0 == mixing.mixed(no_docs).count()
    assert mixing.mixed(odd_docs).columns == odd_docs.columns
    assert sorted(map(repr, mixing.mixed(odd_docs).collect())) == sorted(map(repr, odd_docs.collect()))
    rows = packing.packed(odd_docs, PATH).collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r.doc_id for r in odd_docs.collect())
    assert packing.packed(no_docs, PATH).count() == 0
