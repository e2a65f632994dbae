"""Versions with two writers, replayed batches, scalars and walks against brute force on small tables."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.functions import dates as D
from quillmark.functions import facts as V
from quillmark.functions import records as C
from quillmark.operators import chunking, recall
from quillmark.operators import facts as FA
from quillmark.operators import graph as G
from quillmark.operators import resolution as R
from quillmark.operators import upkeep as U
from quillmark.operators import walk as W
from quillmark.sources import parsers as P
from quillmark.sources.catalog import Catalog
from quillmark.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_two_writers_cannot_take_one_turn(spark, tmp_path):
    a, b = Catalog(spark, f"file://{tmp_path}"), Catalog(spark, f"file://{tmp_path}")
    rows = spark.range(3).withColumnRenamed("id", "k")
    first = a.write(rows, "t")
    turn_a, turn_b = a.turn("t"), b.turn("t")  # both look before either writes
    staged_a, staged_b = a.stage(rows.where("k > 0"), "t"), b.stage(rows.where("k > 1"), "t")
    a.activate("t", staged_a, turn=turn_a)
    with pytest.raises(ValueError, match="another writer"):
        b.activate("t", staged_b, turn=turn_b)
    assert a.versions("t") == [first, staged_a] and b.read("t").count() == 2
    # A writer that failed after its claim leaves an empty turn that doesn't block others.
    a._files(f"{tmp_path}").create(a._path(f"file://{tmp_path}/t/_pointers/{a.turn('t'):09d}"), False).close()
    assert b.read("t").count() == 2
    b.upsert(spark.createDataFrame([(9,)], "k long"), "t", ["k"])
    assert sorted(r.k for r in a.read("t").collect()) == [1, 2, 9]
    with pytest.raises(ValueError, match="rows"):
        a.activate("t", staged_b, expect_rows=7)


def test_replayed_batch_counts_once(spark, tmp_path, monkeypatch):
    events = spark.createDataFrame([(k, "2024-01-01 00:00:00", k % 3, "error", 1.0, None) for k in range(30)], "event_id long, ts string, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/in")
    calls = []
    real = jobs.drain_to


    stream = jobs.job_states(jobs.read_events(spark, f"file://{tmp_path}/in"))
    writer = type(stream.writeStream)
    original = writer.foreachBatch
    monkeypatch.setattr(writer, "foreachBatch", lambda self, f: original(self, lambda b, n: (calls.append(n), f(b, n), f(b, n))))
    rows = real(stream, "update", f"file://{tmp_path}/out").collect()
    assert calls and {(r.job, r.state, r.attempts, r.events) for r in rows} == {(f"job{k}", "dead", 5, 10) for k in range(3)} and len(rows) == 3


@pytest.mark.parametrize(("unit", "want"), [(" MHz", "MHz"), ("mHz", "mHz"), ("MW", "MW"), ("MMHG", "mmHg"), ("MMOL/L", "mmol/L"), ("毫安", "mA"), ("µA", "µA"), ("ＭＨＺ", "MHz"), ("℃", "°C"), ("kΩ", "kΩ"), ("furlong", "furlong"), ("", ""), (None, "")])
def test_canonical_unit(spark, unit, want):
    assert one(spark, V.canonical_unit(F.lit(unit).cast("string"))) == want


def test_polarity(spark):
    cases = [("max input", "max output", True), ("输入电压", "输出电压", True), ("internal bus", "external bus", True), ("input", "input pin", False), ("topic", "bottom", False)]
    rows = spark.createDataFrame(cases, "a string, b string, want boolean")
    assert [r.x for r in rows.select(R.polarity_conflict(F.col("a"), F.col("b")).alias("x")).collect()] == [c[2] for c in cases]


def test_cuts_are_the_longest_prefixes():
    rng = random.Random(3)
    for _ in range(60):
        text, most = "".join(rng.choice("ab 字") for _ in range(rng.randrange(1, 200))), rng.randrange(1, 12)
        parts = chunking.cut_long(text, most)
        assert "".join(parts) == text
        rest = text
        for p in parts:
            fits = [k for k in range(1, len(rest) + 1) if chunking.approx_tokens(rest[:k]) <= most]
            assert len(p) == max(fits, default=1)
            rest = rest[len(p) :]


def test_dates(spark):
    assert one(spark, D.found_dates(F.lit("March 3rd, 2021 and 2021年4月5日, 20210506, 5 Sept 2020, 2020-02-31, Mayor 2019."))) == ["2021-03-03", "2021-04-05", "2021-05-06", "2020-09-05"]
    assert one(spark, D.found_dates(F.lit(None).cast("string"))) is None and one(spark, D.found_dates(F.lit(""))) == []
    assert one(spark, D.name_date(F.lit("v2099 x 2020-01.pdf"), 2024)) == "2020-01" and one(spark, D.name_date(F.lit("KV2048X.pdf"), 2050)) is None
    assert one(spark, D.question_window(F.lit("nothing"), 2024)) is None


def test_cells(spark):
    null = F.lit(None)
    number = lambda x, f=None: one(spark, C.cell_text(null.cast("string"), F.lit(x), null.cast("timestamp"), null.cast("boolean"), F.lit(f).cast("string")))
    assert [number(0.545, "0%"), number(0.1 + 0.2), number(6.0), number(-0.0625, "0.0%"), number(1e6)] == ["55%", "0.3", "6", "-6.3%", "1000000"]
    assert one(spark, C.cell_text(*[null.cast(t) for t in ("string", "double", "timestamp", "boolean", "string")])) == ""


def test_lenient_objects():
    assert P._whole_objects('x [{"a": "]}"}, {"b": [1, {"c": 2}]},, {"d"') == ['{"a": "]}"}', '{"b": [1, {"c": 2}]}']
    assert P._whole_objects('{"a": 1} tail') == ['{"a": 1}'] and P._whole_objects(None) == [] == P._whole_objects("[") == P._whole_objects('{"a": ')


def test_pagerank_equals_dense_iteration(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}", float(rng.randrange(0, 5))) for _ in range(80)]
    names = [f"n{k}" for k in range(35)]
    m = np.zeros((35, 35))
    for a, b, w in edges:
        if a != b and w > 0:
            m[int(b[1:]), int(a[1:])] += w
            m[int(a[1:]), int(b[1:])] += w
    out, r = m.sum(0), np.full(35, 1 / 35)
    share = np.divide(m, out, where=out > 0, out=np.zeros_like(m))
    for _ in range(60):
        r = 0.15 / 35 + 0.85 * share @ r + 0.85 * r[out == 0].sum() / 35
    got = {x.key: x.rank for x in G.pagerank(spark.createDataFrame([(n,) for n in names], "key string"), spark.createDataFrame(edges, "source string, target string, weight double")).collect()}
    assert got.keys() == set(names) and all(abs(got[n] - r[int(n[1:])] / r.sum()) < 1e-9 for n in names)


def test_conflicts_equal_all_pairs(spark):
    rng = random.Random(6)
    rows = [(k, "s", f"p{rng.randrange(9)}", "", "", str(rng.randrange(3)), rng.randrange(4), rng.choice([1.0, 1.0 + 1e-9, 2.0, 5.0])) for k in range(140)]
    facts = spark.createDataFrame(rows, "fact_id long, subject string, property string, conditions string, unit string, axis string, doc_id long, value_num double")
    root = {r[0]: r[0] for r in rows}
    linked = set()
    for _ in range(len(rows)):
        for a, b in itertools.combinations(rows, 2):
            if a[2:6] == b[2:6] and a[6] != b[6] and abs(a[7] - b[7]) > 1e-5:
                linked |= {a[0], b[0]}
                root[a[0]] = root[b[0]] = min(root[a[0]], root[b[0]])
    got = {}
    for r in FA.conflicts(facts).distinct().collect():
        got.setdefault(r.conflict_group, set()).add(r.fact_id)
    # Facts of equal document and value are alike, so they belong together even where no link joins them.
    alike = {r[0]: min(x[0] for x in rows if x[2:] == r[2:]) for r in rows}
    want = {}
    for k in linked:
        want.setdefault(root[alike[k]], set()).add(k)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(7)
    rows = [(k, k % 3, f"2024-{rng.randrange(1, 13):02d}-{rng.randrange(1, 28):02d}", rng.randrange(60)) for k in range(90)]
    frame = spark.createDataFrame(rows, "k long, g long, f string, n int").select("k", "g", F.to_date("f").alias("f"), F.date_add(F.to_date("f"), F.col("n")).alias("u"))
    all_ = frame.collect()
    want = {(a.k, b.k) for a, b in itertools.permutations(all_, 2) if a.g == b.g and a.k < b.k and a.f <= b.u and b.f <= a.u}
    got = [(r.a, r.b) for r in FA.overlapping(frame, "k", ["g"], "f", "u", 21).collect()]
    assert set(got) == want and len(got) == len(want)


def test_dense_batch_equals_all_pairs(spark):
    rng = np.random.default_rng(8)
    points = [(f"p{k}", rng.normal(size=4).tolist()) for k in range(300)] + [("zero", [0.0] * 4), ("none", None), ("short", [1.0])]
    asked = [(k, rng.normal(size=4).tolist()) for k in range(7)] + [(9, None)]
    got = recall.dense_batch(spark.createDataFrame(points, "point_id string, vector array<double>").repartition(5), spark.createDataFrame(asked, "question_id long, vector array<double>"), 6, block=3).collect()
    cos = lambda a, b: round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 6)
    for q, v in asked[:7]:
        want = sorted(((-cos(v, x), p) for p, x in points[:300]))[:6]
        assert [(r.point_id, r.score) for r in sorted((r for r in got if r.question_id == q), key=lambda r: r["rank"])] == [(p, -s) for s, p in want]
    assert len(got) == 42


def test_holding_finds_what_contains_finds(spark):
    rows = [(1, "so one two three four five six seven"), (2, "one two three four five six"), (3, "xone two three four five sixy"), (4, "nothing of it"), (5, "")]
    passages = [(1, "one two three four five six"), (2, "three four"), (3, "ne two three four five si")]
    got = {(r.doc_id, r.item) for r in recall.holding(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(passages, "item long, passage string")).collect()}
    assert got == {(d, i) for d, t in rows for i, p in passages if p in t}


def test_named_entities_longest_wins(spark):
    entities = spark.createDataFrame([("a", "Northwind", None), ("b", "Northwind Gateway", "NG"), ("c", "north wind", None)], "key string, title string, alias string")
    q = spark.createDataFrame([(1, "Is Northwind Gateway up?"), (2, "northwind or NG"), (3, "")], "question_id long, question string")
    got = {(r.question_id, r.key, r.ambiguous) for r in W.named_entities(q, entities).collect()}
    assert got == {(1, "b", False), (2, "a", True), (2, "c", True), (2, "b", False)}


def test_budget_passes_over_what_does_not_fit(spark):
    rows = [(1, "a", 0, 0, "x" * 40), (1, "b", 1, 0, "x" * 400), (1, "a", 0, 1, "x" * 40), (1, "b", 1, 1, "x" * 4)]
    got = {(r.kind, r.n): r.admitted for r in W.budgeted_records(spark.createDataFrame(rows, "question_id long, kind string, kind_order int, n long, text string"), 21).collect()}
    assert got == {("a", 0): True, ("b", 0): False, ("a", 1): True, ("b", 1): True}


def test_structured_checks_and_empty_tables(spark):
    items = spark.createDataFrame([("q", "required_facts", "facts", {"a": "X "}), ("q", "required_facts", "facts", {"a": "x", "b": "2"}), ("q", "forbidden_facts", "facts", {"b": "2"})], "item_id string, rule string, kind string, selector map<string,string>")
    found = spark.createDataFrame([("q", "facts", {"a": "x", "b": "1"})], "item_id string, kind string, record map<string,string>")
    check = lambda f: {(r.rule, r.passed, r.total) for r in U.structured_checks(items, f).collect()}
    assert check(found) == {("required_facts", 1, 2), ("forbidden_facts", 1, 1)}
    assert check(found.limit(0)) == {("required_facts", 0, 2), ("forbidden_facts", 1, 1)}


def test_folder_scan_reads_contents(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.md").write_text("# x")
    (tmp_path / "y.txt").write_text("version https://git-lfs.github.com/spec/v1\noid")
    (tmp_path / ".hidden").write_text("no")
    got = {r.path.rsplit("/", 1)[1]: (r.size, r.pointer) for r in P.scan_folder(spark, f"file://{tmp_path}").withColumn("pointer", P.is_pointer(F.col("content"))).collect()}
    assert got == {"x.md": (3, False), "y.txt": (46, True)}


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Far:
        class sparkContext:  # noqa: N801
            master = "spark://far:7077"

            @staticmethod
            def getConf():  # noqa: N802
                return {}

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError, match="checkpoint"):
        G.scratch(Far, "x")
