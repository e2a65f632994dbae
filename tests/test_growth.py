"""Steps whose rows would grow faster than their inputs: results on crowded keys, and the most rows a step makes."""

import time

import duckdb
from pyspark.sql import functions as F

from quillmark.operators import chunking, fusion
from quillmark.operators import recall as T
from quillmark.operators import walk as W
from quillmark.plans import registry
from tests.oracle import compare


def most_rows(df):
    """(rows, the greatest number of rows that any step of the plan put out)."""
    rows, most, seen = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
    while seen:
        plan = seen.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            seen.append(plan.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            seen.append(plan.plan())
            continue
        metric = plan.metrics().get("numOutputRows")
        most = max(most, metric.get().value()) if metric.isDefined() else most
        children = plan.children()
        seen += [children.apply(i) for i in range(children.length())]
    return rows, most


def test_seeds_of_a_crowded_name(spark):
    questions = spark.range(300).select(F.col("id").alias("question_id"), F.lit("what about bolt-7").alias("question"))
    entities = spark.range(300).select(F.format_string("e%03d", "id").alias("key"), F.lit("Bolt 7").alias("title"), F.when(F.col("id") == 299, "bolt_7").alias("alias"), F.lit(None).cast("string").alias("external"))
    relations = spark.range(300).select(F.format_string("r%03d", "id").alias("relation"), F.lit("bolt 7").alias("source_title"), F.lit("Bolt-7").alias("target_title"))
    rows, most = most_rows(W.lexical_seeds(questions, entities, relations))
    want = {("entity", f"e{i:03}", 0.85) for i in range(5)} | {("relation", f"r{i:03}", 0.8) for i in range(5)}
    assert len(rows) == 3000 and {tuple(r)[1:] for r in rows} == want
    assert most <= 300 * 10


def test_redundancy_counts_equal_texts(spark):
    words = ["red bolt a", "red bolt b", "ring", "", "bolt ring c d"]
    texts = [(q, i, words[(i * i + q) % 5] + (f" n{i % 3}" if i % 4 else "")) for q in (1, 2) for i in range(40)] + [(3, 1, "alone")]
    again = [(1, 7, "red bolt z"), (1, 7, "ring n9"), (4, 1, "twice"), (4, 1, "twice"), (5, 1, ""), (5, 2, "x")]
    rows = spark.createDataFrame(texts + again, "question_id long, point_id long, text string")
    want = {}
    for q in (1, 2, 5):
        own = [(p, set(t.split())) for x, p, t in texts + again if x == q]
        found = [len(a & b) / len(a | b) for i, (p, a) in enumerate(own) for o, b in own[i + 1 :] if p != o and a | b]
        want[q] = round(sum(found) / len(found), 4)
    assert {r[0]: r[1] for r in W.redundancy(rows).collect()} == want
    sums = W.jaccard_sums(rows.select("question_id", F.array_sort(F.array_distinct(F.split("text", " "))).alias("t")), ["question_id"], block=3, width=2)
    whole = W.jaccard_sums(rows.select("question_id", F.array_sort(F.array_distinct(F.split("text", " "))).alias("t")), ["question_id"])
    assert {r[0]: (round(r[1], 9), r[2]) for r in sums.collect()} == {r[0]: (round(r[1], 9), r[2]) for r in whole.collect()}
    crowd = spark.range(2000).select(F.lit(1).alias("question_id"), F.col("id").alias("point_id"), F.concat(F.lit("red bolt "), F.col("id") % 5).alias("text"))
    rows, most = most_rows(W.redundancy(crowd))
    n, near = 5 * 400, 5 * 400 * 399 / 2
    assert rows[0].redundancy == round((near + 0.5 * (n * (n - 1) / 2 - near)) / (n * (n - 1) / 2), 4) and most <= 2000


def seeded(questions, facts, lanes, limit):
    """``fact_seeds`` by all pairs of the cases below: (question_id, words, window), (fact_id, subject, property, symbol, value, axis)."""
    out = []
    for q, words, window in questions:
        best = {}
        for f in facts:
            names = {x.lower() for x in f[2:4] if x} & words
            mine = [(lane, s) for x, i, lane, s in lanes if (x, i) == (q, f[0])]
            dense = min(1.0, max(s for _, s in mine) + 0.05 * ({"property", "value"} <= {x for x, _ in mine})) if mine else 0
            base = max(dense, min(1.0, 0.85 + 0.1 * (len(names) - 1)) if names else 0)
            if not mine and not names:
                continue
            shared = len({t for t in " ".join(x for x in f[1:5] if x).lower().split() if len(t) > 1} & words)
            dated = f[5] is None or f[5][:4].isdigit()
            factor = 1.0 if not window or not dated else 1.1 if window[0] <= (f[5] or "")[:4] <= window[1] else 0.8
            rank = (-round((base + 0.05 * shared) * factor, 6), f[0])
            best[f[1:]] = min(best.get(f[1:], rank), rank)
        out += [(q, i, -s, n) for n, (s, i) in enumerate(sorted(best.values())[:limit], 1)]
    return sorted(out)


def test_fact_seeds_of_crowded_names(spark):
    texts = {q: ("size of red rod 12" if q % 3 else "iq and size in rod 7x") for q in range(60)}
    windows = {q: ("1995", "1997") if q % 4 == 0 else None for q in range(60)}
    facts = [(i, ("red rod", "blue rod", "x")[i % 3], ("Size", "weight", None)[i % 5 % 3], ("IQ", "", None, "size")[i % 4], ("12", "7x", "3")[i % 7 % 3], (f"{1993 + i % 6}-01", "v2", None)[i % 11 % 3]) for i in range(400)]
    lanes = [(q, (q * 7 + i * 13) % 420, ("text", "property", "value")[(q + i) % 3], (i % 4 + 5) / 10) for q in range(60) for i in range(5)]
    qs = spark.createDataFrame([(q, texts[q], windows[q]) for q in texts], "question_id long, question string, window struct<from:string, to:string>")
    frame = spark.createDataFrame(facts, "fact_id long, subject string, property string, symbol string, value string, axis string")
    rows, most = most_rows(W.fact_seeds(qs, frame, spark.createDataFrame(lanes, "question_id long, fact_id long, lane string, score double"), 4))
    want = seeded([(q, {t for t in texts[q].split() if len(t) > 1}, windows[q]) for q in texts], facts, lanes, 4)
    assert sorted(map(tuple, rows)) == want
    assert most < 60 * 400 / 4


def test_sentences_of_a_blank_text(spark, tmp_path):
    rows = spark.createDataFrame([(1, "One. Two!"), (2, ""), (3, " \n\n "), (4, "x")], "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    compare(registry.QUERIES["sentence_split"](spark, str(tmp_path)), con, registry.SQL["sentence_split"])


def test_owner_points_of_long_numbers(spark, tmp_path):
    key = F.col("id")
    rows = spark.range(400).select((key % 2).alias("l_suppkey"), F.when(key % 3 == 0, key + 999_900).otherwise(key * 70_001).alias("l_partkey"), F.when(key % 5 == 0, 99_999_990 + key).otherwise(key + 5).alias("l_orderkey"))
    rows.unionByName(rows.withColumn("l_orderkey", F.col("l_orderkey") + 100_000_000)).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    compare(registry.QUERIES["owner_points"](spark, str(tmp_path)), con, registry.SQL["owner_points"])


def test_best_points_of_many_ties(spark):
    vocab = ["a", "b", "c", "d", "e"]
    texts = {f"p{i:04}": [vocab[(i * 7 + j * j) % 5] for j in range(i % 4)] + ["other"] * (i % 3) for i in range(900)}
    asked = [(q, vocab[q % 5 :] + ["missing"] * (q % 2)) for q in range(12)]
    index = spark.createDataFrame([(p, t, len(t)) for p, t in texts.items()], "point_id string, tokens array<string>, length long").repartition(5)
    rows = T.best_points(T.narrowed(index, [*vocab, "missing"]), asked, 7, block=5)
    got = T.top_k(rows, "score", "point_id", 7, ["question_id"]).collect()
    want = set()
    for q, own in asked:
        found = sorted((-round(len(set(t) & set(own)) / len(own), 6), p) for p, t in texts.items() if set(t) & set(own))[:7]
        want |= {(q, p, -s, n) for n, (s, p) in enumerate(found, 1)}
    assert {(r.question_id, r.point_id, r.score, r["rank"]) for r in got} == want and len(got) == len(want)
    assert rows.count() <= 5 * 12 * 7
    counts = {r[0]: r[1] for r in T.frequencies(index, vocab, []).collect()}
    assert counts == {v: sum(v in t for t in texts.values()) for v in vocab}


def test_overlap_of_long_lines(spark):
    long = "".join(chr(97 + i * i % 23) + "\U0001d11e漢é"[i % 3] for i in range(40_000))
    texts = [(1, 0, long), (1, 1, long[:70_000] + "x"), (1, 2, "ab"), (1, 3, "ab"), (1, 4, "abc\r"), (1, 5, "aab"), (2, 0, "\U0001d11e漢é!"), (2, 1, "\U0001d11e漢é?"), (2, 2, "\U0001d11e漢é")]
    rows = spark.createDataFrame(texts, "doc_id long, chunk_index long, text string")
    grams = {(d, c): {t[i : i + 3] for i in range(max(1, len(t) - 2))} for d, c, t in texts}
    want = {(d, a, b, round(len(x & y) / min(len(x), len(y)), 6)) for (d, a), x in grams.items() for (e, b), y in grams.items() if d == e and 1 <= b - a <= 2}
    start = time.time()
    got = {tuple(r) for r in fusion.overlap_pairs(rows, 0.0).collect()}
    assert got == want and time.time() - start < 20
    assert {tuple(r) for r in fusion.overlap_pairs(rows).collect()} == {w for w in want if w[3] >= 0.85}


def test_repeats_of_long_texts():
    def plain(previous, text, least=12):
        ends = [k for k in range(least, min(len(previous), len(text)) + 1) if previous.endswith(text[:k])]
        return text[max(ends) :].lstrip() if ends else text

    parts = ["ab" * 20, "a" * 30, "ab" * 9 + "c", "xyz" * 7, "abababababab", "short", "", " " * 13 + "q"]
    for x in parts:
        for y in parts:
            for z in parts:
                assert chunking.drop_repeat(x + y, y + z) == plain(x + y, y + z) and chunking.drop_repeat(x, z) == plain(x, z)
    line, start = "".join(chr(97 + i * i % 23) for i in range(300_000)), time.time()
    assert chunking.drop_repeat("0" + line, "1" + line) == "1" + line and chunking.drop_repeat("0" + line, line + "1") == "1"
    assert time.time() - start < 1


def test_evidence_of_crowded_units(spark):
    facts = spark.range(3000).select(F.col("id").alias("fact_id"), (F.col("id") % 3).alias("unit_id"), F.when(F.col("id") % 2 == 0, "the").otherwise("qzx").alias("value"))
    chunks = spark.range(90).select((F.col("id") % 3).alias("unit_id"), F.col("id").cast("string").alias("point_id"), F.col("id").alias("chunk_index"), F.when(F.col("id") > 20, "in the end").otherwise("none").alias("text"))
    rows, most = most_rows(W.located_facts(facts, chunks))
    assert {tuple(r) for r in rows} == {(i, str(21 + i % 3) if i % 2 == 0 else str(i % 3), i % 2 == 0) for i in range(3000)}
    assert most <= 3000
