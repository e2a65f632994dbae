"""Queries over graph walks, evidence, endpoints, upkeep and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmark.functions import records as C
from quillmark.operators import fusion, recall
from quillmark.operators import upkeep as U
from quillmark.operators import walk as W
from quillmark.operators.graph import scratch
from quillmark.plans.graph_queries import EDGES, edges, nodes
from quillmark.plans.ingest_queries import CHUNKS, JOBS, NOW, PATH, jobs
from quillmark.plans.record_queries import picked
from quillmark.plans.search_queries import POINTS, QUESTIONS, points, questions
from quillmark.sources.tables import chunks, files, load, rel_path


def ledger(spark, d):
    return points(spark, d).select("point_id", F.col("doc_id").alias("file_id"), F.when(F.col("doc_id") % 8 == 1, "retired").otherwise("active").alias("status"), F.sha2("text", 256).alias("text_sha"), F.lit("v1").alias("content_version"))


def stored(spark, d):
    rows = points(spark, d).where("doc_id % 9 <> 2")
    return rows.select("point_id", F.when(F.col("doc_id") % 9 == 3, "").when(F.col("doc_id") % 9 == 4, F.lit("other")).otherwise(F.sha2("text", 256)).alias("text_sha"), F.when(F.col("doc_id") % 9 == 5, "v0").otherwise("v1").alias("content_version"))


def input_drift(spark, d):
    rows = U.drift(ledger(spark, d), stored(spark, d))
    return rows.agg(*(F.count_if(c).alias(c) for c in ("missing", "version_mismatch", "text_mismatch")))


def repair_candidates(spark, d):
    state = load(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.when(F.col("doc_id") % 5 == 4, "deleted").otherwise("indexed").alias("status"), F.when(F.col("doc_id") % 7 != 0, "v1").alias("indexed_version"), (F.col("doc_id") % 10 == 6).alias("running"))
    return U.to_repair(state, ledger(spark, d), stored(spark, d)).select("file_id")


def orphan_versions(spark, d):
    have = load(spark, d, "orders").select(F.col("o_orderkey").alias("version"), "o_orderdate")
    known = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("version")).distinct()
    return U.orphans(have, known, F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")).select("version")


def cancelled_jobs(spark, d):
    rows = jobs(spark, d).withColumn("file_id", F.col("job_id") % 400).withColumn("kind", F.when(F.col("job_id") % 3 == 0, "delete").otherwise("parse"))
    changed = spark.range(400).where("id % 3 = 1").select(F.col("id").alias("file_id"))
    return U.cancelled(rows, changed, ["delete"]).groupBy("kind", "status").agg(F.count("*").alias("n"))


def claimable_jobs(spark, d):
    return U.claimable(jobs(spark, d), F.lit(NOW)).groupBy("kb_id", "taken_over").agg(F.count("*").alias("n"))


def lease_beats(spark, d):
    rows = jobs(spark, d).withColumn("worker", F.concat(F.lit("w"), F.col("job_id") % 5))
    beats = load(spark, d, "events").select((F.col("event_id") + 1).alias("job_id"), F.concat(F.lit("w"), (F.col("event_id") + picked(F.col("event_id"), 2, F.lit(1), F.lit(2))) % 5).alias("worker"), (F.unix_timestamp(F.col("ts").cast("timestamp")) + 1000).alias("at"))
    return U.beaten(rows, beats, 600).groupBy("status").agg(F.sum(F.col("lease_until") - F.col("created_at")).alias("lease"), F.count("*").alias("n"))


def soft_delete(spark, d):
    """Points of deleted files become inactive; of those that come back only the ones that this deletion stopped revive."""
    rows = points(spark, d).select("point_id", F.col("doc_id").alias("file_id"), (F.col("chunk_index") % 4 != 0).alias("active"), F.when(F.col("chunk_index") % 4 == 0, F.lit(5)).alias("inactive_at"))
    gone = load(spark, d, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("file_id"))
    back = gone.where("file_id % 2 = 0").withColumn("deleted_at", F.lit(77))
    return U.reactivated(U.deactivated(rows, gone, F.lit(77)), back).groupBy("active", "inactive_at").agg(F.count("*").alias("n"))


def metadata_fingerprints(spark, d):
    rows = files(spark, d)
    print_ = U.metadata_fingerprint({"rel_path": F.col("rel_path"), "filename": F.col("filename"), "size": F.when(F.col("doc_id") % 4 != 0, F.col("size"))})
    return rows.select("doc_id", print_.alias("fingerprint"))


def folder_enrolment(spark, d):
    rows = files(spark, d)
    known = rows.where("doc_id % 5 < 3").select("kb_id", "checksum")
    found = rows.select(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("new-"), "kb_id")).otherwise(F.concat(F.lit("renamed-"), "kb_id")).alias("folder"), F.when((F.col("doc_id") % 2 == 0) & (F.col("doc_id") % 6 > 0), F.sha2("rel_path", 256)).otherwise(F.col("checksum")).alias("checksum"))
    return U.folder_matches(known, found)


def due_jobs(spark, d):
    last = spark.createDataFrame([("scan", 100), ("worker", -500), ("graph", 0), ("gc", None), ("cache", 50), ("logs", -2_592_000)], "job string, last_run long")
    return U.due(last, F.lit(160))


def corpus_snapshots(spark, d):
    """Whether a library's snapshot differs when one text does, and not when rows come in another order."""
    rows = points(spark, d).select("kb_id", "point_id", F.sha2("text", 256).alias("text_sha"))
    other = rows.withColumn("text_sha", F.when((F.col("kb_id") == "src1") & (F.hash("point_id") % 7 == 0), F.lit("x")).otherwise(F.col("text_sha"))).orderBy(F.desc("point_id"))
    one = U.snapshot_hash(rows, "kb_id", ["point_id", "text_sha"])
    two = U.snapshot_hash(other, "kb_id", ["point_id", "text_sha"]).withColumnRenamed("snapshot", "s2")
    return one.join(two, "kb_id").select("kb_id", (F.col("snapshot") == F.col("s2")).alias("same"))


def phase_resume(spark, d):
    """A finished phase is read again, not built again, unless its fingerprint changes."""
    folder = scratch(spark, "phases")
    build = lambda k: lambda: load(spark, d, "customer").groupBy("c_mktsegment").agg((F.count("*") * k).alias("n"))
    first = U.phase(spark, folder, "count", "a", build(1))
    again = U.phase(spark, folder, "count", "a", build(2))
    changed = U.phase(spark, folder, "count", "b", build(3))
    return first.join(again.withColumnRenamed("n", "again"), "c_mktsegment").join(changed.withColumnRenamed("n", "changed"), "c_mktsegment")


def replayed_decisions(spark, d):
    pairs = load(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_returnflag").alias("content")).distinct()
    judged = pairs.where("(a + b) % 3 = 0").select(F.col("b").alias("a"), F.col("a").alias("b"), F.when(F.col("a") % 4 == 0, "Z").otherwise(F.col("content")).alias("content"), F.lit("same").alias("verdict"))
    decided, left = U.replayed(pairs, judged)
    return decided.groupBy("verdict").agg(F.count("*").alias("n")).unionByName(left.select(F.lit("open").alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n")))


def supported_definitions(spark, d):
    names = load(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    uses = load(spark, d, "part").join(load(spark, d, "lineitem"), F.expr("l_partkey = p_partkey")).select(F.col("p_name").alias("name"), F.col("l_orderkey").alias("unit_id"))
    live = load(spark, d, "orders").where("o_orderkey % 150 = 7").select(F.col("o_orderkey").alias("unit_id"))
    return U.supported(names, uses, live)


def run_comparison(spark, d):
    of = lambda flag: load(spark, d, "lineitem").where(F.col("l_returnflag") == flag).groupBy(F.concat(F.lit("m"), F.col("l_suppkey") % 20 + (F.col("l_returnflag") == "R").cast("long") * 5).alias("metric")).agg(F.round(F.avg("l_tax"), 4).alias("value"))
    return U.run_deltas(of("A"), of("R"))


def structured_evaluation(spark, d):
    c = load(spark, d, "customer")
    item = F.col("c_custkey").cast("string")
    rule = lambda name, kind, selector: c.select(item.alias("item_id"), F.lit(name).alias("rule"), F.lit(kind).alias("kind"), selector.alias("selector"))
    items = rule("required_facts", "facts", F.create_map(F.lit("status"), F.lit(" f "), F.lit("priority"), F.lit("1-URGENT"))).unionByName(rule("required_facts", "facts", F.create_map(F.lit("status"), F.lit("O")))).unionByName(rule("forbidden_facts", "facts", F.create_map(F.lit("priority"), F.lit("5-low"))))
    found = load(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("item_id"), F.lit("facts").alias("kind"), F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority")).alias("record"))
    return U.structured_checks(items, found)


def path_checks(spark, d):
    li = load(spark, d, "lineitem")
    have = li.select(F.concat(F.lit("o"), F.col("l_orderkey") % 90).alias("source"), F.lit("holds").alias("predicate"), F.concat(F.lit("p"), F.col("l_partkey") % 90).alias("target"))
    have = have.unionByName(li.select(F.concat(F.lit("p"), F.col("l_partkey") % 90), F.lit("from"), F.concat(F.lit("s"), F.col("l_suppkey") % 40)).toDF("source", "predicate", "target"))
    k = F.col("id")
    o, p, s = F.concat(F.lit("o"), k % 90), F.concat(F.lit("p"), k * 7 % 90), F.concat(F.lit("s"), k * 3 % 40)
    paths = spark.range(500).select(k.alias("path_id"), F.explode(F.array(F.struct(o.alias("source"), F.lit("holds").alias("predicate"), p.alias("target")), F.struct(p.alias("source"), F.lit("from").alias("predicate"), s.alias("target")))).alias("e"))
    return U.paths_hold(paths.select("path_id", "e.*"), have)


def set_sample(spark, d):
    return U.sampled(points(spark, d), 40, 7, 60).select("point_id", F.length("text").cast("long").alias("chars"))


def active_chunk_refs(spark, d):
    own = files(spark, d).select(F.col("doc_id").alias("file_id"), "rel_path")
    return W.active_refs(ledger(spark, d), own).groupBy("rel_path").agg(F.count("*").alias("points"))


def evidence_paths(spark, d):
    li = load(spark, d, "lineitem")
    evidences = li.select(F.concat_ws("-", "l_partkey", "l_suppkey").alias("relation"), F.col("l_orderkey").alias("unit_id"))
    contributes = load(spark, d, "orders").select(F.col("o_orderkey").alias("unit_id"), F.explode(F.array(F.col("o_custkey"), F.col("o_orderkey") % 50)).alias("point_id"))
    return W.evidence_path(evidences, contributes).groupBy("relation").agg(F.count("*").alias("points"))


def subjects_of_facts(spark, d):
    has = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("fact_id"), F.concat(F.lit("p"), "l_partkey").alias("key"))
    return W.fact_subjects(has, nodes(spark, d))


def _entities(spark, d):
    return load(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("key"), F.concat(F.substring_index("p_name", " ", -1), F.lit("-"), F.col("p_partkey") % 97).alias("title"), F.when(F.col("p_partkey") % 3 == 0, F.concat("p_brand", F.lit("x"), F.col("p_partkey") % 11)).alias("alias"), F.concat(F.lit("erp:"), "p_partkey").alias("external"), F.col("p_retailprice").alias("rank"), (F.col("p_partkey") % 41 == 0).alias("boilerplate"))


def _named_questions(spark, d):
    e = _entities(spark, d).where("substring(key, 2) % 9 = 4")
    return e.select(F.substring("key", 2, 20).cast("long").alias("question_id"), F.concat(F.lit("What do "), "title", F.lit(" and "), F.coalesce("alias", F.lit("erp:17")), F.lit(" share?")).alias("question"))


def seed_tokens(spark, d):
    relations = edges(spark, d).join(_entities(spark, d).select(F.col("key").alias("source"), F.col("title").alias("source_title")), "source").select(F.concat_ws("-", "source", "target").alias("relation"), "source_title", F.col("target").alias("target_title"))
    return W.lexical_seeds(_named_questions(spark, d), _entities(spark, d), relations).groupBy("question_id", "kind", "score").agg(F.count("*").alias("n"))


def seed_facts(spark, d):
    k = F.col("p_partkey")
    qs = load(spark, d, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("question_id"), F.concat(F.lit("size or L of red "), F.col("c_custkey") % 50, F.lit("?")).alias("question"), F.when(F.col("c_custkey") % 20 == 0, F.struct(F.lit("1995").alias("from"), F.lit("1997").alias("to"))).alias("window"))
    own = load(spark, d, "part").select(k.alias("fact_id"), F.col("p_name").alias("subject"), picked(k, 2, F.lit("size"), F.lit("weight")).alias("property"), picked(k, 3, F.lit("L"), F.lit("W"), F.lit("")).alias("symbol"), F.col("p_size").cast("string").alias("value"), (1990 + k % 10).cast("string").alias("axis"))
    lanes = qs.select("question_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i")).select("question_id", ((F.col("question_id") + F.col("i") * 3) % 100).alias("fact_id"), picked(F.col("i"), 3, F.lit("text"), F.lit("property"), F.lit("value")).alias("lane"), ((F.col("i") + 4) / 10).alias("score"))
    return W.fact_seeds(qs, own, lanes, 5)


def seed_pages(spark, d):
    pages = load(spark, d, "part").select(F.col("p_partkey").alias("page_id"), F.concat_ws(" ", "p_name", "p_brand", "p_size").alias("text"))
    qs = load(spark, d, "supplier").select(F.col("s_suppkey").alias("question_id"), F.concat(F.lit("the red bolt of size "), F.col("s_suppkey") % 50).alias("question"))
    dense = load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("question_id"), F.col("l_partkey").alias("page_id")).agg(F.max("l_discount").alias("score"))
    return W.page_seeds(qs, pages, dense)


def named_in_questions(spark, d):
    return W.named_entities(_named_questions(spark, d), _entities(spark, d))


def entity_resolve(spark, d):
    e = _entities(spark, d)
    wanted = e.where("substring(key, 2) % 5 = 0").select(F.upper("title").alias("wanted")).unionByName(e.where("substring(key, 2) % 7 = 0").select(F.substring("key", 2, 20).alias("wanted"))).distinct()
    return W.resolved(wanted, e)


def fact_evidence(spark, d):
    own = load(spark, d, "part").select(F.col("p_partkey").alias("fact_id"), (F.col("p_partkey") % 120).alias("unit_id"), F.element_at(F.array(*map(F.lit, ("the", "ion", "qzx"))), (F.col("p_partkey") % 3 + 1).cast("int")).alias("value"))
    return W.located_facts(own, points(spark, d).withColumn("unit_id", F.col("doc_id") % 120).where("doc_id < 120"))


def graph_preview(spark, d):
    own = nodes(spark, d).withColumn("frequency", F.length("title")).withColumn("boilerplate", F.col("key").isin("s1", "p3"))
    return W.preview(own, edges(spark, d), 60).select("source", "target", "weight")


def neighbour_previews(spark, d):
    k = F.col("p_partkey")
    subjects = load(spark, d, "part").select((k % 30).alias("question_id"), F.concat(F.lit("p"), k).alias("key"), (k % 4 == 0).alias("named"), F.col("p_retailprice").alias("score"), (k % 5 == 0).alias("ambiguous"))
    return W.neighbourhoods(subjects, edges(spark, d)).select("question_id", "key", "other", "weight", "place")


def relation_kinds(spark, d):
    rows = load(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("source"), F.concat(F.lit("s"), "l_suppkey").alias("target"), F.col("l_returnflag").alias("predicate"))
    return W.predicate_kinds(rows)


def property_counts(spark, d):
    rows = load(spark, d, "lineitem").join(load(spark, d, "part"), F.expr("l_partkey = p_partkey")).select(F.col("p_name").alias("concept"), F.lower("p_brand").alias("concept_key"))
    return W.property_summary(rows)


def rank_stats(spark, d):
    mentions = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("point_id"), F.col("l_linenumber").alias("count"))
    return W.ranking_stats(_entities(spark, d), mentions)


def owner_points(spark, d):
    """Paths order like their numbers whatever their length, and the first point is the one of the least number."""
    rows = load(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("owner"), F.concat(F.lit("f"), F.lpad(F.col("l_partkey").cast("string"), 19, "0")).alias("rel_path"), F.col("l_orderkey").alias("point_id"))
    return W.source_points(rows).select("owner", F.concat(F.lit("o"), F.lpad(F.col("point_id").cast("string"), 8, "0")).alias("point_id"))


def vector_pairs(spark, d):
    """Vectors of one label within twenty ids of each other, by cosine."""
    v = load(spark, d, "embeddings").where("embedding is not null and label is not null").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"), F.col("label").alias("type"))
    pairs = v.select(F.col("key").alias("a"), F.explode(F.sequence(F.col("key") + 1, F.col("key") + 20)).alias("b"))
    return W.vector_neighbours(v, pairs, 0.2)


def subject_buckets(spark, d):
    own = load(spark, d, "part").select((F.col("p_partkey") % 40).alias("question_id"), F.col("p_partkey").alias("point_id"), F.concat_ws(" ", "p_name", "p_brand").alias("text"))
    k = F.col("id")
    subjects = spark.range(40).select(k.alias("question_id"), F.explode(F.when(k % 4 == 3, F.array(F.lit("Bolt"))).otherwise(F.array(F.lit("Red"), F.lit("bolt"), F.lit("red bolt"), F.lit("ring")))).alias("subject"))
    return W.bucketed(own, subjects).groupBy("question_id", "bucket").agg(F.count("*").alias("n"))


def dual_ranks(spark, d):
    lanes = load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("question_id"), F.col("l_partkey").alias("point_id"), F.col("l_returnflag").alias("lane")).agg(F.max("l_extendedprice").alias("score"), F.round(1 - F.max("l_tax"), 2).alias("margin"))
    return W.dual_rank(lanes)


def discovery_budget(spark, d):
    k = F.col("p_partkey")
    rows = load(spark, d, "part").select((k % 50).alias("question_id"), picked(k, 3, F.lit("specs"), F.lit("relationships"), F.lit("pages")).alias("kind"), (k % 3).alias("kind_order"), F.floor(k / 50).alias("n"), F.repeat(F.lit("word"), (F.col("p_size") * 2).cast("int")).alias("text"))
    return W.budgeted_records(rows, 120)


def pick_redundancy(spark, d):
    rows = load(spark, d, "part").select((F.col("p_partkey") % 30).alias("question_id"), F.col("p_partkey").alias("point_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))
    return W.redundancy(rows)


def relation_scores(spark, d):
    v = load(spark, d, "embeddings")
    q = v.where("vec_id = 3").select("embedding").head(1)
    rows = v.select(F.col("vec_id").alias("relation"), F.col("embedding").alias("vector"))
    return W.relation_cosines(rows.where("relation % 2 = 0").select("relation"), rows, list(q[0][0]) if q else [])


def candidate_scores(spark, d):
    """Second-stage scores of candidates from their cosine, lexical overlap and place in the graph's order."""
    qs = questions(spark, d)
    rows = chunks(spark, d).where("chunk_index = 0").select("doc_id", (F.col("doc_id") % 20).alias("question_id"), F.substring("text", 1, 80).alias("text")).join(qs, "question_id")
    score = C.second_stage(F.col("doc_id") % 10 / 10, C.lexical_overlap("question", "text"), F.col("doc_id") % 60)
    return rows.select("question_id", "doc_id", F.round(score, 6).alias("score"))


def mention_weights(spark, d):
    li = load(spark, d, "lineitem")
    rows = li.groupBy(F.col("l_partkey").alias("entity"), F.col("l_suppkey").alias("chunk")).agg(F.count("*").alias("n"))
    df = rows.groupBy("entity").agg(F.count("*").alias("df"))
    total = li.agg(F.count_distinct("l_suppkey").alias("chunks"))
    rows = rows.join(df, "entity").crossJoin(F.broadcast(total))
    return rows.select("entity", "chunk", F.round(C.mention_weight(F.lit(0.8), F.col("n"), F.col("df"), F.col("chunks")), 6).alias("mention"), F.round(C.evidence_weight(F.lit(0.8), F.col("df"), F.col("chunks"), F.col("chunk") % 4 == 0), 6).alias("evidence"))


def excluded_paths(spark, d):
    status = load(spark, d, "documents").where("doc_id % 3 <> 0").select("doc_id", picked(F.col("doc_id"), 4, F.lit("current"), F.lit("archived"), F.lit("superseded"), F.lit("draft")).alias("status"))
    return W.excluded(files(spark, d), status, F.col("status").isin("current", "draft"))


def payload_lookup(spark, d):
    rows = points(spark, d).withColumn("active", F.col("doc_id") % 8 != 1)
    wanted = rows.where("chunk_index % 3 = 0").select("point_id").unionByName(rows.where("chunk_index = 0").select("point_id"))
    return W.looked_up(wanted, rows).groupBy("kb_id").agg(F.count("*").alias("points"), F.sum(F.length("text")).alias("chars"))


def library_catalogue(spark, d):
    own = chunks(spark, d).join(load(spark, d, "documents").select("doc_id", rel_path().alias("rel_path")), "doc_id")
    entities = load(spark, d, "supplier").select(F.concat(F.lit("src"), F.col("s_suppkey") % 7).alias("kb_id"))
    return W.catalogue(own, entities)


def visual_topk(spark, d):
    """The visual lane: the same search over the vectors that are there, twenty at most."""
    v = load(spark, d, "embeddings").select(F.col("vec_id").alias("point_id"), F.when(F.col("vec_id") % 3 == 0, F.col("embedding")).alias("visual"))
    q = v.where("point_id = 9").select("visual").head(1)
    return recall.dense(v, list(q[0][0]) if q and q[0][0] else [], 20, vector="visual")


def mention_hubs(spark, d):
    li = load(spark, d, "lineitem")
    own = li.groupBy(F.col("l_partkey").alias("key"), F.col("l_orderkey").alias("point_id")).agg(F.sum("l_linenumber").alias("count"))
    return W.mentions(own, li.where("l_linenumber <= 3").select(F.col("l_orderkey").alias("point_id")))


def fact_rows(spark, d):
    """Facts of each supplier as rows of an answer: numbered sources, and whether their chunk is active still."""
    k = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    rows = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("question_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact_id"), (F.col("l_orderkey") % 30).alias("doc_id"), (F.col("l_orderkey") % 7 > 0).alias("active"), F.row_number().over(k).cast("long").alias("place"))
    return fusion.numbered_sources(rows.where("place <= 40")).select("question_id", "fact_id", "place", "source_no", "active")


QUERIES = {f.__name__: f for f in (
    mention_hubs, fact_rows, input_drift, repair_candidates, orphan_versions, cancelled_jobs, claimable_jobs, lease_beats, soft_delete, metadata_fingerprints, folder_enrolment, due_jobs, corpus_snapshots, phase_resume, replayed_decisions, supported_definitions,
    run_comparison, structured_evaluation, path_checks, set_sample, active_chunk_refs, evidence_paths, subjects_of_facts, seed_tokens, seed_facts, seed_pages, named_in_questions, entity_resolve, fact_evidence, graph_preview,
    neighbour_previews, relation_kinds, property_counts, rank_stats, owner_points, vector_pairs, subject_buckets, dual_ranks, discovery_budget, pick_redundancy, relation_scores, candidate_scores, mention_weights, excluded_paths,
    payload_lookup, library_catalogue, visual_topk,
)}

LEDGER = f"""{CHUNKS}, {POINTS}, ledger AS (SELECT point_id, doc_id AS file_id, CASE WHEN doc_id % 8 = 1 THEN 'retired' ELSE 'active' END AS status FROM points),
  drift AS (SELECT point_id, doc_id % 9 = 2 AS missing, doc_id % 9 = 5 AS version_mismatch, doc_id % 9 = 4 AS text_mismatch FROM points)"""
ENTITIES = """entities AS (SELECT p_partkey AS k, 'p' || p_partkey AS key, string_split(p_name, ' ')[2] || '-' || (p_partkey % 97) AS title, CASE WHEN p_partkey % 3 = 0 THEN p_brand || 'x' || (p_partkey % 11) END AS alias, 'erp:' || p_partkey AS external, p_retailprice AS rank, p_partkey % 41 = 0 AS boilerplate FROM part),
  asked AS (SELECT k AS question_id, title, coalesce(alias, 'erp:17') AS other FROM entities WHERE k % 9 = 4)"""
CANON = "lower(regexp_replace(regexp_replace(regexp_replace({0}, '([0-9])[ _./#-]+([0-9])', '\\1~\\2', 'g'), '[ _./#-]+', '', 'g'), '~', '-', 'g'))"
VECTORS = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::double) AS e FROM embeddings WHERE embedding IS NOT NULL)"

SQL = {
    "mention_hubs": """WITH m AS (SELECT l_partkey AS key, l_orderkey AS point_id, sum(l_linenumber)::bigint AS count FROM lineitem GROUP BY ALL), h AS (SELECT l_orderkey, count(*) AS hub FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1)
        SELECT key, point_id, count, coalesce(hub, 0) AS hub FROM m LEFT JOIN h ON l_orderkey = point_id""",
    "fact_rows": """WITH r AS (SELECT l_suppkey AS q, l_orderkey * 10 + l_linenumber AS f, l_orderkey % 30 AS doc, l_orderkey % 7 > 0 AS active, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS place FROM lineitem QUALIFY place <= 40),
        o AS (SELECT *, min(place) OVER (PARTITION BY q, doc) AS first FROM r) SELECT q AS question_id, f AS fact_id, place, dense_rank() OVER (PARTITION BY q ORDER BY first) AS source_no, active FROM o""",
    "input_drift": f"WITH {LEDGER} SELECT count_if(missing)::bigint AS missing, count_if(version_mismatch)::bigint AS version_mismatch, count_if(text_mismatch)::bigint AS text_mismatch FROM drift",
    "repair_candidates": f"""WITH {LEDGER} SELECT DISTINCT file_id FROM ledger JOIN drift USING (point_id) WHERE status = 'active' AND (missing OR text_mismatch) AND file_id % 5 <> 4 AND file_id % 7 <> 0 AND file_id % 10 <> 6""",
    "orphan_versions": "SELECT o_orderkey AS version FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AND o_orderdate < TIMESTAMP '2000-01-01'",
    "cancelled_jobs": f"""WITH {JOBS} SELECT CASE WHEN job_id % 3 = 0 THEN 'delete' ELSE 'parse' END AS kind, CASE WHEN job_id % 400 % 3 = 1 AND status = 'queued' AND job_id % 3 <> 0 THEN 'cancelled' ELSE status END AS status, count(*) AS n FROM jobs GROUP BY ALL""",
    "claimable_jobs": f"WITH {JOBS} SELECT kb_id, status = 'running' AS taken_over, count(*) AS n FROM jobs WHERE status = 'queued' AND run_after <= {NOW} OR status = 'running' AND lease_until < {NOW} GROUP BY ALL",
    "lease_beats": f"""WITH {JOBS}, b AS (SELECT event_id + 1 AS job_id, (epoch_us(ts) // 1000000) + 1000 AS at_ FROM events WHERE event_id % 2 = 0),
        x AS (SELECT status, created_at, CASE WHEN status = 'running' AND at_ IS NOT NULL THEN greatest(lease_until, at_ + 600) ELSE lease_until END AS l FROM jobs LEFT JOIN b USING (job_id)) SELECT status, sum(l - created_at)::bigint AS lease, count(*) AS n FROM x GROUP BY status""",
    "soft_delete": f"""WITH {CHUNKS}, x AS (SELECT chunk_index % 4 <> 0 AS before, doc_id % 3 = 0 AS gone, doc_id % 6 = 0 AS back FROM chunks)
        SELECT before AND (NOT gone OR back) AS active, CASE WHEN NOT before THEN 5 WHEN gone AND NOT back THEN 77 END::int AS inactive_at, count(*) AS n FROM x GROUP BY ALL""",
    "metadata_fingerprints": f"""SELECT doc_id, sha256('{{"filename":"' || doc_id || '.txt","rel_path":"' || {PATH} || CASE WHEN doc_id % 4 <> 0 THEN '","size":' || n_chars || '}}' ELSE '"}}' END) AS fingerprint FROM documents""",
    "folder_enrolment": f"""WITH f AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'new-' ELSE 'renamed-' END || source AS folder, CASE WHEN doc_id % 2 = 0 AND doc_id % 6 > 0 THEN sha256({PATH}) ELSE sha256(text) END AS c FROM documents), u AS (SELECT DISTINCT * FROM f),
        k AS (SELECT DISTINCT source AS kb_id, sha256(text) AS c FROM documents WHERE doc_id % 5 < 3), n AS (SELECT folder, count(*) AS n FROM u GROUP BY 1), m0 AS (SELECT folder, kb_id, count(*) AS m FROM u JOIN k USING (c) GROUP BY ALL), m AS (SELECT * FROM m0 QUALIFY row_number() OVER (PARTITION BY folder ORDER BY m DESC, kb_id DESC) = 1)
        SELECT folder, CASE WHEN round(m / n, 4) >= 0.5 THEN kb_id END AS kb_id, round(coalesce(m, 0) / n, 4) AS ratio FROM n LEFT JOIN m USING (folder)""",
    "due_jobs": "SELECT * FROM (VALUES ('scan', true), ('worker', true), ('graph', false), ('gc', true), ('cache', false), ('logs', true)) v(job, due)",
    "corpus_snapshots": f"WITH {CHUNKS} SELECT DISTINCT kb_id, kb_id <> 'src1' AS same FROM chunks",
    "phase_resume": "SELECT c_mktsegment, count(*) AS n, count(*) AS again, count(*) * 3 AS changed FROM customer GROUP BY 1",
    "replayed_decisions": """WITH p AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b, l_returnflag AS c FROM lineitem), j AS (SELECT DISTINCT least(a, b) AS x, greatest(a, b) AS y, CASE WHEN a % 4 = 0 THEN 'Z' ELSE c END AS c FROM p WHERE (a + b) % 3 = 0)
        SELECT CASE WHEN j.x IS NOT NULL THEN 'same' ELSE 'open' END AS verdict, count(*) AS n FROM p LEFT JOIN j ON j.x = least(a, b) AND j.y = greatest(a, b) AND j.c = p.c GROUP BY 1""",
    "supported_definitions": "SELECT DISTINCT p_name AS name FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_orderkey % 150 = 7 AND l_orderkey IN (SELECT o_orderkey FROM orders)",
    "run_comparison": """WITH a AS (SELECT 'm' || (l_suppkey % 20) AS metric, round(avg(l_tax), 4) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT 'm' || (l_suppkey % 20 + 5) AS metric, round(avg(l_tax), 4) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
        SELECT coalesce(a.metric, b.metric) AS metric, a.v AS current, b.v AS previous, round(a.v - b.v, 3) + 0.0::double AS delta FROM a FULL JOIN b ON a.metric = b.metric""",
    "structured_evaluation": """WITH o AS (SELECT c_custkey, coalesce(bool_or(o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'), false) AS one, coalesce(bool_or(o_orderstatus = 'O'), false) AS two, coalesce(bool_or(o_orderpriority = '5-LOW'), false) AS bad FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
        SELECT c_custkey::varchar AS item_id, 'required_facts' AS rule, (one::int + two::int)::bigint AS passed, 2::bigint AS total FROM o UNION ALL SELECT c_custkey::varchar, 'forbidden_facts', (NOT bad)::bigint, 1::bigint FROM o""",
    "path_checks": """WITH h AS (SELECT DISTINCT l_orderkey % 90 AS a, l_partkey % 90 AS b FROM lineitem), f AS (SELECT DISTINCT l_partkey % 90 AS a, l_suppkey % 40 AS b FROM lineitem)
        SELECT i AS path_id, (i % 90, i * 7 % 90) IN (SELECT (a, b) FROM h) AND (i * 7 % 90, i * 3 % 40) IN (SELECT (a, b) FROM f) AS holds FROM range(500) r(i)""",
    "set_sample": f"WITH {CHUNKS}, {POINTS} SELECT point_id, length(text) AS chars FROM points WHERE length(text) >= 60 ORDER BY sha256('7:' || point_id) LIMIT 40",
    "active_chunk_refs": f"WITH {CHUNKS} SELECT {PATH} AS rel_path, count(*) AS points FROM chunks JOIN documents USING (doc_id) WHERE doc_id % 8 <> 1 GROUP BY 1",
    "evidence_paths": """WITH c AS (SELECT o_orderkey AS u, unnest([o_custkey, o_orderkey % 50]) AS p FROM orders) SELECT l_partkey || '-' || l_suppkey AS relation, count(DISTINCT p) AS points FROM lineitem JOIN c ON u = l_orderkey GROUP BY 1""",
    "subjects_of_facts": "SELECT l_orderkey AS fact_id, array_to_string(list_sort(list(DISTINCT p_name)), ', ') AS subjects FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1",
    "seed_tokens": f"""WITH {EDGES}, {ENTITIES}, t AS (SELECT DISTINCT question_id, {CANON.format("x")} AS token FROM (SELECT question_id, unnest(['what', 'do', lower(title), 'and', lower(other), 'share']) AS x FROM asked)),
        n AS (SELECT 'entity' AS kind, key, {CANON.format("name")} AS token, score FROM (SELECT key, unnest([title, alias, external]) AS name, unnest([0.85::double, 0.8::double, 0.8::double]) AS score FROM entities) WHERE name IS NOT NULL
          UNION ALL SELECT DISTINCT 'relation', source || '-' || target, {CANON.format("x")}, 0.8::double FROM (SELECT source, target, unnest([e.title, target]) AS x FROM edges JOIN entities e ON e.key = source)),
        h0 AS (SELECT question_id, token, kind, key, max(score) AS score FROM t JOIN n USING (token) GROUP BY ALL), h AS (SELECT * FROM h0 QUALIFY row_number() OVER (PARTITION BY question_id, token, kind ORDER BY score DESC, key) <= 5),
        b AS (SELECT question_id, kind, key, max(score) AS score FROM h GROUP BY ALL) SELECT question_id, kind, score, count(*) AS n FROM b GROUP BY ALL""",
    "seed_facts": """WITH q AS (SELECT c_custkey AS question_id, ['size', 'or', 'of', 'red'] || CASE WHEN c_custkey % 50 > 9 THEN [(c_custkey % 50)::varchar] ELSE [] END AS w, CASE WHEN c_custkey % 20 = 0 THEN true END AS win FROM customer WHERE c_custkey % 10 = 0),
        f AS (SELECT p_partkey AS fact_id, p_name AS subject, CASE p_partkey % 2 WHEN 0 THEN 'size' ELSE 'weight' END AS property, CASE p_partkey % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'W' ELSE '' END AS symbol, p_size::varchar AS value, (1990 + p_partkey % 10) AS axis FROM part),
        l AS (SELECT question_id, (question_id + i * 3) % 100 AS fact_id, (i + 4) / 10 AS score FROM q, range(6) r(i)), x AS (SELECT question_id, fact_id, max(score) AS score FROM l GROUP BY ALL UNION ALL SELECT question_id, fact_id, 0.85 FROM q, f WHERE property = 'size'),
        b AS (SELECT question_id, fact_id, max(score) AS score FROM x GROUP BY ALL),
        s AS (SELECT question_id, fact_id, subject, property, symbol, value, axis, round((score + 0.05 * len(list_intersect(w, list_filter(string_split(subject, ' ') || [property, value], lambda z: length(z) >= 2)))) * CASE WHEN win IS NULL THEN 1.0 WHEN axis BETWEEN 1995 AND 1997 THEN 1.1 ELSE 0.8 END, 6) AS score
          FROM b JOIN f USING (fact_id) JOIN q USING (question_id)), u AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY question_id, subject, property, symbol, value, axis ORDER BY score DESC, fact_id) = 1)
        SELECT question_id, fact_id, score::double AS score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, fact_id) AS place FROM u QUALIFY place <= 5""",
    "seed_pages": """WITH dn AS (SELECT l_suppkey AS question_id, l_partkey AS page_id, max(l_discount) AS score FROM lineitem GROUP BY ALL), q AS (SELECT s_suppkey AS question_id, ['the', 'red', 'bolt', 'of', 'size'] || CASE WHEN s_suppkey % 50 > 9 THEN [(s_suppkey % 50)::varchar] ELSE [] END AS w FROM supplier),
        s AS (SELECT question_id, page_id, round(score + 0.1 * 2.0 * len(list_intersect(w, list_distinct(string_split(p_name, ' ') || [p_size::varchar]))) / len(w), 6) AS score FROM dn JOIN q USING (question_id) JOIN part ON p_partkey = page_id)
        SELECT question_id, page_id, score FROM s QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, page_id) <= 6""",
    "named_in_questions": f"""WITH {ENTITIES}, n AS (SELECT DISTINCT key, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS name FROM (SELECT key, unnest([title, alias]) AS name FROM entities) WHERE name IS NOT NULL),
        a AS (SELECT DISTINCT question_id, regexp_replace(lower(x), '[^a-z0-9]+', '', 'g') AS name FROM (SELECT question_id, unnest([title, CASE WHEN other NOT LIKE 'erp%' THEN other END]) AS x FROM asked) WHERE x IS NOT NULL)
        SELECT question_id, name, key, count(*) OVER (PARTITION BY question_id, name) > 1 AS ambiguous FROM a JOIN n USING (name)""",
    "entity_resolve": f"""WITH {ENTITIES}, w AS (SELECT upper(title) AS wanted FROM entities WHERE k % 5 = 0 UNION SELECT k::varchar FROM entities WHERE k % 7 = 0), n AS (SELECT DISTINCT key, rank, unnest([lower(title), lower(alias), external, k::varchar]) AS name FROM entities WHERE NOT boilerplate),
        h AS (SELECT DISTINCT wanted, key, rank FROM w JOIN n ON name = lower(wanted)) SELECT wanted, key, row_number() OVER (PARTITION BY wanted ORDER BY rank DESC, key) AS place, count(*) OVER (PARTITION BY wanted) > 1 AS ambiguous FROM h QUALIFY place <= 10""",
    "fact_evidence": f"""WITH {CHUNKS}, {POINTS}, f AS (SELECT p_partkey AS fact_id, p_partkey % 120 AS u, CASE p_partkey % 3 WHEN 0 THEN 'the' WHEN 1 THEN 'ion' ELSE 'qzx' END AS value FROM part),
        x AS (SELECT fact_id, point_id, chunk_index, contains(text, value) AS l FROM f JOIN points ON doc_id = u) SELECT fact_id, point_id, l AS located FROM x QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY NOT l, chunk_index) = 1""",
    "graph_preview": f"""WITH {EDGES}, n AS (SELECT 'p' || p_partkey AS key, length(p_name) AS f FROM part UNION ALL SELECT 's' || s_suppkey, length(s_name) FROM supplier), g AS (SELECT key, count(*) AS g FROM (SELECT source AS key FROM edges UNION ALL SELECT target FROM edges) GROUP BY key),
        c AS (SELECT n.key FROM n LEFT JOIN g USING (key) WHERE n.key NOT IN ('s1', 'p3') ORDER BY coalesce(g, 0) DESC, f DESC, n.key LIMIT 60) SELECT source, target, weight FROM edges WHERE source IN (SELECT key FROM c) AND target IN (SELECT key FROM c)""",
    "neighbour_previews": f"""WITH {EDGES}, s AS (SELECT p_partkey % 30 AS question_id, 'p' || p_partkey AS key, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_partkey % 30 ORDER BY p_partkey % 4 = 0 DESC, p_retailprice DESC, 'p' || p_partkey) <= 4)
        SELECT question_id, key, target AS other, weight, row_number() OVER (PARTITION BY question_id, key ORDER BY weight DESC, target) AS place FROM s JOIN edges ON source = key WHERE p_partkey % 5 <> 0 QUALIFY place <= 8""",
    "relation_kinds": "SELECT 'p' || l_partkey AS key, 'out' AS direction, l_returnflag AS predicate, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT 's' || l_suppkey, 'in', l_returnflag, count(*) FROM lineitem GROUP BY ALL",
    "property_counts": "SELECT p_name AS concept, lower(p_brand) AS concept_key, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL ORDER BY n DESC, concept_key, concept LIMIT 50",
    "rank_stats": "SELECT (SELECT max(p_retailprice) FROM part) AS max_rank, count(DISTINCT l_orderkey) AS chunks, sum(l_linenumber)::bigint AS mentions FROM lineitem",
    "owner_points": """WITH p AS (SELECT 's' || l_suppkey AS owner, l_partkey AS f, min(l_orderkey) AS o FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY f) - 1 AS i, count(*) OVER (PARTITION BY owner) AS n FROM p)
        SELECT owner, 'o' || lpad(o::varchar, 8, '0') AS point_id FROM r WHERE n <= 16 OR len(list_filter(range(0, 16), lambda x: (x * n) // 16 = i)) > 0""",
    "vector_pairs": f"""WITH {VECTORS} SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS cosine FROM v a JOIN v b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 20 AND a.label = b.label WHERE round(list_cosine_similarity(a.e, b.e), 6) >= 0.2
        QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 6) DESC, b.vec_id) <= 3""",
    "subject_buckets": """SELECT p_partkey % 40 AS question_id, CASE WHEN p_partkey % 4 <> 3 THEN CASE WHEN contains(p_name, 'red bolt') THEN 'red bolt' WHEN contains(p_name, 'ring') THEN 'ring' END END AS bucket, count(*) AS n FROM part GROUP BY ALL""",
    "dual_ranks": """WITH l AS (SELECT l_suppkey AS question_id, l_partkey AS point_id, l_returnflag AS lane, max(l_extendedprice) AS score, round(1 - max(l_tax), 2) AS margin FROM lineitem GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY question_id, lane ORDER BY score DESC, point_id) AS rank FROM l) SELECT question_id, point_id, max(round(61 / (60 + rank) * margin, 9)) AS score FROM r GROUP BY ALL""",
    "discovery_budget": """WITH RECURSIVE r AS (SELECT p_partkey % 50 AS question_id, CASE p_partkey % 3 WHEN 0 THEN 'specs' WHEN 1 THEN 'relationships' ELSE 'pages' END AS kind, p_partkey // 50 AS n, greatest(1, 2 * p_size) AS cost, row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY p_partkey // 50, p_partkey % 3, p_partkey) AS i FROM part),
        b AS (SELECT question_id, kind, n, i, cost <= 120 AS admitted, CASE WHEN cost <= 120 THEN cost ELSE 0 END AS used FROM r WHERE i = 1 UNION ALL SELECT r.question_id, r.kind, r.n, r.i, used + cost <= 120, CASE WHEN used + cost <= 120 THEN used + cost ELSE used END FROM b JOIN r ON r.question_id = b.question_id AND r.i = b.i + 1)
        SELECT question_id, kind, n, admitted FROM b""",
    "pick_redundancy": r"""WITH t AS (SELECT p_partkey % 30 AS q, p_partkey AS p, list_distinct(string_split(p_name, ' ') || [lower(p_type), 'brand', regexp_extract(p_brand, '\d+')]) AS t FROM part)
        SELECT a.q AS question_id, round(avg(len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t))), 4) AS redundancy FROM t a JOIN t b ON a.q = b.q AND a.p < b.p GROUP BY 1""",
    "relation_scores": f"WITH {VECTORS} SELECT vec_id AS relation, round(list_cosine_similarity(e, (SELECT e FROM v WHERE vec_id = 3)), 6) AS cosine FROM v WHERE vec_id % 2 = 0",
    "candidate_scores": f"""WITH {CHUNKS}, {QUESTIONS}, x AS (SELECT question_id, doc_id, list_distinct(list_filter(regexp_extract_all(lower(question), '[a-z0-9_#]+(?:[\\[\\]:./+-][a-z0-9_#]+)*'), lambda z: length(z) >= 2)) AS q,
          list_distinct(list_filter(regexp_extract_all(lower(substr(text, 1, 80)), '[a-z0-9_#]+(?:[\\[\\]:./+-][a-z0-9_#]+)*'), lambda z: length(z) >= 2)) AS t FROM chunks JOIN questions ON question_id = doc_id % 20 WHERE chunk_index = 0)
        SELECT question_id, doc_id, round(doc_id % 10 / 10 + 0.3 * CASE WHEN len(q) = 0 THEN 0 ELSE 2.0 * len(list_intersect(q, t)) / len(q) END + 0.5 / (10.0 + greatest(1, doc_id % 60)), 6) AS score FROM x""",
    "mention_weights": """WITH r AS (SELECT l_partkey AS entity, l_suppkey AS chunk, count(*) AS n FROM lineitem GROUP BY ALL), x AS (SELECT *, count(*) OVER (PARTITION BY entity) AS df, (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS c FROM r)
        SELECT entity, chunk, round(0.8 * ln(1 + c / df) * (1 + ln(1 + n)), 6) AS mention, round(0.8 * ln(1 + c / df) * CASE WHEN chunk % 4 = 0 THEN 1.25 ELSE 1.0 END, 6) AS evidence FROM x""",
    "excluded_paths": f"SELECT {PATH} AS rel_path FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 4 IN (1, 2)",
    "payload_lookup": f"WITH {CHUNKS} SELECT kb_id, count(*) AS points, sum(length(text))::bigint AS chars FROM chunks WHERE doc_id % 8 <> 1 AND chunk_index % 3 = 0 GROUP BY kb_id",
    "library_catalogue": f"""WITH {CHUNKS}, p AS (SELECT kb_id, {PATH} AS path, count(*) AS n FROM chunks JOIN documents USING (doc_id) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY kb_id ORDER BY path) AS k FROM p)
        SELECT kb_id, sum(n)::bigint AS chunks, count(*) AS docs, string_agg(CASE WHEN k <= 3 THEN path END, '|' ORDER BY path) AS sample, kb_id IN (SELECT 'src' || (s_suppkey % 7) FROM supplier) AS has_graph FROM r GROUP BY kb_id""",
    "visual_topk": f"WITH {VECTORS} SELECT vec_id AS point_id, round(list_cosine_similarity(e, (SELECT e FROM v WHERE vec_id = 9)), 6) AS score FROM v WHERE vec_id % 3 = 0 ORDER BY score DESC, point_id LIMIT 20",
}
