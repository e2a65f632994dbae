"""Queries over facts, the graph, its endpoints and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmark.functions import facts as V
from quillmark.functions import text as T
from quillmark.operators import facts as FA
from quillmark.operators import graph as G
from quillmark.operators import recall
from quillmark.operators import resolution as R
from quillmark.plans.ingest_queries import CHUNKS, PATH
from quillmark.plans.search_queries import KEYWORD, keyword, located, points
from quillmark.sources.tables import chunks, files, load, rel_path

FACTS = """facts AS (SELECT l_orderkey * 1000000000 + l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS fact_id, 'part-' || l_partkey AS subject, 'discount' AS property, l_linestatus AS conditions,
  '%' AS unit, round(l_discount * 100, 2) AS value_num, l_suppkey AS doc_id, strftime(l_shipdate, '%Y') AS axis, l_shipdate FROM lineitem)"""
GROUP = "subject, property, conditions, unit"
EDGES = "edges AS (SELECT 'p' || l_partkey AS source, 's' || l_suppkey AS target, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL)"
BOTH = "both_ways AS (SELECT source, target, weight FROM edges UNION ALL SELECT target, source, weight FROM edges)"


def facts(spark, d):
    li = load(spark, d, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 1_000_000_000 + F.col("l_linenumber") * 100_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000).alias("fact_id"),
        F.concat(F.lit("part-"), "l_partkey").alias("subject"), F.lit("discount").alias("property"), F.col("l_linestatus").alias("conditions"), F.lit("%").alias("unit"),
        F.round(F.col("l_discount") * 100, 2).alias("value_num"), F.col("l_suppkey").alias("doc_id"), F.date_format("l_shipdate", "yyyy").alias("axis"), "l_shipdate",
    )


def edges(spark, d):
    return load(spark, d, "lineitem").groupBy(F.concat(F.lit("p"), "l_partkey").alias("source"), F.concat(F.lit("s"), "l_suppkey").alias("target")).agg(F.sum("l_quantity").alias("weight"))


def nodes(spark, d):
    parts = load(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("key"), F.col("p_name").alias("title"), F.col("p_type").alias("type"))
    return parts.unionByName(load(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("key"), F.col("s_name").alias("title"), F.lit("SUPPLIER").alias("type")))


def fact_groups(spark, d):
    return FA.comparison_groups(facts(spark, d))


def fact_series(spark, d):
    return FA.series(facts(spark, d)).select("fact_id", "subject", "axis", "series_index", "series_len")


def fact_trend(spark, d):
    return FA.trends(facts(spark, d))


def fact_conflicts(spark, d):
    return FA.conflicts(facts(spark, d)).distinct()


def facts_asof(spark, d):
    rows = facts(spark, d).withColumn("until", F.date_format(F.date_add("l_shipdate", 90), "yyyy-MM")).withColumn("lapses", F.col("doc_id") % 2 == 0)
    day = V.day_of(F.lit("1998-06"))
    return rows.groupBy(V.as_of_status(F.col("axis"), F.col("until"), F.col("lapses"), day).alias("status"), "axis").agg(F.count("*").alias("n"))


def facts_listing(spark, d):
    """Facts of one property in scope, with their series places, the second page of fifty."""
    rows = FA.series(facts(spark, d).where(F.contains("property", F.lit("disc"))))
    rows = rows.where(~V.after(F.col("axis"), V.day_of(F.lit("1999"))))
    return rows.orderBy("subject", "series_index", "fact_id", "value_num").offset(50).limit(50).select("fact_id", "subject", "axis", "series_index", "value_num")


def duplicate_facts(spark, d):
    return FA.distinct_facts(facts(spark, d)).where("mentions > 1").select(*FA.GROUP, "axis", "value_num", "fact_id", "mentions", "docs")


def table_melt(spark, d):
    return FA.melt(load(spark, d, "part"), "p_partkey", ["p_name", "p_brand", "p_type", "p_size"])


def key_columns(spark, d):
    return FA.key_columns(load(spark, d, "supplier"), ["s_suppkey", "s_name", "s_nationkey"])


def fact_values(spark, d):
    text = F.element_at(F.array(*[F.concat(F.lit(a), F.col("p_size").cast("string"), F.lit(b)) for a, b in (("", ""), ("<", " mA"), ("2 to ", " V"), ("V_CC + ", ""), ("n/a ", " x"), ("", "")) ]), (F.col("p_partkey") % 6 + 1).cast("int"))
    rows = load(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 6 == 5, F.lit("")).otherwise(text).alias("value"))
    return rows.select("p_partkey", V.value_kind("value").alias("kind"), V.value_number("value").alias("num"), V.value_comparator("value").alias("cmp"))


def unit_spellings(spark, d):
    unit = F.element_at(F.array(*map(F.lit, (" MHz", "mhz", "mHz", "MW", "mw", "seconds", "furlong", "MMOL/L"))), (F.col("p_partkey") % 8 + 1).cast("int"))
    return load(spark, d, "part").groupBy(V.canonical_unit(unit).alias("unit")).agg(F.count("*").alias("n"))


def document_axis(spark, d):
    head = F.concat_ws(" ", F.lit("report"), F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Rev "), F.col("o_orderkey") % 9, F.lit(".1"))))
    rows = load(spark, d, "orders").select("o_orderkey", head.alias("head"))
    return rows.select("o_orderkey", F.coalesce(F.get(V.dates("head"), F.lit(0)), F.get(V.versions("head"), F.lit(0)), F.lit("")).alias("axis"))


def day_normalise(spark, d):
    rows = load(spark, d, "orders").select(F.substring(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(1), F.element_at(F.array(F.lit(4), F.lit(7), F.lit(10), F.lit(6)), (F.col("o_orderkey") % 4 + 1).cast("int"))).alias("v"))
    return rows.groupBy("v").agg(F.count("*").alias("n"), F.max(V.day_of("v")).alias("day"))


def bound_distance(spark, d):
    low, high = F.lit(5.0), F.when(F.col("p_partkey") % 3 == 0, F.lit(None).cast("double")).otherwise(F.lit(30.0))
    return load(spark, d, "part").select("p_partkey", V.bound_distance(F.col("p_size").cast("double"), low, high).alias("distance"))


def document_status(spark, d):
    """First matching path rule by order, then its window."""
    rules = spark.createDataFrame([(1, "^src1/", "superseded", "0"), (2, "^src[0-9]+/de/", "archived", "0"), (3, "/[0-9]*7\\.txt$", "current", "1999")], "place int, pattern string, status string, since string")
    found = files(spark, d).join(F.broadcast(rules), F.expr("rel_path rlike pattern"), "left")
    return found.groupBy("doc_id").agg(F.coalesce(F.min_by("status", "place"), F.lit("current")).alias("status"))


def overlapping_states(spark, d):
    """Pairs of a customer's orders whose twenty days overlap; stretches of 21 days are the keys."""
    rows = load(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("f"), F.date_add(F.to_date("o_orderdate"), 20).alias("u"))
    return FA.overlapping(rows, "o_orderkey", ["o_custkey"], "f", "u", 21).groupBy("o_custkey").agg(F.count("*").alias("pairs"))


def degree_stats(spark, d):
    return G.degrees(edges(spark, d))


def npmi_weights(spark, d):
    li = load(spark, d, "lineitem")
    e = edges(spark, d)
    mentions = li.select(F.concat(F.lit("p"), "l_partkey").alias("key"), F.col("l_orderkey").alias("unit")).unionByName(li.select(F.concat(F.lit("s"), "l_suppkey").alias("key"), F.col("l_orderkey").alias("unit")))
    n = li.agg(F.countDistinct("l_orderkey").alias("n")).first()[0]
    rows = G.settle(e.join(G.npmi(e, mentions, F.lit(n)), ["source", "target"]), "npmi")
    top = rows.agg(F.max("weight").alias("ms"), F.max("cooccur").alias("mc"))
    return rows.crossJoin(F.broadcast(top)).select("source", "target", "cooccur", "npmi", G.edge_weight(F.col("weight"), F.col("ms"), F.col("cooccur"), F.col("mc"), F.col("npmi")).alias("weight"))


def pagerank(spark, d):
    return G.pagerank(nodes(spark, d), edges(spark, d)).select("key", F.round("rank", 9).alias("rank"))


def pagerank_3(spark, d):
    """Three steps, as many as the SQL unrolls, to check a step; the ranks themselves are those of ``pagerank``."""
    return G.pagerank(nodes(spark, d), edges(spark, d), iterations=3).select("key", F.round("rank", 9).alias("rank"))


def connected_components(spark, d):
    """Documents of equal first lines, or of one source and equal first letters, as a graph."""
    first = load(spark, d, "documents").select("doc_id", F.sha2(F.get(F.split("text", "\n"), F.lit(0)), 256).alias("h"), "source", F.crc32(F.substring("text", 1, 3).cast("binary")).alias("head"))
    star = lambda *key: first.join(first.groupBy(*key).agg(F.min("doc_id").alias("v")), list(key)).select(F.col("doc_id").alias("u"), "v")
    found = G.components(star("h").unionByName(star("source", "head")))
    return first.select("doc_id").join(found.withColumnRenamed("u", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("v", "doc_id").alias("component"))


def one_hop(spark, d):
    return G.one_hop(edges(spark, d), nodes(spark, d).where("key in ('s1', 's7', 'p10')"), 20).select("source", "target", "weight", "place")


def n_hop(spark, d):
    seeds = spark.createDataFrame([("p10", 1.0), ("p11", 0.8)], "key string, score double")
    return G.expand(edges(spark, d), seeds, 2, 5).select("key", F.col("hop").cast("long").alias("hop"), F.round("score", 6).alias("score"))


def type_tree(spark, d):
    nation = load(spark, d, "nation")
    up = nation.join(load(spark, d, "region"), F.expr("n_regionkey = r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("parent"))
    return up.unionByName(load(spark, d, "customer").join(nation, F.expr("c_nationkey = n_nationkey")).select(F.col("c_name").alias("name"), F.col("n_name").alias("parent")))


def type_closure(spark, d):
    return G.closure(type_tree(spark, d), 3).select("name", "ancestor", F.col("distance").cast("long").alias("distance"))


def endpoint_check(spark, d):
    """Edges whose part type is not among the allowed ends."""
    allowed = F.array(*map(F.lit, ("ECONOMY", "SMALL", "*x")))
    rows = edges(spark, d).join(nodes(spark, d).select(F.col("key").alias("source"), "type"), "source")
    return rows.groupBy("type", F.arrays_overlap(F.array("type"), allowed).alias("ok")).agg(F.count("*").alias("edges"))


def variant_edges(spark, d):
    """Titles that are another title, a separator and a short suffix."""
    names = files(spark, d).select(F.col("doc_id").alias("key"), F.concat(F.lit("x"), F.floor(F.col("doc_id") / 4), F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("-"), F.element_at(F.array(F.lit("A"), F.lit("b2"), F.lit("long")), (F.col("doc_id") % 4).cast("int"))))).alias("title"))
    base = names.select(F.col("key").alias("base"), F.lower("title").alias("t"))
    cut = names.withColumn("t", F.lower(F.regexp_extract("title", r"^(.+)[-_ /]([A-Za-z0-9]{1,3})$", 1))).where("t <> ''")
    return cut.join(base, "t").select(F.col("key").alias("variant"), "base")


def mention_counts(spark, d):
    """Word-bounded mentions of each document's entity, its first word, in the chunks of the document: names and tokens
    meet in an equi-join."""
    own = chunks(spark, d)
    names = own.where("chunk_index = 0").select("doc_id", F.get(T.tokens("text"), F.lit(0)).alias("name")).where("length(name) >= 2")
    tokens = own.select("doc_id", "chunk_index", F.explode(T.tokens("text")).alias("name"))
    hits = tokens.join(names, ["doc_id", "name"]).groupBy("name", "doc_id", "chunk_index").agg(F.count("*").alias("n"))
    return hits.groupBy("name", "doc_id").agg(F.sum("n").alias("mentions"), F.count("*").alias("chunks"))


def majority_type(spark, d):
    return G.majority(load(spark, d, "part"), "p_name", "p_type")


def chunk_graph_score(spark, d):
    li = load(spark, d, "lineitem")
    entity = li.select(F.col("l_suppkey").alias("point_id"), F.col("l_tax").alias("weight"))
    evidence = li.select(F.col("l_suppkey").alias("point_id"), F.col("l_discount").alias("weight"))
    hub = li.groupBy(F.col("l_suppkey").alias("point_id")).agg(F.count("*").alias("hub"))
    return G.chunk_scores(entity, evidence, hub.crossJoin(F.broadcast(hub.agg(F.avg("hub").alias("mean_hub")))))


def name_keys(spark, d):
    raw = F.concat(F.lit(' "'), F.col("c_name"), F.lit("  x-1 "), F.col("c_custkey").cast("string"), F.lit('"'))
    return load(spark, d, "customer").select("c_custkey", V.name_key(raw).alias("key"), V.name_ok(raw).alias("ok"), V.canonical_identifier("c_name").alias("canonical"), V.identifier_like("c_name").alias("identifier"))


def similar_names(spark, d):
    """Similar names in the sliding window of forty places of their type, with their bigrams' likeness and edits."""
    entities = load(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_type").alias("type"), F.concat("p_name", F.lit(" "), F.col("p_partkey") % 40).alias("title"))
    pairs = G.sliding_pairs(entities.withColumn("title", R.name_features("title")), ["type"], 40)
    close = pairs.where(R.similar(F.col("ta"), F.col("tb"))).select("a", "b", F.col("ta.title").alias("ta"), F.col("tb.title").alias("tb"))
    return close.select("a", "b", V.dice(F.col("ta"), F.col("tb")).alias("dice"), F.levenshtein("ta", "tb").cast("long").alias("edits"))


def external_id_link(spark, d):
    """Mentions that equal an identifier of exactly one entity."""
    ids = load(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.concat(F.lit("id"), F.col("s_suppkey") % 70).alias("external"))
    unique = ids.withColumn("n", F.count("*").over(Window.partitionBy("external"))).where("n = 1").drop("n")
    mentions = load(spark, d, "events").select("event_id", F.concat(F.lit("id"), F.col("user_id")).alias("external"))
    return mentions.join(unique, "external").select("event_id", "key")


def entity_listing(spark, d):
    rows = nodes(spark, d).join(G.degrees(edges(spark, d)), "key")
    return rows.where("type in ('ECONOMY', 'SMALL')").orderBy(F.desc("degree"), "key").limit(40).select("key", "title", "type", "degree")


def type_facets(spark, d):
    return nodes(spark, d).groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type").limit(100)


def graph_stats(spark, d):
    """Customers by region, nation and segment at several grains."""
    c = load(spark, d, "customer").join(load(spark, d, "nation"), F.expr("c_nationkey = n_nationkey")).join(load(spark, d, "region"), F.expr("n_regionkey = r_regionkey"))
    rows = c.groupingSets([["r_name", "n_name"], ["r_name", "c_mktsegment"], ["r_name"], []], "r_name", "n_name", "c_mktsegment")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean")).select("r_name", "n_name", "c_mktsegment", "n", "mean")


def predicate_health(spark, d):
    """Edges of each status, the share that breaks a rule, and the nearest-rank 95th percentile of the fan-out."""
    li = load(spark, d, "lineitem").select("l_returnflag", "l_suppkey", "l_partkey", "l_tax")
    health = li.groupBy("l_returnflag").agg(F.count("*").alias("edges"), F.round(F.avg((F.col("l_tax") > 0.06).cast("int")), 3).alias("violations"))
    fan = li.groupBy("l_returnflag", "l_suppkey").agg(F.countDistinct("l_partkey").alias("fan"))
    w = Window.partitionBy("l_returnflag")
    ranked = fan.withColumn("at", F.row_number().over(w.orderBy("fan"))).withColumn("n", F.count("*").over(w))
    p95 = ranked.where(F.col("at") == F.ceil(F.col("n") * 0.95)).select("l_returnflag", F.col("fan").alias("fan_p95"))
    return health.join(p95, "l_returnflag")


def graph_compare(spark, d):
    li = load(spark, d, "lineitem")
    old = li.where("l_linenumber <= 5").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    new = li.where("l_linenumber >= 2").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    return G.compare(old, new, ["l_partkey"], F.sha2(F.col("q").cast("long").cast("string"), 256)).groupBy("change").agg(F.count("*").alias("n"))


def bundle_integrity(spark, d):
    return G.dangling(edges(spark, d), nodes(spark, d).where("key not in ('p5', 's3')")).select("source", "target")


def docs_listing(spark, d):
    """Documents of a folder with chunk counts and status, and the folder's totals whatever the page."""
    per = chunks(spark, d).groupBy("doc_id").agg(F.count("*").alias("chunks"))
    rows = files(spark, d).join(per, "doc_id", "left").join(load(spark, d, "labels"), "doc_id", "left").where("kb_id = 'src3'")
    rows = rows.withColumn("total", F.count("*").over(Window.partitionBy("kb_id"))).withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    return rows.orderBy("rel_path").offset(10).limit(20).select("doc_id", "rel_path", "chunks", "quality", "total")


def eval_mrr(spark, d):
    """Rank of the first keyword hit in a document that holds the passage; reciprocal rank and hits at 3, 5, 12."""
    gold = recall.holding(load(spark, d, "documents").select("doc_id", "text"), load(spark, d, "benchmark").select("item_id", F.col("text").alias("passage"))).select("item_id", "doc_id")
    hits = located(spark, d, keyword(spark, d), "doc_id").select(F.col("question_id").alias("item_id"), "doc_id", "rank")
    items = gold.select("item_id").distinct()
    best = hits.join(gold, ["item_id", "doc_id"]).groupBy("item_id").agg(F.min("rank").alias("rank"))
    rows = items.join(best, "item_id", "left").withColumn("rr", F.coalesce(1 / F.col("rank"), F.lit(0.0)))
    at = lambda k: F.sum(F.coalesce((F.col("rank") <= k).cast("long"), F.lit(0))).alias(f"hit_{k}")
    return rows.agg(F.count("*").alias("items"), F.round(F.avg("rr"), 6).alias("mrr"), at(3), at(5), at(12))


def fact_check(spark, d):
    """Expected facts against those present: found, wrong_value or missing."""
    have = facts(spark, d).groupBy("subject", "axis").agg(F.collect_set("value_num").alias("values"))
    gold = load(spark, d, "part").select(F.concat(F.lit("part-"), "p_partkey").alias("subject"), F.lit("1998").alias("axis"), (F.col("p_size") % 11).cast("double").alias("want"))
    rows = gold.join(have, ["subject", "axis"], "left")
    verdict = F.when(F.col("values").isNull(), "missing").when(F.exists("values", lambda v: V.equal_numbers(v, F.col("want"))), "found").otherwise("wrong_value")
    return rows.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    fact_groups, fact_series, fact_trend, fact_conflicts, facts_asof, facts_listing, duplicate_facts, table_melt, key_columns, fact_values, unit_spellings, document_axis, day_normalise, bound_distance,
    document_status, overlapping_states, degree_stats, npmi_weights, pagerank, pagerank_3, connected_components, one_hop, n_hop, type_closure, endpoint_check, variant_edges, mention_counts, majority_type,
    chunk_graph_score, name_keys, similar_names, external_id_link, entity_listing, type_facets, graph_stats, predicate_health, graph_compare, bundle_integrity, docs_listing, eval_mrr, fact_check,
)}

SERIES = f"s AS (SELECT *, dense_rank() OVER (PARTITION BY {GROUP} ORDER BY axis) - 1 AS series_index FROM facts), series AS (SELECT *, max(series_index) OVER (PARTITION BY {GROUP}) + 1 AS series_len FROM s QUALIFY series_len >= 2)"
NODES = "nodes AS (SELECT 'p' || p_partkey AS key, p_name AS title, p_type AS type FROM part UNION ALL SELECT 's' || s_suppkey, s_name, 'SUPPLIER' FROM supplier)"
HOP = """near{k} AS (SELECT b.source, b.target, f.score AS base, row_number() OVER (PARTITION BY b.source ORDER BY weight DESC, b.target) AS place FROM both_ways b JOIN {front} f ON f.key = b.source QUALIFY place <= 5),
  front{k} AS (SELECT target AS key, max(base / (1.0 + {k}) * (0.5 + 0.5 / place) / (1 + ln(1 + greatest(0, degree - 20)))) AS score FROM near{k} JOIN degree ON degree.key = near{k}.target
    WHERE target NOT IN (SELECT key FROM found{j}) GROUP BY target), found{k} AS (SELECT * FROM found{j} UNION ALL SELECT key, {k}, score FROM front{k})"""
STEP = """r{k} AS (SELECT n.key, n.linked, 0.15 / (SELECT count(*) FROM n) + 0.85 * coalesce(g.got, 0) + 0.85 * (SELECT coalesce(sum(rank) FILTER (linked IS NULL), 0) FROM r{j}) / (SELECT count(*) FROM n) AS rank
  FROM n LEFT JOIN (SELECT target AS key, sum(rank * share) AS got FROM shares JOIN r{j} ON r{j}.key = shares.source GROUP BY target) g ON g.key = n.key)"""

SQL = {
    "fact_groups": f"WITH {FACTS} SELECT {GROUP}, count(*) AS facts, count(DISTINCT doc_id) AS docs, count(DISTINCT axis) AS axes FROM facts GROUP BY {GROUP}",
    "fact_series": f"WITH {FACTS}, {SERIES} SELECT fact_id, subject, axis, series_index, series_len FROM series",
    "fact_trend": f"""WITH {FACTS}, p AS (SELECT {GROUP}, axis, count(DISTINCT value_num) AS k, min(value_num) AS value FROM facts GROUP BY ALL),
        q AS (SELECT *, value - lag(value) OVER (PARTITION BY {GROUP} ORDER BY axis) AS step FROM p),
        t AS (SELECT {GROUP}, count(*) AS axes, max(k) AS most, min(step) AS low, max(step) AS high, arg_min(value, axis) AS first_value, arg_max(value, axis) AS last_value FROM q GROUP BY {GROUP})
        SELECT {GROUP}, axes, first_value, last_value, CASE WHEN most > 1 THEN 'mixed' WHEN low > 0 THEN 'up' WHEN high < 0 THEN 'down' WHEN low > -1e-9 AND high < 1e-9 THEN 'flat' ELSE 'mixed' END AS trend FROM t WHERE axes >= 2""",
    "fact_conflicts": f"""WITH RECURSIVE {FACTS}, n AS (SELECT {GROUP}, axis, doc_id, value_num, min(fact_id) AS node FROM facts GROUP BY ALL),
        e AS (SELECT a.node AS u, b.node AS v FROM n a JOIN n b USING ({GROUP}, axis) WHERE a.node <> b.node AND a.doc_id <> b.doc_id AND abs(a.value_num - b.value_num) > greatest(1e-6 * greatest(abs(a.value_num), abs(b.value_num)), 1e-6)),
        reach(u, v) AS (SELECT u, u FROM e UNION SELECT reach.u, e.v FROM reach JOIN e ON reach.v = e.u), c AS (SELECT u, min(v) AS conflict_group FROM reach GROUP BY u)
        SELECT DISTINCT f.fact_id, conflict_group FROM facts f JOIN n USING ({GROUP}, axis, doc_id, value_num) JOIN c ON c.u = n.node""",
    "facts_asof": f"""WITH {FACTS}, t AS (SELECT axis, strftime(l_shipdate + INTERVAL 90 DAY, '%Y-%m') AS until, doc_id % 2 = 0 AS lapses FROM facts)
        SELECT CASE WHEN axis > '1998' THEN 'not_started' WHEN lapses AND until < '1998-06' THEN 'ended' ELSE 'current' END AS status, axis, count(*) AS n FROM t GROUP BY ALL""",
    "facts_listing": f"WITH {FACTS}, {SERIES} SELECT fact_id, subject, axis, series_index, value_num FROM series WHERE property LIKE '%disc%' AND axis <= '1999' ORDER BY subject, series_index, fact_id, value_num LIMIT 50 OFFSET 50",
    "duplicate_facts": f"""WITH {FACTS} SELECT {GROUP}, axis, value_num, min(fact_id) AS fact_id, count(*) AS mentions, array_to_string(list_sort(list(DISTINCT doc_id)), ',') AS docs FROM facts GROUP BY {GROUP}, axis, value_num HAVING count(*) > 1""",
    "table_melt": "SELECT p_partkey::varchar AS subject, property, value FROM (SELECT p_partkey, p_name, p_brand, p_type, p_size::varchar AS p_size FROM part) UNPIVOT (value FOR property IN (p_name, p_brand, p_type, p_size))",
    "key_columns": """SELECT 's_suppkey' AS name, round(count(DISTINCT s_suppkey) / count(*), 4) AS uniqueness, count(DISTINCT s_suppkey) / count(*) >= 0.9 AND max(s_suppkey) - min(s_suppkey) + 1 <> count(*) AS is_key FROM supplier
        UNION ALL SELECT 's_name', round(count(DISTINCT s_name) / count(*), 4), count(DISTINCT s_name) / count(*) >= 0.9 FROM supplier
        UNION ALL SELECT 's_nationkey', round(count(DISTINCT s_nationkey) / count(*), 4), count(DISTINCT s_nationkey) / count(*) >= 0.9 AND max(s_nationkey) - min(s_nationkey) + 1 <> count(*) FROM supplier""",
    "fact_values": """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'scalar' WHEN 1 THEN 'scalar' WHEN 2 THEN 'range' WHEN 3 THEN 'expression' WHEN 4 THEN CASE WHEN regexp_matches('n/a ' || p_size || ' x', '[A-Za-z_]\\s*[-+*/×]|[-+*/×]\\s*[A-Za-z_]') THEN 'expression' ELSE 'text' END ELSE 'empty' END AS kind,
        CASE WHEN p_partkey % 6 < 2 THEN p_size::double END AS num, CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN '<' END AS cmp FROM part""",
    "unit_spellings": "SELECT CASE p_partkey % 8 WHEN 0 THEN 'MHz' WHEN 1 THEN 'mhz' WHEN 2 THEN 'mHz' WHEN 3 THEN 'MW' WHEN 4 THEN 'mW' WHEN 5 THEN 's' WHEN 6 THEN 'furlong' ELSE 'mmol/L' END AS unit, count(*) AS n FROM part GROUP BY 1",
    "document_axis": r"""WITH h AS (SELECT o_orderkey, concat_ws(' ', 'report', CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END, CASE WHEN o_orderkey % 2 = 0 THEN 'Rev ' || (o_orderkey % 9) || '.1' END) AS head FROM orders)
        SELECT o_orderkey, coalesce(nullif(regexp_extract(head, '\d{4}-\d{2}-\d{2}'), ''), nullif(regexp_extract(lower(head), 'rev (\d+(\.\d+)*)', 1), ''), '') AS axis FROM h""",
    "day_normalise": """WITH v AS (SELECT substr(strftime(o_orderdate, '%Y-%m-%d'), 1, CASE o_orderkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 7 WHEN 2 THEN 10 ELSE 6 END) AS v FROM orders)
        SELECT v, count(*) AS n, max(CASE length(v) WHEN 4 THEN v || '-12-31' WHEN 7 THEN strftime(last_day((v || '-01')::date), '%Y-%m-%d') WHEN 10 THEN v END) AS day FROM v GROUP BY v""",
    "bound_distance": """SELECT p_partkey, CASE WHEN p_size < 5 THEN CASE WHEN p_partkey % 3 = 0 THEN 1.0 ELSE round((5.0 - p_size) / 25.0, 4) END WHEN p_partkey % 3 <> 0 AND p_size > 30 THEN round((p_size - 30.0) / 25.0, 4) ELSE 0.0 END::double AS distance FROM part""",
    "document_status": f"""SELECT doc_id, CASE WHEN {PATH} LIKE 'src1/%' THEN 'superseded' WHEN lang = 'de' THEN 'archived' ELSE 'current' END AS status FROM documents""",
    "overlapping_states": """SELECT a.o_custkey, count(*) AS pairs FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.o_orderdate::date <= b.o_orderdate::date + 20 AND b.o_orderdate::date <= a.o_orderdate::date + 20 GROUP BY 1""",
    "degree_stats": f"WITH {EDGES}, {BOTH} SELECT source AS key, count(DISTINCT target) AS degree FROM both_ways GROUP BY source",
    "npmi_weights": f"""WITH {EDGES}, e AS (SELECT * FROM edges), m AS (SELECT DISTINCT * FROM (SELECT 'p' || l_partkey AS key, l_orderkey AS unit FROM lineitem UNION ALL SELECT 's' || l_suppkey, l_orderkey FROM lineitem)),
        p AS (SELECT key, count(*) AS p FROM m GROUP BY key), c AS (SELECT e.source, e.target, count(*) AS c FROM e JOIN m a ON a.key = e.source JOIN m b ON b.key = e.target AND a.unit = b.unit GROUP BY ALL), t AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem),
        x AS (SELECT e.source, e.target, e.weight, coalesce(c, 0) AS cooccur, CASE WHEN c IS NULL THEN 0.0 WHEN c / n >= 1 THEN 1.0 ELSE round(ln((c / n) * n * n / (a.p * b.p)) / -ln(c / n), 6) END AS npmi
          FROM e LEFT JOIN c USING (source, target) JOIN p a ON a.key = e.source JOIN p b ON b.key = e.target, t)
        SELECT source, target, cooccur, npmi, round(1 + 9 * greatest(0.0, least(1.0, 0.5 * weight / (SELECT max(weight) FROM x) + 0.3 * cooccur / (SELECT max(cooccur) FROM x) + 0.2 * (npmi + 1) / 2)), 4) AS weight FROM x""",
    "pagerank_3": f"""WITH {EDGES}, {BOTH}, {NODES}, o AS (SELECT source, sum(weight) AS total FROM both_ways GROUP BY source), shares AS (SELECT b.source, b.target, sum(b.weight) / any_value(o.total) AS share FROM both_ways b JOIN o ON o.source = b.source GROUP BY ALL),
        n AS (SELECT key, (SELECT true FROM o WHERE o.source = nodes.key) AS linked FROM nodes), r0 AS (SELECT key, linked, 1.0::double / (SELECT count(*) FROM n) AS rank FROM n), {", ".join(STEP.format(k=k, j=k - 1) for k in (1, 2, 3))}
        SELECT key, round(rank / (SELECT sum(rank) FROM r3), 9) AS rank FROM r3""",
    "connected_components": """WITH RECURSIVE f AS (SELECT doc_id, string_split(text, chr(10))[1] AS h, source, substr(text, 1, 3) AS head FROM documents), e0 AS (SELECT doc_id AS u, min(doc_id) OVER (PARTITION BY h) AS v FROM f
        UNION ALL SELECT doc_id, min(doc_id) OVER (PARTITION BY source, head) FROM f), e AS (SELECT u, v FROM e0 UNION SELECT v, u FROM e0),
        reach(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.u, e.v FROM reach JOIN e ON reach.v = e.u) SELECT u AS doc_id, min(v) AS component FROM reach GROUP BY u""",
    "one_hop": f"WITH {EDGES}, {BOTH} SELECT source, target, weight, row_number() OVER (PARTITION BY source ORDER BY weight DESC, target) AS place FROM both_ways WHERE source IN ('s1', 's7', 'p10') QUALIFY place <= 20",
    "n_hop": f"""WITH {EDGES}, {BOTH}, degree AS (SELECT source AS key, count(DISTINCT target) AS degree FROM both_ways GROUP BY source), front0 AS (SELECT * FROM (VALUES ('p10', 1.0::double), ('p11', 0.8::double)) v(key, score)),
        found0 AS (SELECT key, 0 AS hop, score FROM front0), {HOP.format(k=1, j=0, front="front0")}, {HOP.format(k=2, j=1, front="front1")} SELECT key, hop::bigint AS hop, round(score, 6) AS score FROM found2""",
    "type_closure": """WITH RECURSIVE t AS (SELECT n_name AS name, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
        c(name, ancestor, distance) AS (SELECT name, parent, 1 FROM t UNION SELECT c.name, t.parent, c.distance + 1 FROM c JOIN t ON c.ancestor = t.name) SELECT name, ancestor, min(distance)::bigint AS distance FROM c GROUP BY ALL""",
    "endpoint_check": f"WITH {EDGES}, {NODES} SELECT type, type IN ('ECONOMY', 'SMALL') AS ok, count(*) AS edges FROM edges JOIN nodes ON nodes.key = edges.source GROUP BY ALL",
    "variant_edges": "SELECT doc_id AS variant, doc_id // 4 * 4 AS base FROM documents WHERE doc_id % 4 IN (1, 2)",
    "mention_counts": rf"""WITH {CHUNKS}, t AS (SELECT doc_id, chunk_index, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS t FROM chunks), n AS (SELECT doc_id, t[1] AS name FROM t WHERE chunk_index = 0 AND length(t[1]) >= 2),
        m AS (SELECT name, doc_id, len(list_filter(t, lambda x: x = name)) AS n FROM t JOIN n USING (doc_id)) SELECT name, doc_id, sum(n)::bigint AS mentions, count(*) AS chunks FROM m WHERE n > 0 GROUP BY ALL""",
    "majority_type": "SELECT p_name, p_type, n AS votes FROM (SELECT p_name, p_type, count(*) AS n FROM part GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY n DESC, p_type DESC) = 1",
    "chunk_graph_score": """WITH e AS (SELECT l_suppkey AS p, l_discount AS w FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_discount DESC) <= 5), t AS (SELECT l_suppkey AS p, l_tax AS w FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_tax DESC) <= 3),
        h AS (SELECT l_suppkey AS p, count(*) AS hub FROM lineitem GROUP BY 1) SELECT h.p AS point_id, round((SELECT sum(w) FROM e WHERE e.p = h.p) + 0.5 * (SELECT sum(w) FROM t WHERE t.p = h.p) / (1 + ln(1 + hub / (SELECT avg(hub) FROM h))), 6) AS score FROM h""",
    "name_keys": """SELECT c_custkey, '"' || lower(c_name) || ' x-1 ' || c_custkey AS key, true AS ok, lower(replace(c_name, '#', '')) AS canonical, true AS identifier FROM customer""",
    "similar_names": """WITH e AS (SELECT p_partkey AS key, p_type AS type, p_name || ' ' || (p_partkey % 40) AS title, row_number() OVER (PARTITION BY p_type ORDER BY p_name || ' ' || (p_partkey % 40), p_partkey) AS at FROM part),
        g AS (SELECT *, list_transform(range(1, length(title)), lambda i: substr(title, i::int, 2)) AS r FROM e), m AS (SELECT *, list_sort(list_distinct(list_filter(r, lambda x: regexp_matches(x, '[0-9]')))) AS digits,
          list_transform(range(1, len(r) + 1), lambda i: r[i] || len(list_filter(list_slice(r, 1, i), lambda x: x = r[i]))) AS g FROM g),
        p AS (SELECT a.key AS a, b.key AS b, a.title AS ta, b.title AS tb, a.g AS ga, b.g AS gb, levenshtein(a.title, b.title)::bigint AS edits FROM m a JOIN m b ON a.type = b.type AND b.at - a.at BETWEEN 1 AND 40 AND (a.title = b.title OR a.digits = b.digits))
        SELECT a, b, round(2.0 * len(list_intersect(ga, gb)) / (len(ga) + len(gb)), 6) AS dice, edits FROM p WHERE ta = tb OR edits <= least(length(ta), length(tb)) // 2""",
    "external_id_link": """WITH i AS (SELECT s_suppkey AS key, 'id' || (s_suppkey % 70) AS x FROM supplier QUALIFY count(*) OVER (PARTITION BY 'id' || (s_suppkey % 70)) = 1) SELECT event_id, key FROM events JOIN i ON i.x = 'id' || user_id""",
    "entity_listing": f"""WITH {EDGES}, {BOTH}, {NODES}, g AS (SELECT source AS key, count(DISTINCT target) AS degree FROM both_ways GROUP BY source)
        SELECT key, title, type, degree FROM nodes JOIN g USING (key) WHERE type IN ('ECONOMY', 'SMALL') ORDER BY degree DESC, key LIMIT 40""",
    "type_facets": f"WITH {NODES} SELECT type, count(*) AS n FROM nodes GROUP BY type ORDER BY n DESC, type LIMIT 100",
    "graph_stats": """SELECT r_name, n_name, c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        GROUP BY GROUPING SETS ((r_name, n_name), (r_name, c_mktsegment), (r_name), ())""",
    "predicate_health": """WITH f AS (SELECT l_returnflag, l_suppkey, count(DISTINCT l_partkey) AS fan FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY fan) AS place, count(*) OVER (PARTITION BY l_returnflag) AS n FROM f),
        h AS (SELECT l_returnflag, count(*) AS edges, round(avg((l_tax > 0.06)::int), 3) AS violations FROM lineitem GROUP BY 1) SELECT h.*, fan AS fan_p95 FROM h JOIN r USING (l_returnflag) WHERE place = ceil(n * 0.95)""",
    "graph_compare": """WITH a AS (SELECT l_partkey, sum(l_quantity)::bigint AS q FROM lineitem WHERE l_linenumber <= 5 GROUP BY 1), b AS (SELECT l_partkey, sum(l_quantity)::bigint AS q FROM lineitem WHERE l_linenumber >= 2 GROUP BY 1)
        SELECT CASE WHEN a.q IS NULL THEN 'added' WHEN b.q IS NULL THEN 'removed' ELSE 'changed' END AS change, count(*) AS n FROM a FULL JOIN b ON a.l_partkey = b.l_partkey WHERE a.q IS NULL OR b.q IS NULL OR a.q <> b.q GROUP BY 1""",
    "bundle_integrity": f"WITH {EDGES} SELECT source, target FROM edges WHERE source = 'p5' OR target = 's3'",
    "docs_listing": f"""WITH {CHUNKS}, c AS (SELECT doc_id, count(*) AS chunks FROM chunks GROUP BY 1) SELECT d.doc_id, {PATH} AS rel_path, coalesce(chunks, 0) AS chunks, quality, count(*) OVER () AS total
        FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN labels USING (doc_id) WHERE source = 'src3' ORDER BY rel_path LIMIT 20 OFFSET 10""",
    "eval_mrr": f"""{KEYWORD}, gold AS (SELECT item_id, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)), best AS (SELECT g.item_id, min(rank) AS rank FROM gold g JOIN keyword k ON k.question_id = g.item_id JOIN points p ON p.point_id = k.point_id AND p.doc_id = g.doc_id GROUP BY 1),
        r AS (SELECT i.item_id, rank FROM (SELECT DISTINCT item_id FROM gold) i LEFT JOIN best USING (item_id))
        SELECT count(*) AS items, round(avg(coalesce(1 / rank, 0)), 6) AS mrr, count_if(rank <= 3)::bigint AS hit_3, count_if(rank <= 5)::bigint AS hit_5, count_if(rank <= 12)::bigint AS hit_12 FROM r""",
    "fact_check": f"""WITH {FACTS}, h AS (SELECT subject, axis, list(DISTINCT value_num) AS vs FROM facts GROUP BY ALL), g AS (SELECT 'part-' || p_partkey AS subject, (p_size % 11)::double AS want FROM part)
        SELECT CASE WHEN vs IS NULL THEN 'missing' WHEN len(list_filter(vs, lambda v: abs(v - want) <= greatest(1e-6 * greatest(abs(v), abs(want)), 1e-6))) > 0 THEN 'found' ELSE 'wrong_value' END AS verdict, count(*) AS n
        FROM g LEFT JOIN h ON h.subject = g.subject AND h.axis = '1998' GROUP BY 1""",
}
