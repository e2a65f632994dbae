"""Queries over parsers, chunks, units, resolution, governance, versions and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import chunking, code_graph, concepts, evidence, ontology, units
from quillmark.operators import resolution as R
from quillmark.operators.graph import scratch
from quillmark.plans.ingest_queries import APPROX, CHUNKS
from quillmark.sources import parsers as P
from quillmark.sources.catalog import Catalog, misses, reused_vectors
from quillmark.sources.tables import chunks, load
from quillmark.streaming import jobs


def html_blocks(spark, d):
    pages = load(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "html")
    return P.table_function(pages, "html", P.html_blocks, P.BLOCKS).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"))


def markdown_blocks(spark, d):
    rows = load(spark, d, "documents").select("doc_id", F.concat(F.lit("---\ntitle: T\n---\n# "), "source", F.lit("\n"), "text").alias("md"))
    return P.table_function(rows, "md", P.markdown_blocks, P.BLOCKS).groupBy("doc_id").agg(F.count("*").alias("blocks"))


def config_flatten(spark, d):
    rows = load(spark, d, "events").select(F.col("event_id").alias("doc_id"), "props")
    return P.table_function(rows, "props", P.config_fields, "doc_id long, path string, value string")


def line_runs(spark, d):
    rows = load(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"))
    return P.line_ranges(rows, "l_orderkey", "line")


def heading_levels(spark, d):
    rows = chunks(spark, d).select(F.when(F.col("chunk_index") % 3 == 0, F.concat(F.col("chunk_index") + 1, F.lit(".2 Title"))).when(F.col("chunk_index") % 3 == 1, F.concat(F.lit("Chapter "), F.col("chunk_index"))).otherwise(F.col("text")).alias("line"))
    return rows.groupBy(P.heading_level(F.col("line")).cast("long").alias("level")).agg(F.count("*").alias("n"))


def header_tiers(spark, d):
    above = F.array("p_brand", F.lit("Size"), F.lit(""))
    row = F.array(F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_type")), F.when(F.col("p_partkey") % 3 == 0, F.lit("12.5")).otherwise(F.lit("mm")), F.lit("Note"))
    rows = load(spark, d, "part").select("p_partkey", P.extends_header(above, row).alias("extends"), F.array_join(P.merged_header(above, row), "|").alias("header"))
    return rows


def table_ambiguity(spark, d):
    cell = F.element_at(F.array(F.concat_ws(" ", "p_size", "p_partkey"), F.concat(F.lit("a=1 b="), "p_size"), F.col("p_name"), F.col("p_size").cast("string")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return load(spark, d, "part").groupBy((F.col("p_partkey") % 4).alias("kind"), P.glued_cell(cell).alias("glued")).agg(F.count("*").alias("n"))


def format_routes(spark, d):
    path = F.concat(F.lit("a/b."), F.element_at(F.array(*map(F.lit, ("md", "HTML", "xlsx", "py", "zzz"))), (F.col("doc_id") % 5 + 1).cast("int")))
    return load(spark, d, "documents").groupBy(P.route(path).alias("parser")).agg(F.count("*").alias("n"))


def greedy_chunks(spark, d):
    return chunking.chunk_documents(load(spark, d, "documents")).select("doc_id", "chunk_index", "kind", "tokens", "chunk_uid")


def unit_build(spark, d):
    rows = units.numbered_units(chunks(spark, d))
    return rows.select("doc_id", "unit", "chunks", units.unit_id(F.col("doc_id"), F.col("unit"), F.col("text")).alias("unit_id"))


def sectioned_units(spark, d):
    rows = chunks(spark, d).withColumn("section", F.floor(F.col("chunk_index") / 4).cast("string"))
    return units.sectioned_units(rows).groupBy("doc_id").agg(F.count("*").alias("units"), F.max("chunk_to").alias("last"))


def unit_kinds(spark, d):
    rows = units.numbered_units(chunks(spark, d)).select(units.kind(F.col("text")).alias("structural"), F.when(F.col("doc_id") % 9 == 0, "conclusion").when(F.col("doc_id") % 9 == 1, "listing").alias("model"))
    return rows.groupBy("structural", units.combined_kind(F.col("structural"), F.col("model")).alias("kind")).agg(F.count("*").alias("n"))


def sample_quota(spark, d):
    sizes = chunks(spark, d).groupBy("kb_id").agg(F.count("*").alias("size"))
    return units.quotas(sizes, "kb_id", "size", 200)


def even_spread(spark, d):
    return units.spread(chunks(spark, d).select("kb_id", (F.col("doc_id") * 1000 + F.col("chunk_index")).alias("place")), "kb_id", "place", 16)


def diverse_sample(spark, d):
    """Three far apart vectors of each label, from an even spread of sixty-four."""
    vectors = load(spark, d, "embeddings").where("label is not null and embedding is not null").select("label", F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    pool = units.spread(vectors.select("label", F.col("key").alias("place")), "label", "place", 64).withColumnRenamed("place", "key")
    return units.farthest(vectors.join(pool, ["label", "key"]), "label", 3)


def wide_table_rows(spark, d):
    table = F.concat(F.lit("| name | size |\n|---|---|\n| "), "p_name", F.lit(" | "), "p_size", F.lit(" |"))
    return load(spark, d, "part").select("p_partkey", F.array_join(units.labelled_rows(table), "\n").alias("text"))


def mentions(spark, d):
    p = load(spark, d, "part")
    return load(spark, d, "lineitem").join(p, F.expr("l_partkey = p_partkey")).select(F.col("p_name").alias("key"), F.upper("p_name").alias("title"), F.col("p_type").alias("type"), F.col("p_type").alias("upper"), F.col("l_orderkey").alias("unit_id"), F.col("l_suppkey").alias("doc_id"))


def merge_records(spark, d):
    return R.merge_records(mentions(spark, d))


def merge_relations(spark, d):
    li = load(spark, d, "lineitem")
    rows = li.select(F.concat(F.lit("p"), F.col("l_partkey") % 40).alias("source"), F.concat(F.lit("p"), F.col("l_suppkey") % 40).alias("target"), F.col("l_returnflag").alias("predicate"), F.lit("").alias("qualifier"),
        F.col("l_quantity").alias("strength"), F.col("l_orderkey").alias("unit_id"), F.when(F.col("l_partkey") % 40 == 3, "not related").otherwise("uses").alias("description"))
    return R.merge_relations(rows)


def homonym_split(spark, d):
    return R.homonyms(mentions(spark, d), 0.15, 2)


def shared_keys(spark, d):
    e = load(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_type").alias("type"), "p_name", "p_brand", "p_size")
    return R.shared_key_pairs(e, [F.concat_ws("/", "p_name", "p_brand"), F.concat_ws("/", "p_name", "p_size")])


def merge_entities(spark, d):
    e = load(spark, d, "part").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_type").alias("type"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_brand")).otherwise("").alias("external"), F.col("p_size").cast("long").alias("frequency"), "p_brand", "p_size")
    return R.merged_entities(e.drop("p_brand", "p_size"), R.shared_key_pairs(e, [F.concat_ws("/", "title", "p_brand")]))


def declared_aliases(spark, d):
    rows = load(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.concat("s_name", F.lit(" (AB"), F.col("s_suppkey") % 60, F.lit(")")).alias("title"))
    return R.declared_aliases(rows)


def dissolved_names(spark, d):
    base = load(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.concat(F.lit("name"), "c_custkey").alias("title"), F.lit("t").alias("type"))
    pairs = base.select(F.concat(F.lit("c"), "key").alias("key"), F.concat("title", F.lit("/name"), (F.col("key") * 2).cast("long")).alias("title"), "type")
    return R.dissolved(base.unionByName(pairs))


def grounded_records(spark, d):
    names = spark.createDataFrame([("license",), ("idiot",), ("The",)], "name string")
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), "text")
    return R.grounded(docs.select("unit_id").crossJoin(F.broadcast(names)), docs).groupBy("name").agg(F.count("*").alias("n"))


def record_parsing(spark, d):
    text = F.concat(F.lit('("entity"<|>"'), "p_name", F.lit('"<|>"'), "p_type", F.lit('")##("relation"<|>a<|>b)##(broken\n("relation"<|>'), "p_name", F.lit("<|>x<|>made of)"))
    rows = load(spark, d, "part").select("p_partkey", F.explode(R.parse_records(text)).alias("r"))
    return rows.select("p_partkey", F.array_join("r", "|").alias("record"))


def name_conflicts(spark, d):
    p = load(spark, d, "part").select("p_partkey", F.concat_ws(" ", F.when(F.col("p_partkey") % 2 == 0, "input").otherwise("output"), "p_name").alias("name"))
    ahead = p.toDF("a", "na").withColumn("b", F.explode(F.array(F.col("a") + 1, F.col("a") + 2)))
    pairs = ahead.join(p.toDF("b", "nb"), "b")
    return pairs.groupBy(R.polarity_conflict(F.col("na"), F.col("nb")).alias("conflict"), R.containment(F.col("na"), F.concat("na", F.lit(" type"))).alias("contained")).agg(F.count("*").alias("n"))


def corrections(spark, d):
    rules = spark.createDataFrame([("reject", "Blue Bolt", None), ("type", "red widget", "WIDGET"), ("title", "small  ring", "Ring, small")], "action string, name string, value string")
    e = load(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("title"), F.col("p_type").alias("type"))
    return ontology.apply_corrections(e, rules)


def governance(spark, d):
    records = load(spark, d, "customer").select(F.col("c_custkey").alias("selector"))
    return ontology.resolved(records, load(spark, d, "orders").select(F.col("o_custkey").alias("selector")), "selector").groupBy("state").agg(F.count("*").alias("n"))


def row_status(spark, d):
    rows = load(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("doc_id"))
    status = load(spark, d, "supplier").where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("doc_id"), F.when(F.col("s_suppkey") % 4 == 1, "current").otherwise("archived").alias("status"))
    return ontology.row_status(rows, status)


def cache_misses(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "text")
    cache = docs.where("doc_id % 3 = 0").select(F.sha2(F.concat_ws("\x1f", F.lit("m1"), "text"), 256).alias("cache_key"), F.when(F.col("doc_id") % 2 == 0, "ok").otherwise("").alias("response"))
    return misses(docs, cache, [F.lit("m1"), F.col("text")]).select("doc_id")


def vector_reuse(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha"))
    old = docs.where("doc_id % 4 <> 1").select("text_sha", F.lit(1.0).alias("vector"))
    return reused_vectors(docs, old).groupBy(F.col("vector").isNotNull().alias("reused")).agg(F.count("*").alias("n"))


def versioned_upsert(spark, d):
    """Two versions of a table, the second by upsert, read through the pointer; the first stays readable when pinned."""
    catalog = Catalog(spark, scratch(spark, "catalog"))
    rows = load(spark, d, "customer").select("c_custkey", "c_mktsegment")
    first = catalog.write(rows, "customers")
    catalog.upsert(rows.where("c_custkey % 5 = 0").select((F.col("c_custkey") + 3).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment")), "customers", ["c_custkey"])
    old = catalog.read("customers", first).groupBy("c_mktsegment").agg(F.count("*").alias("before"))
    new = catalog.read("customers").groupBy("c_mktsegment").agg(F.count("*").alias("after"))
    return new.join(old, "c_mktsegment", "left")


def stream_windows(spark, d):
    return jobs.drain_to(jobs.tumbling(jobs.read_events(spark, d, "events.parquet"), "1 day"), "complete", scratch(spark, "stream")).drop("_batch").withColumn("start", F.date_format("start", "yyyy-MM-dd"))


def stream_sliding(spark, d):
    rows = jobs.drain_to(jobs.sliding(jobs.read_events(spark, d, "events.parquet"), "2 days", "1 day"), "complete", scratch(spark, "stream"))
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "n")


def stream_sessions(spark, d):
    rows = jobs.drain_to(jobs.sessions(jobs.read_events(spark, d, "events.parquet"), "8 hours"), "complete", scratch(spark, "stream"))
    return rows.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"), F.sum("n").alias("events"))


def stream_dedupe(spark, d):
    rows = jobs.drain_to(jobs.deduplicated(jobs.read_events(spark, d, "events.parquet"), ["user_id", "event_type"], "365 days"), "append", scratch(spark, "stream"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))


def stream_job_state(spark, d):
    rows = jobs.drain_to(jobs.job_states(jobs.read_events(spark, d, "events.parquet")), "update", scratch(spark, "stream"))
    return rows.groupBy("job").agg(F.max_by(F.struct("state", "attempts", "events"), "_batch").alias("s")).select("job", "s.state", "s.attempts", "s.events")


def greedy_cover(spark, d):
    from quillmark.operators.recall import top_k
    from quillmark.plans.search_queries import judged

    return evidence.cover(top_k(judged(spark, d), "score", "point_id", 64, ["question_id"]), 8)


def stitched_hits(spark, d):
    rows = chunks(spark, d)
    return evidence.stitched(rows.where("doc_id % 5 = 0 and chunk_index % 3 = 0").select("doc_id", "chunk_index"), rows).select("doc_id", "hit", "first", "last", F.length("text").cast("long").alias("chars"))


def subject_pages(spark, d):
    from quillmark.plans.graph_queries import facts

    return evidence.subject_pages(facts(spark, d)).select("subject", "score", F.size(F.split("page", "\n")).cast("long").alias("lines"))


def graph_readback(spark, d):
    rows = chunks(spark, d)
    places = rows.select((F.col("doc_id") % 10).alias("question_id"), "doc_id", "chunk_index", (F.col("doc_id") % 7 + F.col("chunk_index")).alias("weight"))
    return evidence.readback(places, rows)


def concept_norms(spark, d):
    prop = F.concat_ws(" ", "p_name", F.when(F.col("p_partkey") % 2 == 0, "Value").otherwise("rate level"))
    symbol = F.when(F.col("p_partkey") % 3 == 0, "V_{CC}").when(F.col("p_partkey") % 3 == 1, "t")
    return load(spark, d, "part").select("p_partkey", concepts.norm(prop, symbol).alias("concept"))


def concept_build(spark, d):
    names = load(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min(F.when(F.col("p_size") > 48, "mm").otherwise("")).alias("unit"), F.count("*").alias("n"))
    a, b = names.select(F.col("name").alias("a")), names.select(F.col("name").alias("b"))
    pairs = a.join(b, F.expr("a < b and substring_index(a, ' ', -1) = substring_index(b, ' ', -1)")).withColumn("similarity", F.lit(0.9))
    return concepts.build(names, pairs)


def period_contexts(spark, d):
    rows = chunks(spark, d).withColumn("text", F.when(F.col("chunk_index") == 1, "Report for FY2023").when(F.col("chunk_index") == 3, "Q2 2024 results").otherwise(F.lit("body")))
    return concepts.time_contexts(rows)


def code_relations(spark, d):
    """Definitions, imports and calls of generated modules, imports resolved against the files."""
    docs = load(spark, d, "documents")
    source = F.concat(F.lit("import os\nimport pkg.m"), F.col("doc_id") + 1, F.lit("\ndef f"), "doc_id", F.lit("():\n    return f"), F.col("doc_id") + 1, F.lit("()\n"))
    rows = docs.select(F.concat(F.lit("src/pkg/m"), "doc_id", F.lit(".py")).alias("path"), source.alias("source"))
    found = code_graph.relations(rows)
    return code_graph.resolved_imports(found, rows).join(code_graph.calls_to_definitions(found).select(F.col("caller").alias("path"), "callee"), "path", "left")


QUERIES = {f.__name__: f for f in (
    html_blocks, markdown_blocks, config_flatten, line_runs, heading_levels, header_tiers, table_ambiguity, format_routes, greedy_chunks, unit_build, sectioned_units, unit_kinds, sample_quota, even_spread, diverse_sample,
    wide_table_rows, merge_records, merge_relations, homonym_split, shared_keys, merge_entities, declared_aliases, dissolved_names, grounded_records, record_parsing, name_conflicts, corrections, governance,
    row_status, cache_misses, vector_reuse, versioned_upsert, stream_windows, stream_sliding, stream_sessions, stream_dedupe, stream_job_state,
    greedy_cover, stitched_hits, subject_pages, graph_readback, concept_norms, concept_build, period_contexts, code_relations,
)}

MENTIONS = "m AS (SELECT p_name AS key, upper(p_name) AS title, p_type AS type, l_orderkey AS unit_id, l_suppkey AS doc_id FROM lineitem JOIN part ON l_partkey = p_partkey)"
FACTS = """facts AS (SELECT 'part-' || l_partkey AS subject, strftime(l_shipdate, '%Y') AS axis, round(l_discount * 100, 2) AS value_num, l_suppkey AS doc_id FROM lineitem)"""
UNITS = f"{CHUNKS}, u AS (SELECT doc_id, chunk_index // 3 AS unit, string_agg(text, chr(10) || chr(10) ORDER BY chunk_index) AS text, count(*) AS chunks FROM chunks GROUP BY ALL)"

SQL = {
    "config_flatten": "SELECT event_id AS doc_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events WHERE props IS NOT NULL",
    "line_runs": "WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber::bigint AS line FROM lineitem), g AS (SELECT *, line - row_number() OVER (PARTITION BY l_orderkey ORDER BY line) AS g FROM r) SELECT l_orderkey, min(line) AS first, max(line) AS last FROM g GROUP BY l_orderkey, g",
    "heading_levels": rf"""WITH {CHUNKS}, l AS (SELECT CASE WHEN chunk_index % 3 = 0 THEN (chunk_index + 1) || '.2 Title' WHEN chunk_index % 3 = 1 THEN 'Chapter ' || chunk_index ELSE text END AS line FROM chunks),
        x AS (SELECT CASE WHEN regexp_matches(line, '^\s*(Chapter|Part|Appendix)\s+[0-9IVXA-Z]+\b') THEN 1 WHEN regexp_extract(line, '^\s*(\d+(?:\.\d+)*)\.?\s+\p{{Lu}}', 1) <> '' AND length(line) <= 80
        THEN len(string_split(regexp_extract(line, '^\s*(\d+(?:\.\d+)*)\.?\s+\p{{Lu}}', 1), '.')) END::bigint AS level FROM l) SELECT level, count(*) AS n FROM x GROUP BY level""",
    "header_tiers": """SELECT p_partkey, p_partkey % 2 = 0 AND p_partkey % 3 <> 0 AS extends, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_brand || ' ' || p_type END || '|Size ' || CASE WHEN p_partkey % 3 = 0 THEN '12.5' ELSE 'mm' END || '|Note' AS header FROM part""",
    "table_ambiguity": "SELECT p_partkey % 4 AS kind, p_partkey % 4 < 2 AS glued, count(*) AS n FROM part GROUP BY ALL",
    "format_routes": "SELECT CASE doc_id % 5 WHEN 0 THEN 'markdown' WHEN 1 THEN 'html' WHEN 2 THEN 'workbook' WHEN 3 THEN 'python' END AS parser, count(*) AS n FROM documents GROUP BY 1",
    "unit_build": f"WITH {UNITS} SELECT doc_id, unit, chunks, substr(sha256(concat_ws('|', doc_id, unit, text)), 1, 32) AS unit_id FROM u",
    "unit_kinds": rf"""WITH {UNITS}, l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM u),
        s AS (SELECT doc_id, text, lower(substr(text, 1, 160)) AS head, len(regexp_extract_all(text, '\.{{4,}}\s*\d+')) AS toc, len(regexp_extract_all(text, '\d{{4}}-\d{{2}}-\d{{2}}')) AS dates,
          coalesce(round(len(list_filter(ls, lambda x: length(x) - length(replace(x, '|', '')) >= 2)) / nullif(len(ls), 0), 3), 0) AS tr,
          round(coalesce(list_sum(list_transform(list_filter(ls, lambda x: length(x) >= 40 AND contains(x, ' ')), lambda x: length(x))), 0) / greatest(coalesce(list_sum(list_transform(ls, lambda x: length(x))), 0), 1), 3) AS pr FROM l),
        k AS (SELECT doc_id, CASE WHEN toc >= 5 THEN 'boilerplate' WHEN regexp_matches(head, 'copyright|licen[sc]ed under|all rights reserved|disclaimer|revision history') THEN 'boilerplate' WHEN dates >= 3 AND contains(head, 'revision') THEN 'boilerplate'
          WHEN tr >= 0.5 AND pr < 0.4 THEN 'listing' WHEN regexp_matches(head, 'conclusion|summary|recommendation') THEN 'conclusion' ELSE 'body' END AS structural FROM s)
        SELECT structural, CASE WHEN structural = 'boilerplate' THEN 'boilerplate' WHEN structural = 'listing' THEN 'listing' WHEN structural = 'conclusion' OR doc_id % 9 = 0 THEN 'conclusion' ELSE 'body' END AS kind, count(*) AS n FROM k GROUP BY ALL""",
    "sample_quota": f"""WITH {CHUNKS}, s AS (SELECT kb_id, count(*) AS size FROM chunks GROUP BY 1), r AS (SELECT *, round(1 + sqrt(size) * (200 - count(*) OVER ()) / sum(sqrt(size)) OVER (), 9) AS raw FROM s),
        b AS (SELECT *, floor(raw)::bigint AS base FROM r), l AS (SELECT *, 200 - sum(base) OVER () AS rest, row_number() OVER (ORDER BY raw - base DESC, kb_id) AS place FROM b) SELECT kb_id, least(size, base + (place <= rest)::bigint) AS quota FROM l""",
    "even_spread": f"""WITH {CHUNKS}, r AS (SELECT kb_id, doc_id * 1000 + chunk_index AS place, row_number() OVER (PARTITION BY kb_id ORDER BY doc_id * 1000 + chunk_index) - 1 AS at_, count(*) OVER (PARTITION BY kb_id) AS n FROM chunks)
        SELECT kb_id, place FROM r WHERE n <= 16 OR len(list_filter(range(0, 16), lambda i: (i * n) // 16 = at_)) > 0""",
    "diverse_sample": """WITH r AS (SELECT label, vec_id, list_transform(embedding, lambda x: x::double) AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
        p AS (SELECT * FROM r WHERE n <= 64 OR len(list_filter(range(0, 64), lambda x: (x * n) // 64 = i)) > 0), a AS (SELECT label, vec_id, e FROM p QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
        b AS (SELECT p.label, p.vec_id, p.e, round(list_cosine_similarity(p.e, a.e), 6) AS near FROM p JOIN a ON a.label = p.label AND a.vec_id <> p.vec_id), c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY label ORDER BY near, vec_id) = 1),
        f AS (SELECT b.label, b.vec_id, greatest(b.near, round(list_cosine_similarity(b.e, c.e), 6)) AS near FROM b JOIN c ON c.label = b.label AND c.vec_id <> b.vec_id)
        SELECT label, vec_id AS key, 1::bigint AS place FROM a UNION ALL SELECT label, vec_id, 2 FROM c UNION ALL (SELECT label, vec_id, 3 FROM f QUALIFY row_number() OVER (PARTITION BY label ORDER BY near, vec_id) = 1)""",
    "wide_table_rows": "SELECT p_partkey, 'name: ' || p_name || '; size: ' || p_size AS text FROM part",
    "merge_records": f"""WITH {MENTIONS}, s AS (SELECT key, count(DISTINCT unit_id) AS units, count(DISTINCT doc_id) AS docs, count(*) AS frequency FROM m GROUP BY key),
        t AS (SELECT key, type FROM (SELECT key, type, count(*) AS n FROM m GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, type DESC) = 1) SELECT s.*, upper(key) AS title, type FROM s JOIN t USING (key)""",
    "merge_relations": """SELECT 'p' || (l_partkey % 40) AS source, 'p' || (l_suppkey % 40) AS target, l_returnflag AS predicate, '' AS qualifier, sum(l_quantity) AS strength_sum, count(DISTINCT l_orderkey) AS evidence,
        CASE WHEN bool_and(l_partkey % 40 = 3) THEN 'uncertain' ELSE 'affirmed' END AS polarity FROM lineitem WHERE l_partkey % 40 <> l_suppkey % 40 GROUP BY ALL""",
    "homonym_split": f"""WITH {MENTIONS}, c AS (SELECT key, type AS upper, count(*) AS n, count(DISTINCT doc_id) AS d FROM m GROUP BY ALL), w AS (SELECT *, n / sum(n) OVER (PARTITION BY key) AS share, row_number() OVER (PARTITION BY key ORDER BY n DESC, upper) AS k FROM c)
        SELECT key, upper, key || '||' || upper AS own_key FROM w WHERE k > 1 AND share >= 0.15 AND d >= 2""",
    "shared_keys": """WITH e AS (SELECT p_partkey AS key, p_type AS type, unnest([p_name || '/' || p_brand, p_name || '/' || p_size]) AS k FROM part), f AS (SELECT type, k, min(key) AS a FROM e GROUP BY ALL)
        SELECT DISTINCT a, key AS b FROM e JOIN f USING (type, k) WHERE key <> a""",
    "merge_entities": """SELECT p_partkey::varchar AS key, first_value(p_partkey::varchar) OVER (PARTITION BY p_type, p_name, p_brand ORDER BY p_partkey % 5 <> 0, p_size DESC, p_partkey::varchar) AS canonical FROM part QUALIFY count(*) OVER (PARTITION BY p_type, p_name, p_brand) > 1""",
    "declared_aliases": "WITH a AS (SELECT 'AB' || (s_suppkey % 60) AS alias, s_suppkey AS key FROM supplier) SELECT alias, key FROM a QUALIFY count(*) OVER (PARTITION BY alias) = 1",
    "dissolved_names": "SELECT 'c' || c_custkey AS combined, unnest(list_distinct([c_custkey::varchar, (c_custkey * 2)::varchar])) AS part FROM customer WHERE c_custkey > 0 AND c_custkey * 2 IN (SELECT c_custkey FROM customer)",
    "grounded_records": "SELECT name, count(*) AS n FROM documents, (VALUES ('license'), ('idiot'), ('The')) v(name) WHERE contains(lower(text), lower(name)) GROUP BY name",
    "record_parsing": "SELECT p_partkey, unnest(['entity|' || p_name || '|' || p_type, 'relation|' || p_name || '|x|made of']) AS record FROM part",
    "name_conflicts": """WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'input' ELSE 'output' END AS s FROM part), q AS (SELECT a.s <> b.s AS conflict FROM p a JOIN p b ON b.k - a.k IN (1, 2))
        SELECT conflict, true AS contained, count(*) AS n FROM q GROUP BY conflict""",
    "corrections": "SELECT p_partkey AS key, CASE WHEN p_name = 'small ring' THEN 'Ring, small' ELSE p_name END AS title, CASE WHEN p_name = 'red widget' THEN 'WIDGET' ELSE p_type END AS type FROM part WHERE p_name <> 'blue bolt'",
    "governance": "WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'valid' ELSE 'ambiguous' END AS state, count(*) AS n FROM customer LEFT JOIN n ON o_custkey = c_custkey GROUP BY 1",
    "row_status": "SELECT l_partkey AS key, NOT bool_and(l_suppkey % 4 IN (2, 3)) AS current FROM lineitem GROUP BY 1",
    "cache_misses": "SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 6 = 0)",
    "vector_reuse": "SELECT text IN (SELECT text FROM documents WHERE doc_id % 4 <> 1) AS reused, count(*) AS n FROM documents GROUP BY 1",
    "versioned_upsert": """WITH n AS (SELECT c_custkey + 3 AS k FROM customer WHERE c_custkey % 5 = 0), a AS (SELECT c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT k FROM n) UNION ALL SELECT 'NEW' FROM n)
        SELECT c_mktsegment, count(*) AS after, (SELECT count(*) FROM customer c WHERE c.c_mktsegment = a.c_mktsegment HAVING count(*) > 0) AS before FROM a GROUP BY c_mktsegment""",
    "stream_windows": "SELECT strftime(ts, '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_sliding": "SELECT strftime(day, '%Y-%m-%d') AS start, count(*) AS n FROM (SELECT unnest([ts::date, ts::date - 1]) AS day FROM events) GROUP BY day",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 8 HOUR, true)::int AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g),
        c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest, sum(n)::bigint AS events FROM c GROUP BY user_id""",
    "subject_pages": f"""WITH {FACTS}, s AS (SELECT subject, 3 * count(*) + 2 * count(DISTINCT doc_id) AS score FROM facts GROUP BY 1 HAVING count(*) >= 3 ORDER BY score DESC, subject LIMIT 80)
        SELECT subject, score, 1 + count(DISTINCT (axis, value_num)) AS lines FROM facts JOIN s USING (subject) GROUP BY ALL""",
    "graph_readback": f"""WITH {CHUNKS}, p AS (SELECT doc_id % 10 AS question_id, doc_id, chunk_index, text, row_number() OVER (PARTITION BY doc_id ORDER BY doc_id % 7 + chunk_index DESC, chunk_index) AS turn FROM chunks),
        r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY turn, doc_id, chunk_index) AS place FROM p QUALIFY place <= 24), t AS (SELECT *, {APPROX.format("text")} AS tokens FROM r),
        u AS (SELECT *, sum(tokens) OVER (PARTITION BY question_id ORDER BY place) AS used FROM t) SELECT question_id, doc_id, chunk_index, place, tokens FROM u WHERE used <= 2400""",
    "concept_norms": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'vcc' WHEN 1 THEN 't:' || lower(p_name) ELSE lower(p_name) END AS concept FROM part",
    "period_contexts": f"WITH {CHUNKS} SELECT doc_id, chunk_index, CASE WHEN chunk_index >= 3 THEN 'Q2 2024' WHEN chunk_index >= 1 THEN 'FY2023' ELSE '' END AS period FROM chunks",
    "code_relations": """WITH d AS (SELECT doc_id, doc_id + 1 AS n FROM documents), k AS (SELECT doc_id, n, n IN (SELECT doc_id FROM d) AS known FROM d),
        i AS (SELECT 'src/pkg/m' || doc_id || '.py' AS path, n, known, unnest(['os', 'pkg.m' || n]) AS name FROM k)
        SELECT path, name, CASE WHEN name <> 'os' AND known THEN 'internal' ELSE 'external' END AS state, CASE WHEN name <> 'os' AND known THEN 'src/pkg/m' || n || '.py' END AS target, CASE WHEN known THEN 'src/pkg/m' || n || '.py' END AS callee FROM i""",
    "stream_job_state": """WITH e AS (SELECT 'job' || user_id AS job, event_type, ts, event_id FROM events), s AS (SELECT job, count_if(event_type = 'error')::bigint AS errors, count(*) AS events, max_by(event_type, (ts, event_id)) FILTER (event_type IN ('error', 'purchase')) AS last FROM e GROUP BY job)
        SELECT job, CASE WHEN errors >= 5 THEN 'dead' WHEN last = 'purchase' THEN 'running' ELSE 'queued' END AS state, least(errors, 5)::bigint AS attempts, events FROM s""",
    "stream_dedupe": "SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY event_type",
}
