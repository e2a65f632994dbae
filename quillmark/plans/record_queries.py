"""Queries over cells, dates, facts' ends, relations' states and admission, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import dates as D
from quillmark.functions import records as C
from quillmark.operators import walk as W
from quillmark.plans.ingest_queries import CHUNKS
from quillmark.sources import parsers as P
from quillmark.sources.tables import chunks, load, rel_path

YEAR_NOW = 1999


def picked(key, modulus, *values):
    """One of the values by the key's remainder."""
    return F.element_at(F.array(*values), (key % modulus + 1).cast("int"))


def cell_values(spark, d):
    k, null = F.col("o_orderkey") % 7, F.lit(None)
    rows = load(spark, d, "orders").select(
        "o_orderkey", F.when(k == 0, F.concat(F.lit("  "), "o_orderstatus", F.lit(" "))).when(k == 1, '=DISPIMG("x",1)').otherwise(null).alias("text"), F.when(k == 2, F.col("o_totalprice")).when(k == 3, F.col("o_orderkey").cast("double")).when(k == 4, F.col("o_orderkey") % 1000 / 1000).alias("number"),
        F.when(k == 5, F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("o_orderkey") % 2).cast("int"))).alias("time"), F.when(k == 6, F.col("o_orderkey") % 2 == 0).alias("truth"), F.when(k == 4, picked(F.col("o_orderkey"), 3, F.lit("0%"), F.lit("0.0%;-0%"), F.lit('"x"0.00%'))).alias("format"),
    )
    return rows.select("o_orderkey", C.cell_text(F.col("text"), F.col("number"), F.col("time"), F.col("truth"), F.col("format")).alias("cell"))


def glued_rows(spark, d):
    k = F.col("p_partkey") % 3
    two, three = F.split("p_name", " "), F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    plan = F.when(k == 0, F.create_map(F.lit(0), two, F.lit(2), F.array("p_type", F.lit("x")))).when(k == 1, F.create_map(F.lit(0), two, F.lit(1), three)).otherwise(F.create_map().cast("map<int,array<string>>"))
    rows = load(spark, d, "part").select("p_partkey", F.posexplode(C.expanded_rows(F.array("p_name", "p_brand", "p_type"), plan)).alias("line", "row"))
    return rows.select("p_partkey", F.col("line").cast("long").alias("line"), F.array_join("row", "|").alias("row"))


def jsonl_records(spark, d):
    text = F.concat("props", F.lit("\n \n"), F.lit('{"title": "T'), "event_type", F.lit('", "x": [1]}\nnot json\n'))
    rows = load(spark, d, "events").where("props is not null").select(F.col("event_id").alias("doc_id"), text.alias("text"))
    return P.jsonl_records(rows)


def section_paths(spark, d):
    """The common head of the section paths of each library's documents, from the least and the greatest path alone."""
    path = F.array("source", picked(F.col("doc_id"), 2, F.lit("a"), F.lit("b")), F.col("doc_id").cast("string"))
    deep = F.when(F.col("doc_id") % 3 == 0, F.concat(F.slice(path, 1, 1), F.array(F.lit("a"), F.lit("z")))).otherwise(path)
    paths = load(spark, d, "documents").where("source <> 'src1' or doc_id % 2 = 0").select("source", deep.alias("path"))
    ends = paths.groupBy("source").agg(F.min("path").alias("a"), F.max("path").alias("b"))
    return ends.select("source", F.array_join(C.common_prefix(F.col("a"), F.col("b")), "/").alias("common"))


def section_location(spark, d):
    """Chunks by the sections of their document whose text holds them: one, or several and then the common head."""
    rows = chunks(spark, d).where("chunk_index < 6")
    section = rows.select("doc_id", F.floor(F.col("chunk_index") / 2).alias("section"), "chunk_index", "text").groupBy("doc_id", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), " ").alias("body"))
    needle = F.regexp_replace(F.substring("text", 1, 12), r"\s+", "")
    hits = rows.select("doc_id", "chunk_index", needle.alias("needle")).join(section, "doc_id").where(F.contains(F.regexp_replace("body", r"\s+", ""), F.col("needle")))
    return hits.groupBy("doc_id", "chunk_index").agg(F.count("*").alias("sections"), F.min("section").alias("first"), (F.count("*") > 1).alias("ambiguous"))


def embedding_prefixes(spark, d):
    rows = chunks(spark, d).join(load(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    sections = F.array(F.when(F.col("chunk_index") % 2 == 0, F.lit(" ")).otherwise(F.concat(F.lit("Part "), "chunk_index")), F.repeat(F.lit("long"), (F.col("chunk_index") % 60).cast("int")))
    return rows.select("doc_id", "chunk_index", C.embedding_prefix(F.concat("kb_id", F.lit("-"), "lang"), sections).alias("prefix"))


def fact_identity(spark, d):
    """Ids of facts; rows of equal unit and content share one."""
    rows = load(spark, d, "lineitem").select(C.fact_id(F.col("l_orderkey"), [F.concat(F.lit("part-"), "l_partkey"), F.lit("discount"), F.col("l_linestatus"), F.lit(None), F.date_format("l_shipdate", "yyyy")]).alias("fact_id"))
    return rows.groupBy("fact_id").agg(F.count("*").alias("n"))


def fact_renderings(spark, d):
    s, k = F.col("p_size").cast("string"), F.col("p_partkey")
    single, ranged = k % 2 == 0, k % 4 == 1
    values = C.values_text(F.when(single, s), F.when(ranged, s), F.lit(None), F.when(~single, (F.col("p_size") + 5).cast("string")), F.when(k % 3 == 0, F.lit("mm")))
    conditions = C.conditions_text(F.when(k % 5 == 0, F.create_map(F.lit("temp"), F.lit("25"), F.lit("mode"), F.col("p_type"))))
    when = C.when_text(F.when(k % 3 == 0, F.lit("2001")), F.when(k % 6 == 0, F.lit("2003")).when(k % 6 == 3, F.lit("2001")), F.when(k % 3 == 1, F.lit("1999-05")))
    return load(spark, d, "part").select("p_partkey", C.fact_text(F.col("p_name"), F.lit("size"), F.when(k % 2 == 0, F.lit("SIZE")).otherwise(F.lit("L")), values, conditions, when).alias("text"))


def fact_states(spark, d):
    k = F.col("l_partkey")
    quality = C.fact_quality(k % 11 == 0, F.when(k % 7 == 0, "ambiguous_source"), F.when(k % 13 == 0, "unresolved"))
    flag = C.flag_status(quality, picked(k, 4, F.lit("H"), F.lit("normal"), F.lit("?"), F.lit(None)), F.when(k % 3 != 0, F.col("l_quantity")), F.lit(10.0), F.when(k % 2 == 0, F.lit(40.0)).otherwise(F.lit(5.0)))
    return load(spark, d, "lineitem").groupBy(quality.alias("quality"), flag.alias("flag")).agg(F.count("*").alias("n"))


def property_flags(spark, d):
    prop = F.concat("p_name", picked(F.col("p_partkey"), 3, F.lit(" High"), F.lit(""), F.lit(" 异常")))
    return load(spark, d, "part").select("p_partkey", C.split_flag(prop).alias("s")).select("p_partkey", "s.property", "s.flag")


def cell_dedupe(spark, d):
    """Facts of one source cell and id coalesce; their points and units are united. Facts without a cell all stay."""
    li = load(spark, d, "lineitem").select(F.concat(F.lit("c"), "l_partkey").alias("cell"), F.col("l_suppkey").alias("fact"), F.col("l_orderkey").alias("unit_id"), F.col("l_linenumber").alias("point"))
    rows = li.groupBy("cell", "fact").agg(F.count("*").alias("merged"), F.array_join(F.array_sort(F.collect_set("unit_id")), ",").alias("units"), F.array_join(F.array_sort(F.collect_set("point")), ",").alias("points"))
    return rows.where("merged > 1")


def date_forms(spark, d):
    day, k = F.col("o_orderdate"), F.col("o_orderkey")
    fmt = lambda f: F.date_format(day, f)
    form = picked(k, 7, fmt("yyyy-MM-dd"), fmt("yyyyMMdd"), fmt("yyyy年M月d日"), fmt("MMMM d, yyyy"), fmt("d MMM yyyy"), fmt("MMM yyyy"), fmt("yyyy/M"))
    return load(spark, d, "orders").select("o_orderkey", F.array_join(D.found_dates(F.concat(F.lit("Signed 13/2 on "), form, F.lit("; see 3.2001, part 12199945, 2001-13 and 1995 too."))), "|").alias("dates"))


def file_dates(spark, d):
    day, k = F.col("o_orderdate"), F.col("o_orderkey")
    name = picked(k, 5, F.concat(F.lit("report_"), F.date_format(day, "yyyy-MM-dd"), F.lit(".pdf")), F.concat(F.lit("ZX8C2048KV17 "), F.date_format(day, "yyyyMMdd"), F.lit(".docx")), F.concat(F.lit("minutes "), F.date_format(day, "MMMM yyyy"), F.lit(".md")), F.concat(F.lit("plan 2045 "), F.date_format(day, "yyyy"), F.lit(".txt")), F.lit("A2001B.txt"))
    return load(spark, d, "orders").select("o_orderkey", F.coalesce(D.name_date(name, YEAR_NOW), F.lit("")).alias("date"))


def question_windows(spark, d):
    k = F.col("p_partkey")
    q = picked(k, 8, F.concat(F.lit("sales from 1996 to "), 1997 + F.col("p_size") % 3), F.lit("the last three years of it"), F.concat(F.lit("anything since 199"), F.col("p_size") % 10), F.lit("this year"), F.lit("What of last year?"), F.lit("近5年"), F.lit("in 1998-03 and 1996"), F.lit("no time at all"))
    w = D.question_window(q, YEAR_NOW)
    rows = load(spark, d, "part").select(w.alias("w"), D.in_window(F.concat((1990 + F.col("p_size") % 10).cast("string"), F.lit("-01")), w).alias("inside"))
    return rows.groupBy(F.col("w.from").alias("since"), F.col("w.to").alias("until"), "inside").agg(F.count("*").alias("n"))


def observation_dates(spark, d):
    source = F.concat(F.lit("Measured on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" in "), "o_orderpriority")
    quote = F.when(F.col("o_orderkey") % 3 == 0, F.lit("on 1990-01-01")).otherwise(F.concat(F.lit("on "), F.date_format("o_orderdate", "yyyy-MM-dd")))
    return load(spark, d, "orders").groupBy(D.evidence_date(quote, source).alias("observed")).agg(F.count("*").alias("n"))


def relation_states(spark, d):
    k = F.col("l_partkey")
    quality = C.relation_quality(k % 17 == 0, k % 13 == 0, F.when(k % 11 == 0, "needs_review"), F.when(k % 5 == 0, "uncertain").when(k % 5 == 1, "negated"), F.when(k % 7 == 0, "planned"))
    walk = C.traversable(quality, F.when(k % 5 == 1, "negated"), F.when(k % 7 == 0, "planned"), F.when(k % 4 == 0, "{x}").otherwise(F.lit("")))
    return load(spark, d, "lineitem").groupBy(quality.alias("quality"), walk.alias("traversable")).agg(F.count("*").alias("n"))


def composed_parts(spark, d):
    li = load(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey") % 60).alias("source"), F.concat(F.lit("p"), F.col("l_suppkey") % 60).alias("target"), picked(F.col("l_linenumber"), 4, F.lit("has part"), F.lit("Part-Of"), F.lit("uses"), F.lit("contains")).alias("predicate"), (F.col("l_orderkey") % 3 > 0).alias("traversable"))
    own = spark.range(60).select(F.concat(F.lit("p"), "id").alias("key"), F.when(F.col("id") % 9 == 0, "class").otherwise("instance").alias("kind"), (F.col("id") % 10 == 1).alias("reference"))
    return W.parts_index(li, own)


def currency_stamps(spark, d):
    li = load(spark, d, "lineitem")
    relations = li.groupBy(F.concat_ws("-", "l_partkey", "l_suppkey").alias("relation")).agg(F.collect_set(F.col("l_orderkey")).alias("unit_ids"))
    units = load(spark, d, "orders").select(F.col("o_orderkey").alias("unit_id"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("doc_date"))
    return W.currency(relations, units)


def undecided_relations(spark, d):
    rows = load(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_returnflag").alias("predicate"), F.col("l_suppkey").alias("target"), (F.col("l_linenumber") > 2).alias("traversable"))
    return W.undecided(rows, ["A", "R"])


def _names(spark, d):
    k = F.col("p_partkey")
    title = picked(k, 6, F.col("p_name"), F.concat("p_size", F.lit(" mm")), F.concat(F.lit("Figure "), "p_size"), F.concat("p_size", F.lit(" V to "), F.col("p_size") + 5, F.lit(" V")), F.concat(F.lit("ZK7C"), "p_size", F.lit("KV13")), F.lit("Rev *J"))
    return load(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("key"), title.alias("title"), F.col("p_type").alias("type"), (k % 18 == 1).alias("exact"), (k % 24 == 0).alias("boilerplate"))


def _owned(spark, d):
    li = load(spark, d, "lineitem")
    return li.select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), F.lit("rated").alias("predicate"), (F.col("l_partkey") % 30 != 3).alias("traversable"))


def admitted_entities(spark, d):
    suppliers = load(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("key"), F.col("s_name").alias("title"), F.lit("SUPPLIER").alias("type"), F.lit(True).alias("exact"), F.lit(False).alias("boilerplate"))
    entities, _ = W.admitted(_names(spark, d).unionByName(suppliers), _owned(spark, d))
    return entities.select("key", "title", "reference", F.size("attributes").cast("long").alias("attributes"))


def admitted_relations(spark, d):
    _, relations = W.admitted(_names(spark, d), _owned(spark, d))
    return relations.groupBy("source").agg(F.count("*").alias("n"))


def type_noise(spark, d):
    return W.type_health(_names(spark, d))


def fact_links(spark, d):
    parts = load(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), (F.col("p_partkey") % 50).alias("doc_id"))
    rows = load(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact_id"), (F.col("l_suppkey") % 60).alias("doc_id"), F.col("l_partkey").alias("k"))
    rows = rows.join(parts.select(F.col("key").alias("k"), F.when(F.col("key") % 7 == 0, F.lit("nothing known")).otherwise(F.upper("name")).alias("subject")), "k")
    return W.linked_facts(rows, parts).groupBy("scope", "key").agg(F.count("*").alias("n"))


def lenient_json(spark, d):
    """Whole objects of model replies that are cut off or have commas too many."""
    k = F.col("p_partkey")
    text = picked(k, 4, F.concat(F.lit('[{"p": "'), "p_name", F.lit('"}, {"p": "x"},]')), F.concat(F.lit('Sure: [{"p": "'), "p_name", F.lit('"}, {"p": "a ] b')), F.concat(F.lit('{"facts": [{"p": "'), "p_name", F.lit('", "v": {"w": 1}}, {"q"')), F.lit("no reply"))
    rows = load(spark, d, "part").select("p_partkey", P.lenient_objects(text).alias("o"))
    return rows.select("p_partkey", F.size("o").cast("long").alias("objects"), F.get_json_object(F.get("o", F.lit(0)), "$.p").alias("first"))


def place_strings(spark, d):
    k = F.col("l_linenumber")
    page = F.when(k == 1, F.col("l_partkey")).when(k == 2, F.col("l_partkey"))
    part = C.place(page, F.when(k == 2, F.col("l_partkey") + 3), F.when(k == 3, F.col("l_suppkey")), F.lit(None).cast("long"), F.when(k == 4, F.col("l_suppkey")), F.col("l_suppkey") + 2, F.when(k == 5, F.array(F.lit("A"), F.repeat(F.lit("head"), 20))).when(k == 6, F.array(F.lit("B"), F.lit(" "))).otherwise(F.array().cast("array<string>")))
    return load(spark, d, "lineitem").groupBy(C.position(part, F.when(k == 1, F.array(F.lit("X"), F.lit("Y"))).otherwise(F.array().cast("array<string>"))).alias("position")).agg(F.count("*").alias("n"))


def packed_rows(spark, d):
    """Parts of each brand as a sheet: rows to blocks of a token budget, every block with the sheet's name, rows and header."""
    rows = load(spark, d, "part").select(F.col("p_brand").alias("sheet"), F.col("p_partkey").alias("row_no"), F.concat_ws(" | ", "p_partkey", "p_name", "p_type", "p_size").alias("row"))
    return P.packed_rows(rows, "key | name | type | size", 60).select("sheet", "first", "last", "tokens")


def pointer_files(spark, d):
    """Files that only point to large files elsewhere are withheld."""
    head = F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("version https://git-lfs.github.com/spec/v1\noid sha256:"), F.sha2("text", 256), F.lit("\nsize 1\n"))).otherwise(F.col("text"))
    return load(spark, d, "documents").select(rel_path().alias("rel_path"), P.is_pointer(head).alias("pointer")).where("pointer").select("rel_path")


QUERIES = {f.__name__: f for f in (
    cell_values, glued_rows, jsonl_records, section_paths, section_location, embedding_prefixes, fact_identity, fact_renderings, fact_states, property_flags, cell_dedupe, date_forms, file_dates, question_windows,
    observation_dates, relation_states, composed_parts, currency_stamps, undecided_relations, admitted_entities, admitted_relations, type_noise, fact_links, lenient_json, place_strings, packed_rows, pointer_files,
)}

NAMES = """names AS (SELECT 'p' || p_partkey AS key, p_partkey AS k, p_type AS type, p_partkey % 18 = 1 AS exact, p_partkey % 6 IN (1, 3) AS is_value, p_partkey % 6 IN (2, 5) AS is_reference, p_partkey % 24 = 0 AS boilerplate,
    CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN p_size || ' mm' WHEN 2 THEN 'Figure ' || p_size WHEN 3 THEN p_size || ' V to ' || (p_size + 5) || ' V' WHEN 4 THEN 'ZK7C' || p_size || 'KV13' ELSE 'Rev *J' END AS title FROM part),
  gone AS (SELECT key, title FROM names WHERE is_value AND NOT exact AND k NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey % 30 = 3)),
  owned AS (SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target FROM lineitem)"""

SQL = {
    "cell_values": """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN o_orderstatus WHEN 1 THEN '(image)' WHEN 2 THEN CASE WHEN o_totalprice = floor(o_totalprice) THEN o_totalprice::bigint::varchar ELSE o_totalprice::varchar END WHEN 3 THEN o_orderkey::varchar
        WHEN 4 THEN CASE o_orderkey % 3 WHEN 0 THEN ((o_orderkey % 1000 + 5) // 10)::varchar WHEN 1 THEN printf('%.1f', (o_orderkey % 1000) / 10) ELSE printf('%.2f', (o_orderkey % 1000) / 10) END || '%'
        WHEN 5 THEN CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate + INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M:%S') END ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END END AS cell FROM orders""",
    "glued_rows": """SELECT p_partkey, line, CASE WHEN p_partkey % 3 = 0 THEN string_split(p_name, ' ')[line + 1] || '|' || p_brand || '|' || CASE line WHEN 0 THEN p_type ELSE 'x' END ELSE p_name || '|' || p_brand || '|' || p_type END AS row
        FROM part, (VALUES (0::bigint), (1::bigint)) v(line) WHERE line = 0 OR p_partkey % 3 = 0""",
    "jsonl_records": """SELECT event_id AS doc_id, unnest([1, 3, 4])::bigint AS line, unnest(['Record 1', 'Record 3: T' || event_type, 'Record 4']) AS title, unnest([true, true, false]) AS valid FROM events WHERE props IS NOT NULL""",
    "section_paths": """WITH p AS (SELECT source, CASE WHEN doc_id % 3 = 0 THEN ['a', 'z'] ELSE [CASE doc_id % 2 WHEN 0 THEN 'a' ELSE 'b' END, doc_id::varchar] END AS q FROM documents WHERE source <> 'src1' OR doc_id % 2 = 0)
        SELECT source, concat_ws('/', source, CASE WHEN count(DISTINCT q[1]) = 1 THEN any_value(q[1]) END, CASE WHEN count(DISTINCT q) = 1 THEN any_value(q[2]) END) AS common FROM p GROUP BY source""",
    "section_location": f"""WITH {CHUNKS}, r AS MATERIALIZED (SELECT * FROM chunks WHERE chunk_index < 6), s AS (SELECT doc_id, chunk_index // 2 AS section, regexp_replace(string_agg(text, ' ' ORDER BY chunk_index), '\\s+', '', 'g') AS body FROM r GROUP BY ALL)
        SELECT r.doc_id, chunk_index, count(*) AS sections, min(section) AS first, count(*) > 1 AS ambiguous FROM r JOIN s ON s.doc_id = r.doc_id AND contains(body, regexp_replace(substr(text, 1, 12), '\\s+', '', 'g')) GROUP BY ALL""",
    "embedding_prefixes": f"""WITH {CHUNKS} SELECT c.doc_id, chunk_index, substr(concat_ws(' > ', kb_id || '-' || lang, CASE WHEN chunk_index % 2 = 1 THEN 'Part ' || chunk_index END, nullif(repeat('long', chunk_index % 60), '')), 1, 200) AS prefix FROM chunks c JOIN documents d ON d.doc_id = c.doc_id""",
    "fact_identity": """SELECT 'f' || substr(sha256(concat_ws('|', l_orderkey, 'part-' || l_partkey, 'discount', l_linestatus, '', strftime(l_shipdate, '%Y'))), 1, 20) AS fact_id, count(*) AS n FROM lineitem GROUP BY 1""",
    "fact_renderings": """SELECT p_partkey, p_name || ' · size' || CASE WHEN p_partkey % 2 = 1 THEN ' (L)' ELSE '' END || ': ' || CASE WHEN p_partkey % 2 = 0 THEN p_size::varchar WHEN p_partkey % 4 = 1 THEN 'min ' || p_size || ' / max ' || (p_size + 5) ELSE 'max ' || (p_size + 5) END
        || CASE WHEN p_partkey % 3 = 0 THEN ' mm' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN ' | mode: ' || p_type || '; temp: 25' ELSE '' END
        || CASE WHEN p_partkey % 6 = 0 THEN ' | when: 2001~2003' WHEN p_partkey % 3 = 0 THEN ' | when: 2001' WHEN p_partkey % 3 = 1 THEN ' | when: 1999-05' ELSE '' END AS text FROM part""",
    "fact_states": """WITH q AS (SELECT *, CASE WHEN l_partkey % 11 = 0 OR l_partkey % 7 = 0 OR l_partkey % 13 = 0 THEN 'needs_review' ELSE 'extracted' END AS quality, CASE l_partkey % 4 WHEN 0 THEN 'abnormal' WHEN 1 THEN 'normal' END AS m,
        CASE WHEN l_partkey % 3 <> 0 AND l_partkey % 2 = 0 THEN CASE WHEN l_quantity < 10 OR l_quantity > 40 THEN 'abnormal' ELSE 'normal' END END AS b FROM lineitem)
        SELECT quality, CASE WHEN quality = 'needs_review' OR m <> b THEN 'uncertain' ELSE coalesce(m, b, 'unknown') END AS flag, count(*) AS n FROM q GROUP BY ALL""",
    "property_flags": "SELECT p_partkey, p_name AS property, CASE p_partkey % 3 WHEN 0 THEN 'High' WHEN 1 THEN '' ELSE '异常' END AS flag FROM part",
    "cell_dedupe": """SELECT 'c' || l_partkey AS cell, l_suppkey AS fact, count(*) AS merged, array_to_string(list_sort(list(DISTINCT l_orderkey)), ',') AS units, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS points FROM lineitem GROUP BY ALL HAVING count(*) > 1""",
    "date_forms": """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 5 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m') END AS a FROM orders) SELECT o_orderkey, a || '|1995' AS dates FROM o""",
    "file_dates": """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN CASE WHEN year(o_orderdate) <= 2000 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END WHEN 2 THEN strftime(o_orderdate, '%Y-%m')
        WHEN 3 THEN strftime(o_orderdate, '%Y') ELSE '' END AS date FROM orders WHERE year(o_orderdate) <= 2000 UNION ALL SELECT o_orderkey, '' FROM orders WHERE year(o_orderdate) > 2000""",
    "question_windows": """WITH w AS (SELECT p_size, CASE p_partkey % 8 WHEN 0 THEN '1996' WHEN 1 THEN '1997' WHEN 2 THEN '199' || (p_size % 10) WHEN 3 THEN '1999' WHEN 4 THEN '1998' WHEN 5 THEN '1995' WHEN 6 THEN '1996' END AS since,
        CASE p_partkey % 8 WHEN 0 THEN (1997 + p_size % 3)::varchar WHEN 1 THEN '1999' WHEN 2 THEN '1999' WHEN 3 THEN '1999' WHEN 4 THEN '1998' WHEN 5 THEN '1999' WHEN 6 THEN '1998' END AS until FROM part)
        SELECT since, until, coalesce((1990 + p_size % 10)::varchar BETWEEN since AND until, true) AS inside, count(*) AS n FROM w GROUP BY ALL""",
    "observation_dates": "SELECT CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS observed, count(*) AS n FROM orders GROUP BY 1",
    "relation_states": """WITH q AS (SELECT l_partkey AS k, CASE WHEN l_partkey % 17 = 0 OR l_partkey % 13 = 0 OR l_partkey % 11 = 0 OR l_partkey % 5 = 0 THEN 'needs_review' ELSE 'extracted' END AS quality FROM lineitem)
        SELECT quality, quality = 'extracted' AND k % 5 <> 1 AND k % 7 <> 0 AND k % 4 <> 0 AS traversable, count(*) AS n FROM q GROUP BY ALL""",
    "composed_parts": """WITH c AS (SELECT CASE l_linenumber % 4 WHEN 1 THEN l_suppkey % 60 ELSE l_partkey % 60 END AS w, CASE l_linenumber % 4 WHEN 1 THEN l_partkey % 60 ELSE l_suppkey % 60 END AS p FROM lineitem WHERE l_linenumber % 4 <> 2 AND l_orderkey % 3 > 0)
        SELECT DISTINCT 'p' || w AS whole, 'p' || p AS part FROM c WHERE w <> p AND p % 9 <> 0 AND p % 10 <> 1""",
    "currency_stamps": """WITH r AS (SELECT DISTINCT l_partkey || '-' || l_suppkey AS relation, l_orderkey FROM lineitem), u AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderkey % 3 <> 0)
        SELECT relation, min(day) AS observed_first, max(day) AS observed_last FROM r LEFT JOIN u ON o_orderkey = l_orderkey GROUP BY relation""",
    "undecided_relations": "SELECT l_partkey AS source, l_returnflag AS predicate, count(DISTINCT l_suppkey) AS targets FROM lineitem WHERE l_linenumber > 2 AND l_returnflag IN ('A', 'R') GROUP BY ALL HAVING count(DISTINCT l_suppkey) > 1",
    "admitted_entities": f"""WITH {NAMES}, e AS (SELECT key, title, NOT exact AND is_reference AS reference FROM names WHERE key NOT IN (SELECT key FROM gone) UNION ALL SELECT 's' || s_suppkey, s_name, false FROM supplier),
        a AS (SELECT source AS key, count(DISTINCT title) AS attributes FROM owned JOIN gone ON gone.key = target GROUP BY 1) SELECT e.key, title, reference, attributes FROM e LEFT JOIN a ON a.key = e.key""",
    "admitted_relations": f"WITH {NAMES} SELECT source, count(*) AS n FROM owned WHERE target NOT IN (SELECT key FROM gone) GROUP BY source",
    "type_noise": f"""WITH {NAMES}, s AS (SELECT type, count(*) AS names, count_if(is_value)::bigint AS values, count_if(is_reference)::bigint AS references, count_if(NOT is_value AND boilerplate)::bigint AS boilerplate FROM names GROUP BY type)
        SELECT *, round((values + s.references + boilerplate) / names, 3) AS noise, names >= 5 AND round((values + s.references + boilerplate) / names, 3) >= 0.5 AND names - values - s.references > 0 AS demoted FROM s""",
    "fact_links": """WITH p AS (SELECT p_partkey AS key, p_name AS name, p_partkey % 50 AS doc_id FROM part), f AS (SELECT l_suppkey % 60 AS doc_id, CASE WHEN key % 7 <> 0 THEN name END AS name FROM lineitem JOIN p ON key = l_partkey),
        o AS (SELECT name, doc_id, count(*) AS n, min(key) AS key FROM p GROUP BY ALL), a AS (SELECT name, count(*) AS n, min(key) AS key FROM p GROUP BY ALL)
        SELECT CASE WHEN o.n = 1 THEN 'document' WHEN o.n > 1 THEN 'ambiguous' WHEN a.n = 1 THEN 'library' WHEN a.n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS scope, CASE WHEN o.n = 1 THEN o.key WHEN o.n IS NULL AND a.n = 1 THEN a.key END AS key, count(*) AS n
        FROM f LEFT JOIN o ON o.name = f.name AND o.doc_id = f.doc_id LEFT JOIN a ON a.name = f.name GROUP BY 1, 2""",
    "lenient_json": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END::bigint AS objects, CASE WHEN p_partkey % 4 < 3 THEN p_name END AS first FROM part",
    "place_strings": """SELECT CASE l_linenumber WHEN 1 THEN 'page ' || l_partkey || ' · X / Y' WHEN 2 THEN 'pages ' || l_partkey || '–' || (l_partkey + 3) WHEN 3 THEN 'line ' || l_suppkey WHEN 4 THEN 'rows ' || l_suppkey || '–' || (l_suppkey + 2)
        WHEN 5 THEN substr(repeat('head', 20), 1, 59) || '…' WHEN 6 THEN 'B' ELSE '' END AS position, count(*) AS n FROM lineitem GROUP BY 1""",
    "packed_rows": """WITH RECURSIVE r AS (SELECT p_brand AS sheet, p_partkey AS row_no, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i, greatest(1, length(concat_ws(' | ', p_partkey, p_name, p_type, p_size)) // 4) AS t FROM part),
        h AS (SELECT DISTINCT sheet, greatest(1, length('SHEET: ' || sheet || chr(10) || 'HEADER: key | name | type | size') // 4) AS h FROM r),
        b AS (SELECT r.sheet, i, row_no AS first, row_no AS last, h + t AS tokens, h FROM r JOIN h USING (sheet) WHERE i = 1 UNION ALL
          SELECT b.sheet, r.i, CASE WHEN b.tokens + t > 60 THEN r.row_no ELSE b.first END, r.row_no, CASE WHEN b.tokens + t > 60 THEN b.h + t ELSE b.tokens + t END, b.h FROM b JOIN r ON r.sheet = b.sheet AND r.i = b.i + 1)
        SELECT sheet, first, max(last) AS last, max_by(tokens, last)::bigint AS tokens FROM b GROUP BY sheet, first""",
    "pointer_files": "SELECT concat(source, '/', lang, '/', doc_id, '.txt') AS rel_path FROM documents WHERE doc_id % 6 = 0",
}
