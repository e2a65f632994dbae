"""Queries over parsers, cuts and table versions on contents made from the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import chunking, evidence, ontology
from quillmark.operators.graph import scratch
from quillmark.plans.record_queries import picked
from quillmark.sources import parsers as P
from quillmark.sources.catalog import Catalog
from quillmark.sources.tables import load


def parts(spark, d, content):
    return load(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), content.alias("content"))


def text_decode(spark, d):
    name = F.encode("p_name", "UTF-8")
    content = picked(F.col("p_partkey"), 4, F.concat(F.unhex(F.lit("EFBBBF")), name), F.concat(F.unhex(F.lit("FFFE")), F.encode("p_name", "UTF-16LE")), F.encode(F.concat("p_name", F.lit("é")), "UTF-8"), F.unhex(F.lit("B0B2")))
    return P.table_function(parts(spark, d, content), "content", lambda b: [(P.decode(bytes(b)),)], "doc_id long, text string")


def text_clean(spark, d):
    text = F.concat(F.lit("a\x00b\r\n\r\n\r\n\n"), "p_name", F.lit(" \t  x\rend \x07"))
    return parts(spark, d, text).select("doc_id", T.clean("content").alias("text"))


def frontmatter_fields(spark, d):
    md = F.concat(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("---\ntitle: 'T"), "p_name", F.lit("'\n kind : x:y\nno pair\n---\n"))).otherwise(F.lit("")), F.lit("Body: not a field"))
    return P.table_function(parts(spark, d, md), "content", lambda t: list(P.frontmatter(t)[0].items()), "doc_id long, field string, value string")


def comment_strip(spark, d):
    md = F.concat(F.lit("a<!-- x\n -->"), "p_name", F.lit(" `<!-- y -->`\n```\n<!-- z -->\n```\n<!-- open"))
    return P.table_function(parts(spark, d, md), "content", lambda t: [(P.strip_comments(t),)], "doc_id long, text string")


def html_tables(spark, d):
    page = F.concat(F.lit("<table><tr><th rowspan=2>A</th><th colspan='2'>B "), "p_name", F.lit("</th></tr><tr><td>c <b>d</b></td><td>e</td></tr></table>"))
    return P.table_function(parts(spark, d, page), "content", lambda t: [(i, "|".join(r)) for i, r in enumerate(P.html_grid(t))], "doc_id long, line long, row string")


def csv_cells(spark, d):
    text = F.concat(F.lit('name;size\n\n"a; '), "p_name", F.lit('";'), "p_size", F.lit("\n;\n"))
    return P.table_function(parts(spark, d, text), "content", P.csv_rows, "doc_id long, line long, cells string")


def notebook_blocks(spark, d):
    text = F.concat(F.lit('{"cells": [{"cell_type": "markdown", "source": ["# ", "'), "p_name", F.lit('"]}, {"cell_type": "code", "source": "1+1", "outputs": [{"text": ["2"]}, {"data": {"text/plain": ["3"]}}, {"data": {"image/png": "x"}}]}]}'))
    return P.table_function(parts(spark, d, text), "content", P.notebook_cells, P.BLOCKS).select("doc_id", "block_ord", "block_type", "text")


def markup_sections(spark, d):
    kind = picked(F.col("p_partkey"), 3, F.lit("latex"), F.lit("bibtex"), F.lit("rst"))
    text = picked(F.col("p_partkey"), 3, F.concat(F.lit("\\section{One "), "p_name", F.lit("}\ntext\n\\subsection*{Two}\nmore")), F.concat(F.lit("@book{k"), "p_partkey", F.lit(",\n title = {x}\n}\n@misc{m,\n}")), F.concat("p_name", F.lit("\n=====\ntext\n\nLast\n----\n")))
    return P.table_function(parts(spark, d, F.concat_ws("\x1f", kind, text)), "content", lambda t: P.markup_sections(*reversed(t.split("\x1f"))), "doc_id long, name string, first long, last long")


def python_blocks(spark, d):
    source = F.concat(F.lit("class A"), "p_partkey", F.lit(':\n    """Doc."""\n    def f(self):\n        return 1\n\nasync def g():\n    pass\n'), F.when(F.col("p_partkey") % 5 == 4, "def broken(:").otherwise(""))
    return P.table_function(parts(spark, d, source), "content", P.python_symbols, "doc_id long, name string, kind string, first long, last long, doc string")


def code_blocks(spark, d):
    source = F.concat(F.lit("import x\nexport async function f"), "p_partkey", F.lit("(a) {\n  return 1\n}\nclass B {\n}\n"))
    return P.table_function(parts(spark, d, source), "content", lambda t: P.code_symbols(t, "js"), "doc_id long, name string, first long, last long")


def long_cuts(spark, d):
    """Sentences over the budget in longest prefixes; their concatenation is the sentence."""
    text = F.when(F.col("p_partkey") % 2 == 0, F.repeat(F.lit("字"), F.col("p_size").cast("int"))).otherwise(F.repeat(F.lit("word "), (F.col("p_size") * 3).cast("int")))
    cut = lambda t: [(len(x := chunking.cut_long(t, 10)), len(x[0]), "".join(x) == t)]
    return P.table_function(parts(spark, d, text), "content", cut, "doc_id long, parts long, first long, whole boolean")


def code_splits(spark, d):
    text = F.repeat(F.lit("y" * 19 + "\n"), F.col("p_size").cast("int"))
    cut = lambda t: [(len(x := chunking.split_code(t, 10)), "".join(x) == t)]
    return P.table_function(parts(spark, d, text), "content", cut, "doc_id long, parts long, whole boolean")


def table_splits(spark, d):
    text = F.concat(F.lit("| a | b |\n|---|---|"), F.repeat(F.lit("\n| 1234 | 5678 |"), F.col("p_size").cast("int")))
    cut = lambda t: [(len(x := chunking.split_table(t, 16)), all(p.startswith("| a | b |\n|---|---|") for p in x), sum(p.count("1234") for p in x))]
    return P.table_function(parts(spark, d, text), "content", cut, "doc_id long, parts long, headed boolean, rows long")


def fact_splits(spark, d):
    text = F.concat(F.lit("TITLE: t"), F.repeat(F.lit("\nFACTS: of twenty-four ch."), F.col("p_size").cast("int")))
    cut = lambda t: [(len(x := chunking.split_facts(t, 30)), all(p.startswith("TITLE: t\nFACTS") for p in x), sum(p.count("FACTS") for p in x))]
    return P.table_function(parts(spark, d, text), "content", cut, "doc_id long, parts long, headed boolean, facts long")


def segment_runs(spark, d):
    text = F.concat("p_name", F.lit("\n```py\ncode | x | y\n```\n| a | b |\n| c | d |\n\nend"))
    return P.table_function(parts(spark, d, text), "content", lambda t: [(i, k, len(x)) for i, (k, x) in enumerate(chunking.segments(t))], "doc_id long, at long, kind string, chars long")


def glued_pieces(spark, d):
    """Tiny prose pieces join the one before within the budget and its slack; code and long ones don't."""
    text = F.concat_ws("\x1f", F.repeat(F.lit("long "), 20), "p_name", F.lit("code"), F.repeat(F.lit("q"), (F.col("p_size") * 8).cast("int")))
    glue = lambda t: [(i, k, len(x)) for i, (k, x) in enumerate(chunking.glue(list(zip(("prose", "prose", "code", "prose"), t.split("\x1f"), strict=True)), 40))]
    return P.table_function(parts(spark, d, text), "content", glue, "doc_id long, at long, kind string, chars long")


def repeat_drops(spark, d):
    text = F.concat(F.lit("start and the end of "), "p_name", F.lit("\x1f"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("the end of "), "p_name", F.lit(" goes on"))).otherwise(F.concat("p_name", F.lit(" alone"))))
    return P.table_function(parts(spark, d, text), "content", lambda t: [(chunking.drop_repeat(*t.split("\x1f"), least=15),)], "doc_id long, text string")


def excerpts(spark, d):
    text = F.concat("p_name", F.lit("\x1fFirst sentence here. The "), "p_name", F.lit(" is good. Last one."))
    cut = lambda t: [(evidence.excerpt(t.split("\x1f")[1], set(t.split("\x1f")[0].split()), 8),)]
    return P.table_function(parts(spark, d, text), "content", cut, "doc_id long, excerpt string")


def schema_round_trip(spark, d):
    """Types of nations and regions, and a predicate, to the interchange form and back."""
    rows = load(spark, d, "nation").join(load(spark, d, "region"), F.expr("n_regionkey = r_regionkey")).select("n_name", "r_name").collect()
    types = [{"name": f" {r.n_name} ", "is_a": r.r_name} for r in rows] + [{"name": n} for n in {r.r_name for r in rows}] + [{"name": "Stray", "is_a": "nowhere"}]
    model = ontology.normalised({"types": types, "predicates": [{"name": "Borders On!", "source": [rows[0].n_name, "unknown"] if rows else [], "target": ["*"]}]})
    back = ontology.from_linkml(ontology.to_linkml(model, "world", "1"))
    found = [(t["name"], t["is_a"]) for t in back["types"]] + [(p["name"], "|".join(p["target"])) for p in back["predicates"]]
    return spark.createDataFrame(found, "name string, parent string")


def compacted_table(spark, d):
    catalog = Catalog(spark, scratch(spark, "compaction"))
    catalog.write(load(spark, d, "orders").select("o_orderkey", "o_orderstatus").repartition(7), "orders")
    catalog.compact("orders", 2)
    rows = catalog.read("orders")
    files = rows.select(F.input_file_name().alias("f")).distinct().agg(F.count("*").alias("files"))
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n")).crossJoin(F.broadcast(files))


def rolled_back(spark, d):
    """A table after a new version and the return to the old one; a pinned reader keeps to what it began with."""
    catalog = Catalog(spark, scratch(spark, "rollback"))
    rows = load(spark, d, "customer").select("c_mktsegment")
    first = catalog.write(rows, "c")
    second = catalog.write(rows.where("c_mktsegment <> 'BUILDING'"), "c")
    count = lambda version, name: catalog.read("c", version).groupBy("c_mktsegment").agg(F.count("*").alias(name))
    newest = count(None, "newest")
    catalog.activate("c", first)
    return count(None, "now").join(newest, "c_mktsegment", "left").join(count(second, "pinned"), "c_mktsegment", "left")


QUERIES = {f.__name__: f for f in (
    text_decode, text_clean, frontmatter_fields, comment_strip, html_tables, csv_cells, notebook_blocks, markup_sections, python_blocks, code_blocks, long_cuts, code_splits, table_splits, fact_splits, segment_runs, glued_pieces, repeat_drops,
    excerpts, schema_round_trip, compacted_table, rolled_back,
)}

SQL = {
    "text_decode": "SELECT p_partkey AS doc_id, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN p_name || 'é' ELSE '安' END AS text FROM part",
    "text_clean": "SELECT p_partkey AS doc_id, 'ab' || chr(10) || chr(10) || p_name || ' x' || chr(10) || 'end' AS text FROM part",
    "frontmatter_fields": "SELECT p_partkey AS doc_id, unnest(['title', 'kind']) AS field, unnest(['T' || p_name, 'x:y']) AS value FROM part WHERE p_partkey % 2 = 0",
    "comment_strip": "SELECT p_partkey AS doc_id, 'a' || p_name || ' `<!-- y -->`' || chr(10) || '```' || chr(10) || '<!-- z -->' || chr(10) || '```' || chr(10) AS text FROM part",
    "html_tables": "SELECT p_partkey AS doc_id, unnest([0, 1])::bigint AS line, unnest(['A|B ' || p_name || '|B ' || p_name, 'A|c d|e']) AS row FROM part",
    "csv_cells": """SELECT p_partkey AS doc_id, unnest([1, 3])::bigint AS line, unnest(['["name", "size"]', '["a; ' || p_name || '", "' || p_size || '"]']) AS cells FROM part""",
    "notebook_blocks": "SELECT p_partkey AS doc_id, unnest([0, 1])::bigint AS block_ord, unnest(['markdown', 'code']) AS block_type, unnest(['# ' || p_name, '1+1' || chr(10) || '2' || chr(10) || '3']) AS text FROM part",
    "markup_sections": """SELECT p_partkey AS doc_id, unnest(CASE p_partkey % 3 WHEN 0 THEN ['One ' || p_name, 'Two'] WHEN 1 THEN ['k' || p_partkey, 'm'] ELSE [p_name, 'Last'] END) AS name,
        unnest(CASE p_partkey % 3 WHEN 0 THEN [1, 3] WHEN 1 THEN [1, 4] ELSE [1, 5] END)::bigint AS first, unnest(CASE p_partkey % 3 WHEN 0 THEN [2, 4] WHEN 1 THEN [3, 5] ELSE [4, 7] END)::bigint AS last FROM part""",
    "python_blocks": """SELECT p_partkey AS doc_id, unnest(['A' || p_partkey, 'A' || p_partkey || '.f', 'g']) AS name, unnest(['class', 'function', 'function']) AS kind, unnest([1, 3, 6])::bigint AS first, unnest([4, 4, 7])::bigint AS last, unnest(['Doc.', '', '']) AS doc FROM part WHERE p_partkey % 5 <> 4""",
    "code_blocks": "SELECT p_partkey AS doc_id, unnest(['f' || p_partkey, 'B']) AS name, unnest([2, 5])::bigint AS first, unnest([4, 7])::bigint AS last FROM part",
    "long_cuts": "SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN ceil(p_size / 9) ELSE ceil(p_size * 15 / 43) END::bigint AS parts, CASE WHEN p_partkey % 2 = 0 THEN least(9, p_size) ELSE least(43, p_size * 15) END::bigint AS first, true AS whole FROM part",
    "code_splits": "SELECT p_partkey AS doc_id, ceil(p_size / 2)::bigint AS parts, true AS whole FROM part",
    "table_splits": "SELECT p_partkey AS doc_id, greatest(1, ceil(p_size / 3))::bigint AS parts, true AS headed, p_size::bigint AS rows FROM part",
    "fact_splits": "SELECT p_partkey AS doc_id, ceil(p_size / 4)::bigint AS parts, true AS headed, p_size::bigint AS facts FROM part WHERE p_size > 0",
    "segment_runs": "SELECT p_partkey AS doc_id, unnest([0, 1, 2, 3])::bigint AS at, unnest(['prose', 'code', 'table', 'prose']) AS kind, unnest([length(p_name), 22, 19, 4])::bigint AS chars FROM part",
    "glued_pieces": """SELECT p_partkey AS doc_id, unnest([0, 1, 2])::bigint AS at, unnest(['prose', 'code', 'prose']) AS kind, unnest([101 + length(p_name), 4, p_size * 8])::bigint AS chars FROM part""",
    "repeat_drops": "SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN 'goes on' ELSE p_name || ' alone' END AS text FROM part",
    "excerpts": "SELECT p_partkey AS doc_id, 'The ' || p_name || ' is good. Last one.' AS excerpt FROM part",
    "schema_round_trip": "SELECT n_name AS name, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT DISTINCT r_name, '' FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 'Stray', '' UNION ALL SELECT 'borders_on', '*'",
    "compacted_table": "SELECT o_orderstatus, count(*) AS n, 2::bigint AS files FROM orders GROUP BY 1",
    "rolled_back": "SELECT c_mktsegment, count(*) AS now, CASE WHEN c_mktsegment <> 'BUILDING' THEN count(*) END AS newest, CASE WHEN c_mktsegment <> 'BUILDING' THEN count(*) END AS pinned FROM customer GROUP BY 1",
}
