"""Covers, stitching, excerpts, concepts, periods and code relations."""

from quillmark.operators import code_graph, concepts, evidence


def test_excerpt_takes_the_best_run_within_the_budget():
    text = "Nothing here at all. The red pump is loud. Its flow is high. Other words follow."
    assert evidence.excerpt(text, {"red", "flow"}, 10) == "The red pump is loud. Its flow is high."
    assert evidence.excerpt("", {"x"}, 5) == ""


def test_stitching_alternates_and_stays_within_the_limit(spark):
    chunks = spark.createDataFrame([(1, i, c * n) for i, (c, n) in enumerate([("a", 300), ("b", 300), ("c", 50), ("d", 100), ("e", 900)])], "doc_id long, chunk_index long, text string")
    hits = spark.createDataFrame([(1, 2), (1, 4)], "doc_id long, chunk_index long")
    got = {r.hit: (r.first, r.last) for r in evidence.stitched(hits, chunks, 350, 850).collect()}
    assert got == {2: (1, 3), 4: (4, 4)}


def test_concepts_keep_contrasts_and_units_apart(spark):
    names = spark.createDataFrame([("input voltage", "V", 5), ("input voltage range", "V", 2), ("output voltage", "V", 9), ("input voltage mm", "mm", 1), ("alone", "", 1)], "name string, unit string, n long")
    pairs = spark.createDataFrame([("input voltage", "input voltage range", 0.95), ("input voltage", "output voltage", 0.97), ("input voltage", "input voltage mm", 0.9)], "a string, b string, similarity double")
    got = dict(map(tuple, concepts.build(names, pairs).collect()))
    assert got == {"input voltage": "input voltage", "input voltage range": "input voltage", "output voltage": "output voltage", "input voltage mm": "input voltage mm", "alone": "alone"}


def test_periods_follow_declarations(spark):
    rows = spark.createDataFrame([(1, 0, "year ended 2023-06-30"), (1, 1, "FY2024 plan"), (1, 2, "x"), (2, 0, "Q1 FY 2024")], "doc_id long, chunk_index long, text string")
    got = {(r.doc_id, r.chunk_index): r.period for r in concepts.time_contexts(rows).collect()}
    assert got == {(1, 0): "2023-06-30", (1, 1): "FY2024 to 2024-06-30", (1, 2): "FY2024 to 2024-06-30", (2, 0): "unknown"}


def test_imports_resolve_to_one_file_or_say_why(spark):
    files = spark.createDataFrame([("a/x/u.py", "import x.v\nimport w\nimport os"), ("a/x/v.py", "def f(): pass"), ("a/w.py", ""), ("b/w.py", ""), ("c.py", "f()\ndef (")], "path string, source string")
    got = {(r.name, r.state, r.target) for r in code_graph.resolved_imports(code_graph.relations(files), files).collect()}
    assert got == {("x.v", "internal", "a/x/v.py"), ("w", "ambiguous", None), ("os", "external", None)}
