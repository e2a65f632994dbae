"""Parsers, chunkers, units and text rules on small inputs."""

import io
import json
import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmark.functions import facts as V
from quillmark.functions import text as T
from quillmark.operators import chunking as C
from quillmark.operators import units
from quillmark.sources import parsers as P


def one(spark, expression, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return frame.select(expression.alias("x")).first()[0]


def test_markdown_sections_fences_and_front_matter():
    md = "---\ntitle: Doc\n---\n<!-- gone -->\n# One\ntext `<!-- kept -->`\n```\n# not a heading\n```\n## Two\n\nThree\n=====\nend"
    got = P.markdown_blocks(md)
    assert [(t, s) for _, _, t, s, _ in got] == [("Doc", ""), ("One", "One"), ("Two", "One > Two"), ("Three", "Three")]
    assert "# not a heading" in got[1][4] and "<!-- kept -->" in got[1][4] and "gone" not in got[1][4] and got[2][1] == "title"


def test_html_blocks_and_spans():
    got = P.html_blocks("<body><nav>menu</nav><h1>T</h1><p>a <b>b</b></p><table><tr><th>x<th>y<tr><td>1<td>2</table><h2>U</h2>c<script>no</script>")
    assert [(k, s, t) for _, k, _, s, t in got] == [("text", "T", "a b"), ("table", "T", "| x | y |\n| --- | --- |\n| 1 | 2 |"), ("text", "T > U", "c")]
    assert P.html_grid("<table><tr><td rowspan=2>a<td colspan='2'>b<tr><td>c<td>d</table>") == [["a", "b", "b"], ["a", "c", "d"]]


def test_tables_and_records():
    assert [n for n, _ in P.csv_rows("a,b\n\n1,2\n , \n3,4\n")] == [1, 3, 5]
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>2</v></c></row><row><c r="B2" t="inlineStr"><is><t>x</t></is></c></row></sheetData><mergeCells><mergeCell ref="A1:A2"/></mergeCells></worksheet>'
    shared = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>name</t></si></sst>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", shared)
    assert [(s, r, json.loads(c)) for s, r, c in P.xlsx_rows(data.getvalue())] == [("sheet1", 1, ["name", "2"]), ("sheet1", 2, ["name", "x"])]
    assert P.config_fields('{"a": {"b": [1, true]}, "c": null}') == [("a.b[0]", "1"), ("a.b[1]", "true"), ("c", "null")]
    assert P.config_fields("[s]\nk = 1\n") == [("s.k", "1")] and P.config_fields("::") == []
    cells = P.notebook_cells(json.dumps({"cells": [{"cell_type": "code", "source": ["x"], "outputs": [{"text": ["1"]}]}]}))
    assert cells == [(0, "code", "", "", "x\n1")]


def test_code_symbols():
    source = 'class A:\n    """doc"""\n    def f(self):\n        pass\n\ndef g(): pass\n'
    assert [(n, k, a, b) for n, k, a, b, _ in P.python_symbols(source)] == [("A", "class", 1, 4), ("A.f", "function", 3, 4), ("g", "function", 6, 6)]
    assert P.python_symbols("def (") == [] and P.code_symbols("func A() {\n}\ntype B struct {}", "go") == [("A", 1, 2), ("B", 3, 3)]
    assert P.markup_sections("\\section{One}\nx\n\\subsection{Two}\ny", "latex") == [("One", 1, 2), ("Two", 3, 4)]
    assert P.decode("é".encode()) == "é" and P.decode("é".encode("utf-16")) == "é" and P.decode("中".encode("gb18030")) == "中"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n|中.`#", max_size=300), st.integers(5, 40))
def test_code_split_loses_nothing(text, most):
    parts = C.split_code(text, most)
    assert "".join(parts) == text and all(C.approx_tokens(p) <= most for p in parts)
    assert "".join(C.cut_long(text, most)) == text


def test_packing_keeps_sentences_within_the_budget():
    rng = random.Random(1)
    parts = [f"s{i} " + "w" * rng.randrange(80) + "." for i in range(200)]
    out = C.pack(parts, 40, 10)
    assert all(sum(C.approx_tokens(s) + 1 for s in c.split("\n")) <= 40 for c in out)
    seen = [s for c in out for s in c.split("\n")]
    assert list(dict.fromkeys(seen)) == parts
    headed = C.pack(["x" * 100, "Chapter 2 begins", "y" * 40], 40, 10)
    assert headed[1].startswith("Chapter 2")
    assert C.pack(["body.", "Chapter 3"], 40, 10) == ["body.", "Chapter 3"]


def test_table_split_repeats_the_header():
    out = C.split_table("| a | b |\n|---|---|\n" + "\n".join(f"| {i} | {'v' * 20} |" for i in range(20)), 40)
    assert len(out) > 1 and all(x.startswith("| a | b |\n|---|---|\n") for x in out)
    assert sum(x.count("v" * 20) for x in out) == 20
    assert C.split_table("| a |\n|---|\n| " + "v" * 400 + " |", 40)[0].startswith("a: ")


def test_overlap_and_segments():
    assert C.drop_repeat("the end of the chunk", "end of the chunk and more") == "and more"
    assert C.drop_repeat("abc", "abc def") == "abc def"
    assert [k for k, _ in C.segments("p\n```\nc | d | e\n```\n| a | b |\n| 1 | 2 |\nq")] == ["prose", "code", "table", "prose"]


def test_units_cut_at_sections(spark):
    rows = [(1, i, s, f"text {i} of some length") for i, s in enumerate("aabbbbc")]
    got = units.sectioned_units(spark.createDataFrame(rows, "doc_id long, chunk_index long, section string, text string"), 3).orderBy("ord").collect()
    assert [(r.chunk_from, r.chunk_to) for r in got] == [(0, 1), (2, 4), (5, 6)]


@pytest.mark.parametrize(
    ("value", "kind", "number"), [("0.160", "scalar", 0.16), ("-40°C", "scalar", -40.0), ("≤ 10", "scalar", 10.0), ("2.7 to 3.6", "range", None), ("V_CC + 0.5", "expression", None), ("n/a", "text", None), ("20/25/45", "text", None), ("", "empty", None)]
)
def test_values(spark, value, kind, number):
    assert one(spark, V.value_kind("v"), v=value) == kind and one(spark, V.value_number("v"), v=value) == number


@pytest.mark.parametrize(("unit", "canonical"), [("MW", "MW"), ("mw", "mW"), ("mHz", "mHz"), (" MHZ", "MHz"), ("seconds", "s"), ("parsec", "parsec"), ("", "")])
def test_units_keep_mega_and_milli(spark, unit, canonical):
    assert one(spark, V.canonical_unit("u"), u=unit) == canonical


@pytest.mark.parametrize(("value", "day"), [("2024", "2024-12-31"), ("2024-02", "2024-02-29"), ("2024-02-03", "2024-02-03"), ("2024-13", None), ("x", None)])
def test_days(spark, value, day):
    assert one(spark, V.day_of("v"), v=value) == day


@pytest.mark.parametrize(("start", "until", "day", "status"), [("2024", "", "2024-06-30", "current"), ("2025", "", "2024-06-30", "not_started"), ("", "2024", "2025-01-01", "ended"), ("", "2024", "2024-06-30", "current"), ("2024-07", "", "2024-06-30", "not_started")])
def test_as_of(spark, start, until, day, status):
    assert one(spark, V.as_of_status(F.col("s"), F.col("u"), F.lit(True), F.col("d")), s=start, u=until, d=day) == status


def test_text_rules(spark):
    assert one(spark, T.approx_tokens("t"), t="中文 abcdefgh") == 2 + 2 and one(spark, T.language("t"), t="中文 ab") == "mixed"
    assert one(spark, T.sentences("t"), t="One. Two 3.14! 三。四\n\nfive") == ["One.", "Two 3.14!", "三。", "四", "five"]
    assert one(spark, T.ancestors("t"), t="a//b\\c/d.txt") == ["a", "a/b", "a/b/c"]
    assert one(spark, V.dice(F.col("a"), F.col("b")), a="night", b="nacht") == 0.25
    assert one(spark, V.canonical_identifier("a"), a="LM-317 2.5_V") == "lm317-2-5v"
