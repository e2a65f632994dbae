"""Document parsers: file contents to typed blocks in document order, as Arrow-batched table functions.

Every parser takes a DataFrame with ``doc_id`` and its content and fans out rows; null contents give no rows.
"""

from __future__ import annotations

import ast
import configparser
import csv
import io
import json
import re
import tomllib
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions.text import suffix

BLOCKS = "doc_id long, block_ord long, block_type string, title string, section_path string, text string"
# Formats by suffix, and element kinds of web pages.
ROUTES = {
    "md": "markdown", "html": "html", "htm": "html", "csv": "table", "tsv": "table", "xlsx": "workbook", "ipynb": "notebook", "jsonl": "records", "json": "config", "toml": "config", "ini": "config", "cfg": "config",
    "py": "python", "js": "code", "ts": "code", "go": "code", "rs": "code", "java": "code", "c": "code", "cpp": "code", "tex": "latex", "rst": "rst", "bib": "bibtex", "xsd": "schema", "txt": "text",
}
NOISE = frozenset("script style noscript template nav footer aside form button svg iframe head".split())
BLOCK_TAGS = frozenset("p div section article main li pre blockquote td th tr table ul ol dl dt dd br hr h1 h2 h3 h4 h5 h6 body".split())
SYMBOLS = {
    "js": r"^\s*(?:export\s+)?(?:async\s+)?(?:function\s+(\w+)|class\s+(\w+))", "ts": r"^\s*(?:export\s+)?(?:async\s+)?(?:function\s+(\w+)|class\s+(\w+)|interface\s+(\w+))", "go": r"^(?:func\s+(?:\([^)]*\)\s*)?(\w+)|type\s+(\w+))",
    "rs": r"^\s*(?:pub\s+)?(?:fn\s+(\w+)|struct\s+(\w+)|enum\s+(\w+)|trait\s+(\w+))", "java": r"^\s*(?:public|private|protected|static|final|abstract|\s)*(?:class|interface|enum)\s+(\w+)", "c": r"^[A-Za-z_][\w\s*]*\s+\**(\w+)\s*\([^;]*\)\s*\{?\s*$", "cpp": r"^[A-Za-z_][\w\s*:<>&]*\s+[*&]*(\w+)\s*\([^;]*\)\s*\{?\s*$",
}


def scan_folder(spark: SparkSession, root: str) -> DataFrame:
    """Files below a folder with their content, size and time; hidden ones are skipped by Spark's listing."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return rows.select("path", F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), F.sha2("content", 256).alias("checksum"), "content")


def route(path: str | Column) -> Column:
    """Parser of a path by its suffix; null for unknown formats."""
    table = F.create_map(*[F.lit(x) for pair in ROUTES.items() for x in pair])
    return table[suffix(path)]


def is_pointer(content: Column) -> Column:
    """Git-LFS pointer files hold no content of their own."""
    return F.coalesce(F.startswith(content.cast("string"), F.lit("version https://git-lfs")), F.lit(False))


def decode(data: bytes) -> str:
    """By byte order mark, else UTF-8, else GB18030 with replacement."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("gb18030", "replace")


def table_function(rows: DataFrame, content: str, parse: Callable[[object], list[tuple]], schema: str) -> DataFrame:
    """Apply ``parse(content)`` to each row and give its tuples with the row's doc_id."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(doc, *x) for doc, c in zip(f["doc_id"], f["c"], strict=True) if c is not None for x in parse(c)]
            yield pd.DataFrame(out, columns=names)

    return rows.select("doc_id", F.col(content).alias("c")).where("c is not null").mapInPandas(run, schema)


def frontmatter(md: str) -> tuple[dict[str, str], str]:
    """Flat key: value pairs between leading --- lines, and the rest."""
    m = re.match(r"---\n(.*?)\n---\n?", md, re.S)
    if not m:
        return {}, md
    pairs = (line.partition(":") for line in m[1].split("\n") if ":" in line)
    return {k.strip(): v.strip().strip("\"'") for k, _, v in pairs}, md[m.end() :]


def strip_comments(md: str) -> str:
    """HTML comments outside fences and inline code go."""
    parts = re.split(r"(```.*?(?:```|\Z)|`[^`\n]*`)", md, flags=re.S)
    return "".join(p if i % 2 else re.sub(r"<!--.*?(?:-->|\Z)", "", p, flags=re.S) for i, p in enumerate(parts))


def markdown_blocks(md: str) -> list[tuple]:
    """A block for the front matter and for each headed section; headings inside fences are text."""
    meta, body = frontmatter(strip_comments(md.replace("\r\n", "\n")))
    out = [(0, "frontmatter", meta.get("title") or meta.get("name") or "", "", "\n".join(f"{k}: {v}" for k, v in meta.items()))] if meta else []
    path: list[tuple[int, str]] = []
    title, held, fence = "", [], ""

    def close() -> None:
        text = "\n".join(held).strip()
        if text or title:
            out.append((len(out), "text" if text else "title", title, " > ".join(t for _, t in path), text))

    lines = body.split("\n")
    for i, line in enumerate(lines):
        m = re.match(r"\s*(`{3,}|~{3,})", line)
        if m and (not fence or (line.strip().startswith(fence) and line.strip().strip(fence[0]) == "")):
            fence = "" if fence else m[1]
        head = None if fence else re.match(r"(#{1,6})\s+(.*?)\s*#*$", line)
        level, name = (len(head[1]), head[2]) if head else (0, "")
        if not fence and not head and held and held[-1].strip() and (s := re.fullmatch(r"\s*(=+|-{2,})\s*", line)):
            level, name = (1 if s[1][0] == "=" else 2), held.pop().strip()
        if level:
            close()
            path = [p for p in path if p[0] < level] + [(level, name)]
            title, held = name, []
        elif fence or not re.fullmatch(r"\s*([-*_])(\s*\1){2,}\s*", line) or m or i == 0:
            held.append(line)
    close()
    return out


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str, str]] = []
        self.held: list[str] = []
        self.skip: list[str] = []
        self.path: list[tuple[int, str]] = []
        self.head = 0
        self.grid: list[list[str]] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        self.held = []
        if not text:
            return
        if self.head:
            self.path = [p for p in self.path if p[0] < self.head] + [(self.head, text)]
        elif self.grid is not None and self.grid:
            self.grid[-1].append(text)
        else:
            self.blocks.append(("text", self.path[-1][1] if self.path else "", " > ".join(t for _, t in self.path) + "\0" + text))

    def handle_starttag(self, tag, attrs):
        if tag in NOISE:
            self.flush()
            self.skip.append(tag)
        elif tag in BLOCK_TAGS and not self.skip:
            self.flush()
            self.head = int(tag[1]) if re.fullmatch("h[1-6]", tag) else 0
            if tag == "table":
                self.grid = []
            elif tag == "tr" and self.grid is not None:
                self.grid.append([])

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                while self.skip.pop() != tag:
                    pass
        elif tag in BLOCK_TAGS:
            self.flush()
            self.head = 0
            if tag == "table" and self.grid is not None:
                rows, self.grid = [r for r in self.grid if r], None
                if rows:
                    self.blocks.append(("table", self.path[-1][1] if self.path else "", " > ".join(t for _, t in self.path) + "\0" + pipe_table(rows)))

    def handle_data(self, data):
        if not self.skip:
            self.held.append(data)


def html_blocks(page: str) -> list[tuple]:
    """Blocks of a page under its headings; noise elements go, tables become pipe tables."""
    p = _Page()
    p.feed(page)
    p.close()
    p.flush()
    return [(i, kind, title, *x.split("\0", 1)) for i, (kind, title, x) in enumerate(p.blocks)]


def pipe_table(grid: list[list[str]]) -> str:
    width = max(map(len, grid))
    rows = ["| " + " | ".join([*r, *[""] * (width - len(r))]) + " |" for r in grid]
    return "\n".join([rows[0], "|" + " --- |" * width, *rows[1:]])


def html_grid(table: str) -> list[list[str]]:
    """Cells of an HTML table with row and column spans filled in."""
    grid: dict[tuple[int, int], str] = {}
    row = -1
    for m in re.finditer(r"<tr\b|<t[dh]\b([^>]*)>(.*?)(?=<t[dhr]\b|</t[dhr]|</table|\Z)", table, re.S | re.I):
        if m[0].lower().startswith("<tr"):
            row += 1
            continue
        col = next(c for c in range(10_000) if (row, c) not in grid)
        span = lambda name: min(1000, int((re.search(rf"{name}\s*=\s*[\"']?(\d+)", m[1], re.I) or [0, 1])[1]))  # noqa: B023, E731
        text = " ".join(re.sub(r"<[^>]+>", " ", m[2]).split())
        for r in range(row, row + span("rowspan")):
            for c in range(col, col + span("colspan")):
                grid[r, c] = text
    if not grid:
        return []
    return [[grid.get((r, c), "") for c in range(max(c for _, c in grid) + 1)] for r in range(max(r for r, _ in grid) + 1)]


def csv_rows(text: str) -> list[tuple]:
    """(row number, cells as JSON): blank rows go, numbers stay those of the source."""
    head = text[:4096]
    by = max(",;\t|", key=head.count)
    return [(n, json.dumps(r, ensure_ascii=False)) for n, r in enumerate(csv.reader(io.StringIO(text), delimiter=by), 1) if any(c.strip() for c in r)]


def xlsx_rows(data: bytes) -> list[tuple]:
    """(sheet, row number, cells as JSON) from a workbook's XML; merged cells repeat their value."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    out = []
    with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(ns + "t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        for k, name in enumerate(sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), 1):
            root = ElementTree.fromstring(z.read(name))
            cells: dict[tuple[int, int], str] = {}
            for c in root.iter(ns + "c"):
                m = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r", ""))
                v = c.find(ns + "v")
                text = "".join(t.text or "" for t in c.iter(ns + "t")) if c.get("t") == "inlineStr" else "" if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text or ""
                if m and text:
                    cells[int(m[2]), _column(m[1])] = text
            for merge in root.iter(ns + "mergeCell"):
                a, _, b = merge.get("ref", "").partition(":")
                (c0, r0), (c1, r1) = ((_column(x[1]), int(x[2])) for x in (re.fullmatch(r"([A-Z]+)(\d+)", y) for y in (a, b or a)))
                for r in range(r0, min(r1, r0 + 10_000) + 1):
                    for c in range(c0, min(c1, c0 + 1000) + 1):
                        cells.setdefault((r, c), cells.get((r0, c0), ""))
            width = max((c for _, c in cells), default=-1) + 1
            for r in sorted({r for r, _ in cells}):
                out.append((f"sheet{k}", r, json.dumps([cells.get((r, c), "") for c in range(width)], ensure_ascii=False)))
    return out


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def notebook_cells(text: str) -> list[tuple]:
    """Cells with their number, kind, source and saved text outputs."""
    out = []
    for i, c in enumerate(json.loads(text).get("cells", [])):
        shown = ["".join(o.get("text") or o.get("data", {}).get("text/plain") or "") for o in c.get("outputs", [])]
        out.append((i, c.get("cell_type", ""), "", "", "\n".join(["".join(c.get("source", "")), *filter(None, shown)])))
    return out


def config_fields(text: str) -> list[tuple]:
    """(path, value) of every leaf of JSON, TOML or INI text."""
    for load in (json.loads, tomllib.loads, _ini):
        try:
            data = load(text)
            break
        except (ValueError, configparser.Error):
            continue
    else:
        return []

    def walk(x, path: str) -> Iterator[tuple[str, str]]:
        if isinstance(x, dict):
            for k, v in x.items():
                yield from walk(v, f"{path}.{k}" if path else str(k))
        elif isinstance(x, list):
            for i, v in enumerate(x):
                yield from walk(v, f"{path}[{i}]")
        else:
            yield path, json.dumps(x) if isinstance(x, bool) or x is None else str(x)

    return list(walk(data, ""))


def _ini(text: str) -> dict:
    p = configparser.ConfigParser()
    p.read_string(text)
    return {s: dict(p[s]) for s in p.sections()}


def python_symbols(source: str) -> list[tuple]:
    """(name, kind, first line, last line, doc string) of functions and classes; source that does not parse gives none."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    out = []

    def walk(node, prefix: str) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                name = f"{prefix}{x.name}"
                out.append((name, "class" if isinstance(x, ast.ClassDef) else "function", x.lineno, x.end_lineno, ast.get_docstring(x) or ""))
                walk(x, name + ".")

    walk(tree, "")
    return out


def code_symbols(source: str, language: str) -> list[tuple]:
    """(name, first line, last line) by the declarations of a language; each ends before the next. Without a grammar
    this is coarser than a syntax tree: nested declarations are flat."""
    pattern = re.compile(SYMBOLS[language])
    lines = source.split("\n")
    found = [(next(g for g in m.groups() if g), i) for i, line in enumerate(lines, 1) if (m := pattern.match(line)) and any(m.groups())]
    return [(name, at, (found[k + 1][1] - 1) if k + 1 < len(found) else len(lines)) for k, (name, at) in enumerate(found)]


def markup_sections(text: str, kind: str) -> list[tuple]:
    """Sections of TeX, reStructuredText, BibTeX or schema text with their line ranges."""
    pattern = {"latex": r"\\(?:sub)*section\*?\{(.+?)\}", "bibtex": r"@\w+\{([^,]+),", "schema": r"<xs:(?:element|complexType|simpleType)\b[^>]*name=\"([^\"]+)\"", "rst": r"^(\S.*)\n([=\-~^\"'`#*+.])\2{2,}\s*$"}[kind]
    found = [(m[1].strip(), text.count("\n", 0, m.start()) + 1) for m in re.finditer(pattern, text, re.M)]
    last = text.count("\n") + 1
    return [(name, at, found[i + 1][1] - 1 if i + 1 < len(found) else last) for i, (name, at) in enumerate(found)]


def heading_level(line: Column) -> Column:
    """Level of numbered and chapter headings; null for other lines."""
    number = F.regexp_extract(line, r"^\s*(\d+(?:\.\d+)*)\.?\s+\p{Lu}", 1)
    return F.when(line.rlike(r"^\s*(Chapter|Part|Appendix)\s+[0-9IVXA-Z]+\b") | line.rlike("^\\s*第[一二三四五六七八九十百0-9]+[章篇]"), 1).when((number != "") & (F.length(line) <= 80), F.size(F.split(number, r"\.")))


def line_ranges(rows: DataFrame, by: str, line: str) -> DataFrame:
    """Runs of consecutive line numbers of each key as (first, last)."""
    from pyspark.sql import Window

    run = F.col(line) - F.row_number().over(Window.partitionBy(by).orderBy(line))
    return rows.select(by, line).distinct().withColumn("_run", run).groupBy(by, "_run").agg(F.min(line).alias("first"), F.max(line).alias("last")).drop("_run")


def header_cell(cell: Column) -> Column:
    """A label, not data: no number, date or long text."""
    return (F.length(cell) <= 40) & ~cell.rlike(r"^[\s\d.,:%/+-]+$")


def extends_header(above: Column, row: Column) -> Column:
    """A second header tier: some cell repeats the one above, another is new, and none looks like data."""
    filled = F.filter(row, lambda c: F.trim(c) != "")
    pairs = F.zip_with(above, row, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    same = F.exists(pairs, lambda p: (F.trim(p["b"]) != "") & (F.trim(p["a"]) == F.trim(p["b"])))
    fresh = F.exists(pairs, lambda p: (F.trim(p["b"]) != "") & (F.coalesce(F.trim(p["a"]), F.lit("")) != F.trim(p["b"])))
    return same & fresh & F.forall(filled, header_cell)


def merged_header(above: Column, row: Column) -> Column:
    return F.zip_with(above, row, lambda a, b: F.when(F.coalesce(F.trim(b), F.lit("")) == "", a).when(F.trim(a) == F.trim(b), a).otherwise(F.concat_ws(" ", F.nullif(a, F.lit("")), b)))


def glued_cell(cell: Column) -> Column:
    """Several values in one cell: a number glued to another by white space, or several assignments."""
    return cell.rlike(r"^\s*\d+(\.\d+)?\s+\d+(\.\d+)?\s*$") | (F.size(F.regexp_extract_all(cell, F.lit(r"(\w+\s*=)"), 1)) >= 2)


def jsonl_records(files: DataFrame) -> DataFrame:
    """(doc_id, line, title, valid) of each non-blank line of ``files(doc_id, text)``; a title names the record by its
    id, _id, name or title, whichever comes first. Lines that are no JSON are marked, not dropped."""
    lines = files.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("_i", "line_text")).where(F.trim("line_text") != "")
    name = F.coalesce(*(F.get_json_object("line_text", f"$.{k}") for k in ("id", "_id", "name", "title")))
    number = (F.col("_i") + 1).cast("long")
    title = F.concat(F.lit("Record "), number.cast("string"), F.coalesce(F.concat(F.lit(": "), F.substring(name, 1, 160)), F.lit("")))
    return lines.select("doc_id", number.alias("line"), title.alias("title"), F.try_parse_json("line_text").isNotNull().alias("valid"))


def _whole_objects(text: str | None) -> list[str]:
    found, read = [], json.JSONDecoder().raw_decode
    start = re.search(r"\[\s*(?=\{)", text or "")
    at = start.end() if start else (text or "").find("{")
    while start is not None or not found:
        if not text or at < 0 or at >= len(text) or text[at] != "{":
            break
        try:
            value, at = read(text, at)
        except ValueError:
            break
        found.append(json.dumps(value, ensure_ascii=False))
        at = re.compile(r"[\s,]*").match(text, at).end()
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def lenient_objects(replies: pd.Series) -> pd.Series:
    """The whole objects of the first list (or the first object) in a reply, as JSON; what is cut off or malformed ends it."""
    return pd.Series([_whole_objects(t) for t in replies], index=replies.index, dtype=object)


def packed_rows(rows: DataFrame, header: str, budget: int) -> DataFrame:
    """(sheet, first, last, tokens, text): rows (sheet, row_no, row) in order to blocks of at most ``budget`` tokens, each
    with its sheet's name, its rows and the header; a row that is longer is a block of its own. Rows stream through
    sorted partitions, so a sheet of any length is never held."""
    from quillmark.operators.chunking import approx_tokens

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sheet, lines, first, last, base, used, out = None, [], 0, 0, 0, 0, []

        def close() -> None:
            if lines:
                out.append((sheet, first, last, used, f"SHEET: {sheet}\nROWS: {first}-{last}\nHEADER: {header}\n" + "\n".join(lines)))

        for f in frames:
            for s, n, row in zip(f["sheet"], f["row_no"], f["row"], strict=True):
                cost = approx_tokens(row)
                if s != sheet or used + cost > budget:
                    close()
                    if s != sheet:
                        sheet, base = s, approx_tokens(f"SHEET: {s}\nHEADER: {header}")
                    lines, first, used = [], n, base
                lines.append(row)
                last, used = n, used + cost
            if out:
                yield pd.DataFrame(out, columns=["sheet", "first", "last", "tokens", "text"])
                out = []
        close()
        if out:
            yield pd.DataFrame(out, columns=["sheet", "first", "last", "tokens", "text"])

    dealt = rows.select("sheet", F.col("row_no").cast("long").alias("row_no"), "row").repartition("sheet").sortWithinPartitions("sheet", "row_no")
    return dealt.mapInPandas(run, "sheet string, first long, last long, tokens long, text string")
