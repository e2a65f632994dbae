"""Text scalars as column expressions: tokens, counts, sentences, languages, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code point ranges, separators and patterns of the text rules.
CJK = r"一-鿿"
SENTENCE_ENDS = r"(?<=[。！？；])\s*|(?<=[.!?])\s+|\n{2,}"
SUPPORTED = ("csv", "html", "htm", "ipynb", "json", "jsonl", "md", "pdf", "py", "rst", "tex", "tsv", "txt", "xlsx", "yaml", "yml")
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "what", "when", "which", "who", "with")


def column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text: str | Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, in order."""
    return F.regexp_extract_all(F.lower(column(text)), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def content_tokens(text: str | Column) -> Column:
    """Distinct tokens without stop words."""
    return F.array_except(F.array_distinct(tokens(text)), F.array(*map(F.lit, STOP_WORDS)))


def cjk_count(text: str | Column) -> Column:
    return F.length(F.regexp_replace(column(text), f"[^{CJK}]", "")).cast("long")


def approx_tokens(text: str | Column) -> Column:
    """CJK characters plus a quarter of the others, one at least."""
    x = column(text)
    return (cjk_count(x) + F.greatest(F.lit(1), F.floor((F.length(x) - cjk_count(x)) / 4))).cast("long")


def sentences(text: str | Column) -> Column:
    """Trimmed sentences: after CJK enders, after . ! ? with white space, and at blank lines."""
    x = F.regexp_replace(column(text), "\r\n?", "\n")
    parts = F.transform(F.split(x, SENTENCE_ENDS), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def language(text: str | Column) -> Column:
    """zh, en, mixed or und by the CJK and Latin letters in the first 4000 characters."""
    head = F.substring(column(text), 1, 4000)
    cjk, latin = F.length(F.regexp_replace(head, f"[^{CJK}]", "")), F.length(F.regexp_replace(head, "[^A-Za-z]", ""))
    return (
        F.when((cjk == 0) & (latin == 0), "und")
        .when((cjk > 0) & (latin > 0) & (F.least(cjk, latin) / F.greatest(cjk, latin) >= 0.25), "mixed")
        .when(cjk >= latin, "zh")
        .otherwise("en")
    )


def clean(text: str | Column) -> Column:
    """Control characters go, line ends become one kind, runs of blanks one blank, at most one empty line."""
    x = F.regexp_replace(column(text), "\r\n?", "\n")
    x = F.regexp_replace(x, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, "[ \t]+", " "), "\n{3,}", "\n\n"))


def stable_key(value: str | Column) -> Column:
    """The first 15 hexadecimal digits of the SHA-256 as an integer."""
    return F.conv(F.substring(F.sha2(column(value), 256), 1, 15), 16, 10).cast("long")


def normal_path(path: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(column(path), r"\\", "/"), "/+", "/"), "^/|/$", "")


def ancestors(path: str | Column) -> Column:
    """All folders above a path, the topmost first."""
    parts = F.filter(F.split(normal_path(path), "/"), lambda p: p != "")
    return F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: i < F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def suffix(path: str | Column) -> Column:
    return F.lower(F.regexp_extract(column(path), r"[^/.][^/]*\.([^./]+)$", 1))


def document_type(path: str | Column, mime: str | Column) -> Column:
    kinds = (("pdf", "pdf"), ("word", "docx"), ("presentation", "pptx"), ("spreadsheet", "xlsx"), ("markdown", "md"), ("text", "txt"))
    out = F.when(suffix(path) != "", suffix(path))
    for word, kind in kinds:
        out = out.when(F.contains(column(mime), F.lit(word)), kind)
    return out.otherwise("unknown")


def supported(path: str | Column) -> Column:
    return suffix(path).isin(*SUPPORTED)


def skipped(path: str | Column) -> Column:
    """Hidden files and folders, office lock files and system folders, relative to the root."""
    return F.coalesce(column(path).rlike(r"(^|/)(\.|~\$)|(^|/)(__MACOSX|node_modules|Thumbs\.db)(/|$)"), F.lit(False))


def coverage(question: str | Column, text: str | Column) -> Column:
    """Share of the question's content tokens that the text holds, to four digits."""
    q = content_tokens(question)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.round(F.size(F.array_intersect(q, content_tokens(text))) / F.size(q), 4))


def grams(text: str | Column, sizes: tuple[int, ...] = (3, 4)) -> Column:
    """Substrings of the given lengths of each white-space group."""
    groups = F.filter(F.split(F.lower(column(text)), r"\s+"), lambda g: g != "")
    cut = lambda g, n: F.when(F.length(g) >= n, F.transform(F.sequence(F.lit(1), F.length(g) - n + 1), lambda i: F.substring(g, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(groups, lambda g: F.concat(*(cut(g, n) for n in sizes))))

