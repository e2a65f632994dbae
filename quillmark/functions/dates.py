"""Dates in texts, file names and questions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions.text import column

# Month names, the forms of dates and the number words of time windows.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH = "(?:january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sept|sep|oct|nov|dec)"
YEAR = r"(?:19|20)\d{2}"
ISO = rf"(?<!\d){YEAR}[-/.]\d{{1,2}}(?:[-/.]\d{{1,2}})?(?!\d|[-/.]\d)"
COMPACT = rf"(?<!\d){YEAR}\d{{4}}(?!\d)"
CJK = rf"{YEAR}\s*年\s*(?:\d{{1,2}}\s*月\s*(?:\d{{1,2}}\s*[日号])?)?"
MONTH_FIRST = rf"\b{MONTH}\.?\s+(?:\d{{1,2}}(?:st|nd|rd|th)?,?\s+)?{YEAR}\b|\b{MONTH},\s+{YEAR}\b"
DAY_FIRST = rf"\b\d{{1,2}}(?:st|nd|rd|th)?\s+{MONTH}\.?,?\s+{YEAR}\b"
BARE_YEAR = rf"(?<![\d.]){YEAR}(?![\d.])"
NUMBERS = {"two": 2, "three": 3, "four": 4, "five": 5, "一": 1, "两": 2, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}


def normal_date(found: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD of one date in any of the forms; null for an impossible month or day."""
    low = F.lower(found)
    year = F.regexp_extract(low, f"({YEAR})(?!.*{YEAR})", 1)
    name = F.regexp_extract(low, "([a-z]{3})[a-z]*", 1)
    english = F.regexp_extract(low, rf"({MONTH})", 1) != ""
    year = F.when(english, year).otherwise(F.substring(low, 1, 4))
    digits = F.regexp_extract_all(F.when(english, F.regexp_replace(low, rf"\b{YEAR}\b", " ")).otherwise(F.substring(low, 5, 100)), F.lit(r"(\d{1,2})"), 1)
    named = F.array_position(F.array(*map(F.lit, MONTHS)), F.when(english, F.substring(F.regexp_extract(low, rf"({MONTH})", 1), 1, 3)).otherwise(name))
    month = F.when(english, named).otherwise(F.get(digits, F.lit(0)).cast("int"))
    day = F.when(english, F.get(digits, F.lit(0)).cast("int")).otherwise(F.get(digits, F.lit(1)).cast("int"))
    months = F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"))
    whole = F.concat_ws("-", months, F.lpad(day.cast("string"), 2, "0"))
    return F.when(month.isNull(), year).when((month < 1) | (month > 12), None).when(day.isNull(), months).otherwise(F.try_to_date(whole, "yyyy-MM-dd").cast("string"))


def found_dates(text: str | Column) -> Column:
    """All distinct dates of a text in its order; the longest form at a place counts, bare years too."""
    found = F.regexp_extract_all(column(text), F.lit(f"(?i)({ISO}|{COMPACT}|{CJK}|{MONTH_FIRST}|{DAY_FIRST}|{BARE_YEAR})"), 1)
    return F.array_distinct(F.filter(F.transform(found, normal_date), lambda x: x.isNotNull()))


def name_date(name: str | Column, this_year: int) -> Column:
    """The date of a file name without its extension: year-first forms, then English ones, then a year alone. Four
    digits inside a part number, and years after the next, don't count."""
    stem = F.regexp_replace(column(name), r"\.[A-Za-z0-9]{1,6}$", "")
    strict = (rf"(?<![A-Za-z]){ISO}(?![A-Za-z])", rf"(?<![A-Za-z\d]){YEAR}\d{{4}}(?![A-Za-z\d])", CJK, MONTH_FIRST, DAY_FIRST, rf"(?<![A-Za-z\d.]){YEAR}(?![A-Za-z\d])")
    early = lambda x: x.isNotNull() & (F.substring(x, 1, 4).cast("int") <= this_year + 1)
    first = lambda form: F.get(F.filter(F.transform(F.regexp_extract_all(stem, F.lit(f"(?i)({form})"), 1), normal_date), early), F.lit(0))
    return F.coalesce(*map(first, strict))


def question_window(question: str | Column, this_year: int) -> Column:
    """struct(from, to) of years: a range, the last years, since a year, this or last year, or the dates in a question;
    null without any."""
    q = F.lower(column(question))
    part = lambda pattern, k: F.nullif(F.regexp_extract(q, pattern, k), F.lit(""))
    span = rf"({YEAR})\s*年?\s*(?:到|至|—|-|~|～|–|to|through)\s*({YEAR})"
    recent = r"(?:这|近|最近|过去|前)\s*([一二两三四五六七八九十]|\d+)\s*年|(?:last|past|recent)\s+(\d+|two|three|four|five)\s+years?"
    since = rf"(?:自|从)\s*({YEAR})|\bsince\s+({YEAR})\b"
    word = F.coalesce(part(recent, 1), part(recent, 2))
    n = F.coalesce(F.create_map(*[F.lit(x) for pair in NUMBERS.items() for x in pair])[word], word.try_cast("int"))
    begun = F.coalesce(part(since, 1), part(since, 2))
    years = F.transform(found_dates(column(question)), lambda d: F.substring(d, 1, 4))
    window = lambda a, b: F.struct(a.cast("string").alias("from"), b.cast("string").alias("to"))
    now = F.lit(this_year)
    return (
        F.when(part(span, 1).isNotNull(), window(F.least(part(span, 1), part(span, 2)), F.greatest(part(span, 1), part(span, 2))))
        .when(n > 0, window(now - n + 1, now))
        .when(begun.isNotNull(), window(begun, now))
        .when(q.rlike(r"今年|this\s+year"), window(now, now))
        .when(q.rlike(r"去年|last\s+year"), window(now - 1, now - 1))
        .when(F.contains(q, F.lit("前年")), window(now - 2, now - 2))
        .when(F.size(years) > 0, window(F.array_min(years), F.array_max(years)))
    )


def in_window(value: Column, window: Column) -> Column:
    """Whether an axis value lies in a window; without a window, or for what is no date, it does."""
    dated = value.rlike(rf"^{YEAR}(?:[-/.]|$)")
    return F.coalesce(window.isNull() | ~dated | F.substring(value, 1, 4).between(window["from"], window["to"]), F.lit(True))


def evidence_date(evidence: str | Column, source: str | Column) -> Column:
    """The first date in quoted evidence that its source holds word for word; null otherwise."""
    return F.when(F.contains(column(source), column(evidence)), F.get(found_dates(evidence), F.lit(0)))
