"""Scalars of table cells, facts, relations and locators as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions.text import column

# Markers of normal and abnormal results, predicates of composition, names that are values or references.
NORMAL = r"(?i)^(?:正常|未见异常|未见明显异常|符合范围|normal|within\s+(?:normal\s+)?range|in\s+range)$"
ABNORMAL = r"(?i)^(?:[↑↓]|[HL]|异常|超标|超出范围|偏高|偏低|增高|降低|abnormal|high|low|out\s+of\s+range|above\s+(?:the\s+)?limit|below\s+(?:the\s+)?limit)$"
WHOLE_TO_PART = (
    "has_part", "has_parts", "has_component", "has_components", "has_module", "has_modules", "has_subsystem", "has_subsystems",
    "composed_of", "consists_of", "comprises", "contains", "includes", "made_of", "made_up_of",
)
PART_TO_WHOLE = ("part_of", "component_of", "module_of", "subsystem_of")
VALUE_WORD = r"^[+\-±~≥≤<>]?\d[\d.,]*(?:[A-Za-zµμ°℃Ω%]{1,3})?$"
FILLER_WORD = r"^(?:[A-Za-zµμ°℃Ω%]{1,3}|[一-鿿]{1,2}|and|或者|[×/~～\-–—+±])$"
NAME_WORD = r"([A-Za-z0-9µμ°℃Ω%][A-Za-z0-9µμ°℃Ω%.,\-]*|[一-鿿]+|[×/~～\-–—+±])"
REFERENCE = (
    r"(?i)^(?:(?:fig(?:ure)?|table|tab|图|表|附录|appendix|chapter|section|sec|章|节|page|p|note|注|footnote|equation|eq|公式)\.?\s*[\dA-Za-z][\dA-Za-z.\-]*"
    r"|\d{2,4}-\d{3,6}(?:\s*\*?[A-Za-z]{1,2})?|rev(?:ision)?\.?\s*\*?[A-Za-z0-9]{1,3}|\*[A-Za-z]{1,2})$"
)


def percent_text(value: Column, decimals: Column, most: int = 6) -> Column:
    """value x 100 to 15 significant digits, rounded half up to the decimals, with a percent sign."""
    exact = F.format_string("%.14e", value * 100).try_cast("decimal(38,16)")
    out = F.lit(None).cast("string")
    for d in range(most + 1):
        out = F.when(decimals == d, F.round(exact, d).cast(f"decimal(30,{d})").cast("string")).otherwise(out)
    return F.concat(out, F.lit("%"))


def number_text(value: Column) -> Column:
    """A number as a sheet shows it: whole ones without a point, others to 15 significant digits."""
    exact = F.format_string("%.14e", value).try_cast("decimal(38,16)").cast("string")
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(F.regexp_replace(exact, r"0+$", ""))


def percent_decimals(number_format: Column) -> Column:
    """Decimals of a percent format's first section; null for other formats."""
    section = F.get(F.split(F.regexp_replace(number_format, r'"[^"]*"|\\.|_.', ""), ";"), F.lit(0))
    return F.when(F.contains(section, F.lit("%")), F.length(F.regexp_extract(section, r"\.([0#?]+)", 1)))


def time_text(value: Column) -> Column:
    day = F.date_format(value, "yyyy-MM-dd")
    return F.when(value == F.date_trunc("day", value), day).otherwise(F.date_format(value, "yyyy-MM-dd HH:mm:ss"))


def cell_text(text: Column, number: Column, time: Column, truth: Column, number_format: Column) -> Column:
    """The indexed form of a cell, of which one of the four values is set; empty without any."""
    decimals = percent_decimals(F.coalesce(number_format, F.lit("")))
    picture = F.when(text.rlike(r"^\s*=_?DISPIMG\("), "(image)").otherwise(F.trim(text))
    return F.coalesce(F.upper(truth.cast("string")), time_text(time), F.when(decimals.isNotNull(), percent_text(number, decimals)).otherwise(number_text(number)), picture, F.lit(""))


def expanded_rows(row: Column, plan: Column) -> Column:
    """Rows of a row with glued cells: ``plan`` maps a place (from 0) to the lines stacked there. All lists must have
    the same length, two at least, or the row stays as it is; other cells are repeated."""
    sizes = F.transform(F.map_values(plan), F.size)
    n = F.array_max(sizes)
    able = F.coalesce((n >= 2) & (F.array_min(sizes) == n), F.lit(False))
    lines = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: F.transform(row, lambda cell, j: F.coalesce(F.get(F.try_element_at(plan, j.cast("int")), k), cell)))
    return F.when(able, lines).otherwise(F.array(row))


def fact_id(unit: Column, content: list[Column]) -> Column:
    """f and the first twenty hexadecimal digits of the hash of a fact's unit and content; nulls are empty."""
    return F.concat(F.lit("f"), F.substring(F.sha2(F.concat_ws("|", unit.cast("string"), *(F.coalesce(c.cast("string"), F.lit("")) for c in content)), 256), 1, 20))


def _given(c: Column) -> Column:
    return F.nullif(F.coalesce(c.cast("string"), F.lit("")), F.lit(""))


def values_text(value: Column, low: Column, typical: Column, high: Column, unit: Column) -> Column:
    """A single value or min / typ / max, with the unit."""
    bounds = F.concat_ws(" / ", *(F.concat(F.lit(f"{name} "), _given(c)) for name, c in (("min", low), ("typ", typical), ("max", high))))
    return F.trim(F.concat_ws(" ", F.coalesce(_given(value), bounds), _given(unit)))


def conditions_text(conditions: Column) -> Column:
    """key: value pairs of a map in the order of the keys."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(conditions)), lambda e: F.concat_ws(": ", e["key"], e["value"])), "; ")


def when_text(start: Column, end: Column, observed: Column) -> Column:
    """The period of a fact, or when it was observed."""
    a, b = _given(start), _given(end)
    return F.coalesce(F.when(a != b, F.concat_ws("~", a, b)), a, b, _given(observed), F.lit(""))


def fact_text(subject: Column, prop: Column, symbol: Column, values: Column, conditions: Column, when: Column, most: int = 1000) -> Column:
    """One line for embedding: subject · property (symbol): values | conditions | when."""
    mark = F.when(F.lower(_given(symbol)) != F.lower(prop), F.concat(F.lit(" ("), symbol, F.lit(")")))
    head = F.concat(subject, F.lit(" · "), prop, F.coalesce(mark, F.lit("")), F.lit(": "), values)
    return F.substring(F.concat_ws(" | ", head, _given(conditions), F.concat(F.lit("when: "), _given(when))), 1, most)


def fact_quality(conflict: Column, state: Column, origin: Column) -> Column:
    bad = F.coalesce(conflict, F.lit(False)) | F.coalesce(state.isin("ambiguous_source", "needs_review"), F.lit(False)) | F.coalesce(origin == "unresolved", F.lit(False))
    return F.when(bad, "needs_review").otherwise("extracted")


def flag_status(quality: Column, flag: Column, number: Column, low: Column, high: Column) -> Column:
    """normal, abnormal, unknown or uncertain: by an explicit marker and by the stated bounds, uncertain where the two
    disagree or the fact needs a review. Bounds the wrong way round say nothing."""
    raw = F.trim(F.coalesce(flag, F.lit("")))
    marked = F.when(raw.rlike(NORMAL), "normal").when(raw.rlike(ABNORMAL), "abnormal")
    usable = number.isNotNull() & (low.isNotNull() | high.isNotNull()) & ~F.coalesce(low > high, F.lit(False))
    bounded = F.when(usable, F.when(F.coalesce(number < low, F.lit(False)) | F.coalesce(number > high, F.lit(False)), "abnormal").otherwise("normal"))
    return F.when((quality == "needs_review") | F.coalesce(marked != bounded, F.lit(False)), "uncertain").otherwise(F.coalesce(marked, bounded, F.lit("unknown")))


def split_flag(prop: Column) -> Column:
    """struct(property, flag): the flag words at the end of a property's name."""
    flag = F.regexp_extract(prop, r"(?i)\s+(high|low|abnormal|normal|elevated|decreased|偏高|偏低|异常|正常)\s*$", 1)
    return F.struct(F.trim(F.regexp_replace(prop, r"(?i)\s+(?:high|low|abnormal|normal|elevated|decreased|偏高|偏低|异常|正常)\s*$", "")).alias("property"), flag.alias("flag"))


def relation_quality(derived: Column, violation: Column, state: Column, polarity: Column, modality: Column) -> Column:
    bad = F.coalesce(derived, F.lit(False)) | F.coalesce(violation, F.lit(False)) | F.coalesce(state == "needs_review", F.lit(False))
    return F.when(bad | (F.coalesce(polarity, F.lit("affirmed")) == "uncertain") | (F.coalesce(modality, F.lit("actual")) == "uncertain"), "needs_review").otherwise("extracted")


def traversable(quality: Column, polarity: Column, modality: Column, conditions: Column) -> Column:
    """A relation may be walked if it is affirmed, actual, without conditions and not to be reviewed."""
    return (quality != "needs_review") & (F.coalesce(polarity, F.lit("affirmed")) == "affirmed") & (F.coalesce(modality, F.lit("actual")) == "actual") & (F.coalesce(conditions, F.lit("")) == "")


def composition(predicate: Column, source: Column, target: Column) -> Column:
    """struct(whole, part) of a predicate of composition in either direction; null for others."""
    name = F.regexp_replace(F.lower(F.trim(predicate)), r"[\s-]+", "_")
    return F.when(name.isin(*WHOLE_TO_PART), F.struct(source.alias("whole"), target.alias("part"))).when(name.isin(*PART_TO_WHOLE), F.struct(target.alias("whole"), source.alias("part")))


def value_name(title: str | Column) -> Column:
    """The name is only a value: numbers with units, ranges and fillers."""
    words = F.regexp_extract_all(column(title), F.lit(NAME_WORD), 1)
    return F.exists(words, lambda w: w.rlike(VALUE_WORD)) & F.forall(words, lambda w: w.rlike(VALUE_WORD) | w.rlike(FILLER_WORD))


def reference_name(title: str | Column) -> Column:
    """The name is a figure, chapter, page, document number or revision mark."""
    return F.trim(column(title)).rlike(REFERENCE)


def span_text(one: str, many: str, first: Column, last: Column) -> Column:
    return F.when(first.isNotNull(), F.when(last > first, F.concat(F.lit(f"{many} "), first.cast("string"), F.lit("–"), last.cast("string"))).otherwise(F.concat(F.lit(f"{one} "), first.cast("string"))))


def place(page: Column, page_end: Column, line: Column, line_end: Column, row: Column, row_end: Column, sections: Column, most: int = 60) -> Column:
    """Short locator: pages, lines or rows, else the deepest heading, cut where it is long; empty without any."""
    rows = F.when(row.isNotNull(), F.concat(F.lit("rows "), row.cast("string"), F.lit("–"), F.coalesce(row_end, row).cast("string")))
    heads = F.filter(sections, lambda s: F.trim(s) != "")
    last = F.trim(F.get(heads, F.size(heads) - 1))
    return F.coalesce(span_text("page", "pages", page, page_end), span_text("line", "lines", line, line_end), rows, F.when(F.length(last) > most, F.concat(F.substring(last, 1, most - 1), F.lit("…"))).otherwise(last), F.lit(""))


def position(part: Column, sections: Column) -> Column:
    """Locator with its headings: part · heading / heading."""
    return F.concat_ws(" · ", F.nullif(part, F.lit("")), F.nullif(F.array_join(F.filter(sections, lambda s: F.trim(s) != ""), " / "), F.lit("")))


def embedding_prefix(document: Column, sections: Column, most: int = 200) -> Column:
    """document > section path, cut; only for vectors, never part of a chunk's text."""
    return F.substring(F.array_join(F.filter(F.concat(F.array(document), sections), lambda s: F.trim(F.coalesce(s, F.lit(""))) != ""), " > "), 1, most)


def common_prefix(a: Column, b: Column) -> Column:
    """Longest common head of two arrays."""
    same = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: z["a"].eqNullSafe(z["b"]))
    cut = F.array_position(same, F.lit(False))
    return F.slice(a, F.lit(1), F.when(cut == 0, F.least(F.size(a), F.size(b))).otherwise(cut - 1).cast("int"))


def mention_weight(score: Column, count: Column, df: Column, n_chunks: Column) -> Column:
    """An entity's part in a chunk's score: rare entities and repeated mentions count for more."""
    return score * F.log1p(F.greatest(n_chunks, F.lit(1)) / F.greatest(df, F.lit(1))) * (1 + F.log1p(F.greatest(count, F.lit(0))))


def evidence_weight(score: Column, df: Column, n_chunks: Column, conclusion: Column) -> Column:
    return score * F.log1p(F.greatest(n_chunks, F.lit(1)) / F.greatest(df, F.lit(1))) * F.when(conclusion, 1.25).otherwise(1.0)


def second_stage(cosine: Column, lexical: Column, rank: Column) -> Column:
    """Cosine, a part of the lexical overlap and a small prior for the graph's order."""
    return F.coalesce(cosine, F.lit(0.0)) + 0.3 * F.coalesce(lexical, F.lit(0.0)) + 0.5 / (10.0 + F.greatest(F.lit(1), F.coalesce(rank, F.lit(1))))


def symbols(text: str | Column) -> Column:
    """Distinct runs of letters, digits and joined marks, two characters at least."""
    found = F.regexp_extract_all(F.lower(column(text)), F.lit(r"([a-z0-9_#]+(?:[\[\]:./+-][a-z0-9_#]+)*)"), 1)
    return F.array_distinct(F.filter(found, lambda t: F.length(t) >= 2))


def lexical_overlap(question: str | Column, text: str | Column) -> Column:
    """Twice the share of the question's symbols in the text."""
    q = symbols(question)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(q, symbols(text))) / F.size(q))
