"""Chunking: segments, sentences and rows packed to token budgets, one document at a time."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Sentence ends and headings, as in the column expressions.
ENDS = re.compile(r"(?<=[。！？；])\s*|(?<=[.!?])\s+|\n{2,}")
HEADING = re.compile(r"\s*(?:(?:Chapter|Part|Appendix)\s+[0-9IVXA-Z]+\b|\d+(?:\.\d+)*\.?\s+[A-Z]|第[一二三四五六七八九十百0-9]+[章篇])")
CHUNKS = "doc_id long, chunk_index long, kind string, text string, tokens long, chunk_uid string"


WIDE = re.compile("[一-鿿]+")


def approx_tokens(text: str) -> int:
    """A token for each CJK character, and for each four others, but one at least for the others."""
    narrow = len(text) if text.isascii() else len(WIDE.sub("", text))
    return len(text) - narrow + (narrow // 4 or 1)


def segments(text: str) -> list[tuple[str, str]]:
    """(kind, text) runs: fenced code and pipe tables stay whole, the rest is prose."""
    out: list[tuple[str, list[str]]] = []
    fence = ""
    for line in text.split("\n"):
        m = re.match(r"\s*(```+|~~~+)", line)
        if fence:
            kind = "code"
            if m and line.strip().startswith(fence):
                fence = ""
                out[-1][1].append(line)
                out.append(("", []))
                continue
        elif m:
            fence, kind = m[1], "code"
            out.append(("code", []))
        else:
            kind = "table" if line.count("|") >= 2 else "prose"
        if not out or out[-1][0] != kind:
            out.append((kind, []))
        out[-1][1].append(line)
    return [(k, "\n".join(x)) for k, x in out if any(s.strip() for s in x)]


def sentences(text: str) -> list[str]:
    return [s.strip() for s in ENDS.split(text) if s.strip()]


def cut_long(sentence: str, most: int) -> list[str]:
    """Longest prefixes within the budget, one after another; their concatenation is the sentence."""
    out = []
    while sentence:
        # Four characters cost a token at least, so no prefix within the budget is longer than this.
        reach = sentence[: 4 * most + 4]
        wide = np.cumsum(np.fromiter(("一" <= c <= "鿿" for c in reach), np.int64, len(reach)))
        cost = wide + np.maximum(1, (np.arange(1, len(reach) + 1) - wide) // 4)
        cut = max(1, int(np.searchsorted(cost, most, "right")))
        out.append(sentence[:cut])
        sentence = sentence[cut:]
    return out


def split_code(text: str, most: int) -> list[str]:
    """Parts within the budget that prefer line ends; their concatenation is the text."""
    out, held = [], ""
    for line in text.splitlines(keepends=True):
        if held and approx_tokens(held + line) > most:
            out.append(held)
            held = ""
        if approx_tokens(line) > most:
            *parts, held = cut_long(line, most)
            out += parts
        else:
            held += line
    return [*out, held] if held else out


def split_table(text: str, most: int) -> list[str]:
    """Rows within the budget below a repeated header; rows over it become labelled cells."""
    lines = text.split("\n")
    ruled = len(lines) > 1 and re.fullmatch(r"[\s|:-]+", lines[1])
    head, rows = (lines[:2], lines[2:]) if ruled else (lines[:1], lines[1:])
    names = [c.strip() for c in head[0].strip().strip("|").split("|")]
    base = approx_tokens("\n".join(head))
    out, held, used = [], [], base
    for row in rows:
        cost = approx_tokens(row) + 1
        if base + cost > most:
            if held:
                out.append("\n".join(head + held))
                held, used = [], base
            cells = [c.strip() for c in row.strip().strip("|").split("|")]
            out += [p for n, c in zip(names + [""] * len(cells), cells, strict=False) if c for p in cut_long(f"{n}: {c}" if n else c, most)]
            continue
        if held and used + cost > most:
            out.append("\n".join(head + held))
            held, used = [], base
        held.append(row)
        used += cost
    if held or not out:
        out.append("\n".join(head + held))
    return out


def split_facts(text: str, most: int) -> list[str]:
    """Parts within the budget that never cut a line of facts; title and caption lines head each part, unless they take
    more than a third of it. A single fact over the budget stays whole; prose, code and tables are cut as elsewhere."""
    if approx_tokens(text) <= most:
        return [text]
    lines = text.split("\n")
    heads = [x for x in lines if x.startswith(("TITLE:", "CAPTION:"))]
    if approx_tokens("\n".join(heads)) > most // 3:
        heads = []
    room = max(1, most - approx_tokens("\n".join(heads) + "\n")) if heads else most
    pieces: list[str] = []
    for kind, part in segments("\n".join(x for x in lines if x not in heads)):
        if kind != "prose":
            pieces += [p for _, p in chunk_text(part, room, 0)]
            continue
        for line in filter(str.strip, part.split("\n")):
            pieces += [line] if line.startswith("FACTS: ") else [p for _, p in chunk_text(line, room, 0)]
    out: list[list[str]] = []
    for p in pieces:
        if out and approx_tokens("\n".join([*heads, *out[-1], p])) <= most:
            out[-1].append(p)
        else:
            out.append([p])
    return ["\n".join([*heads, *part]) for part in out]


def pack(parts: list[str], most: int, overlap: int) -> list[str]:
    """Greedy packing of sentences with whole sentences of overlap. A heading past half of the budget starts a chunk
    without overlap, and a heading at the end of a chunk moves to the next."""
    out: list[str] = []
    held: list[str] = []
    cost = lambda s: approx_tokens(s) + 1

    def close(keep: bool) -> list[str]:
        nonlocal held
        cut = len(held)
        while cut and HEADING.match(held[cut - 1]):
            cut -= 1
        carry = held[cut:] if cut else []
        body = held[:cut] if cut else held
        if body:
            out.append("\n".join(body))
        tail: list[str] = []
        if keep and overlap:
            for s in reversed(body):
                if tail and sum(map(cost, tail)) + cost(s) > overlap:
                    break
                tail.insert(0, s)
        held = tail + carry
        return carry

    fresh = 0  # sentences of held that no chunk has yet
    for s in parts:
        if cost(s) > most:
            if fresh:
                out += ["\n".join(c)] if (c := close(False)) else []
            held, fresh = [], 0
            out += cut_long(s, most)
            continue
        if held and HEADING.match(s) and sum(map(cost, held)) >= most // 2:
            close(False)
            fresh = len(held)
        if held and sum(map(cost, held)) + cost(s) > most:
            carry = close(True)
            if sum(map(cost, held)) + cost(s) > most:
                held = list(carry)
            fresh = len(carry)
        held.append(s)
        fresh += 1
    if fresh:
        out += ["\n".join(c)] if (c := close(False)) else []
    return out


def chunk_text(text: str, most: int, overlap: int) -> list[tuple[str, str]]:
    out = []
    for kind, part in segments(text):
        pieces = split_code(part, most) if kind == "code" else split_table(part, most) if kind == "table" and approx_tokens(part) > most else [part] if kind == "table" else pack(sentences(part), most, overlap)
        out += [(kind, p) for p in pieces]
    return out


def glue(pieces: list[tuple[str, str]], most: int, slack: float = 1.25) -> list[tuple[str, str]]:
    """Tiny prose pieces join the piece before if both fit the budget with a little slack."""
    out: list[tuple[str, str]] = []
    tiny = max(16, most // 8)
    for kind, text in pieces:
        if out and kind == out[-1][0] == "prose" and min(approx_tokens(text), approx_tokens(out[-1][1])) < tiny and approx_tokens(out[-1][1]) + approx_tokens(text) <= most * slack:
            out[-1] = (kind, out[-1][1] + "\n" + text)
        else:
            out.append((kind, text))
    return out


def drop_repeat(previous: str, text: str, least: int = 12) -> str:
    """The text without the longest start that repeats the end of the previous one."""
    at = previous.find(text[:least], max(0, len(previous) - len(text))) if len(text) >= least else -1
    while at >= 0:
        if text.startswith(previous[at:]):
            return text[len(previous) - at :].lstrip()
        at = previous.find(text[:least], at + 1)
    return text


def chunk_documents(docs: DataFrame, most: int = 400, overlap: int = 40) -> DataFrame:
    """Chunks of each document in order with a content-addressed id. No shuffle: a document is one row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for doc, text in zip(f["doc_id"], f["text"], strict=True):
                for i, (kind, part) in enumerate(glue(chunk_text(text or "", most, overlap), most)):
                    uid = hashlib.sha256(f"{doc}|{i}|{part}".encode()).hexdigest()[:32]
                    out.append((doc, i, kind, part, approx_tokens(part), uid))
            yield pd.DataFrame(out, columns=["doc_id", "chunk_index", "kind", "text", "tokens", "chunk_uid"])

    return docs.select("doc_id", "text").mapInPandas(run, CHUNKS)
