"""Main text of web pages by consensus paths of their hosts.

Every page scores its containers and votes for the generalised tag-class path of the best one. The votes are counted
per host in Spark, and each page is then read again inside the containers at its host's winning paths, with the parts
beside them that read like the rest of the article.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import settle, small_join, texts

# Fixed lists of HTML's element kinds and of the words that name boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe title xmp noembed noframes".split())
DROPPED = frozenset(
    "script style noscript template textarea iframe title head nav footer aside form button select option input svg math canvas object audio video dialog menu xmp noembed noframes".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article body center div main section td".split())
PARAGRAPHS = frozenset("p pre blockquote li dd td h1 h2 h3 h4 h5 h6 div article section main body center figcaption".split())
#: An opening tag of the key closes an open element of the value, not reaching beyond the scope.
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]), "tbody": frozenset(["tbody", "thead", "tr", "td", "th"]), "body": frozenset(["head"]),
}
SCOPE = frozenset("ul ol dl table select body html article section div main aside nav footer header form".split())
CLOSE_P = BLOCKS - frozenset("caption dd dt legend option summary tbody td tfoot th thead title tr".split())
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disclaimer discussion disqus feedback footer gdpr "
    "login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination paywall popup promo promoted promotion recommendation "
    "recommendations recommended related replies reply respond responses share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola teaser teasers toolbar widget widgets".split()
)
#: A name that begins or ends like this tells the state of the page, or what it is laid out beside, not what it holds.
STATE_FIRST = frozenset("has is no with without hide show".split())
STATE_LAST = frozenset("left right open opened closed fixed sticky on off enabled disabled visible collapsed expanded".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())

#: Depth to which elements nest; deeper ones count as their ancestor at this depth, as browsers do.
DEPTH = 512
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: One attribute. A quote that nothing closes is part of an unquoted value.
ATTRIBUTE = re.compile(r"[\s/]*(?:([^\s/>=][^\s/>=]*|=[^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?)")
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
KEPT = frozenset("class id role style hidden aria-hidden".split())


@dataclass(slots=True)
class Node:
    tag: str
    up: int
    path: int  # number of the path of its nearest block in the page's table of paths
    dropped: bool
    link: bool
    block: int  # the nearest block element, itself included
    heading: bool = False
    text: int = 0  # characters of its own blocks outside links
    linked: int = 0
    score: float = 0.0


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    pieces: list[tuple[int, str]] = field(default_factory=list)  # node, decoded text, in page order
    #: Paths as (number of the path above, last step) with their numbers, so that a step takes the same room at any depth.
    numbers: dict[tuple[int, str], int] = field(default_factory=dict)
    steps: list[tuple[int, str]] = field(default_factory=lambda: [(0, "")])

    def extended(self, path: int, step: str) -> int:
        key = (path, step)
        if key not in self.numbers:
            self.numbers[key] = len(self.steps)
            self.steps.append(key)
        return self.numbers[key]

    def rendered(self, path: int) -> str:
        out = []
        while path:
            path, step = self.steps[path]
            out.append(step)
        return "".join(f">{x}" for x in reversed(out))

    def number(self, path: str) -> int | None:
        at: int | None = 0
        for step in path.split(">")[1:]:
            at = self.numbers.get((at, step))
            if at is None:
                return None
        return at


@lru_cache(4096)
def _generalised(tag: str, names: str) -> str:
    """tag.class.class with runs of digits and long hexadecimal parts as #, classes in order of name."""
    words = sorted({re.sub(r"[0-9a-f]*\d[0-9a-f]{5,}|\d+", "#", w.lower()).replace(">", "") for w in names.split()})
    return ".".join([tag.replace(">", ""), *words])


def boilerplate_name(name: str) -> bool:
    """Whether a class or id names boilerplate: a word of it does, unless the name tells of a state."""
    words = [w.lower() for w in NAME_WORDS.findall(name)]
    if not words or words[0] in STATE_FIRST or "with" in words or "without" in words:
        return False
    return not BOILERPLATE.isdisjoint(words)


@lru_cache(4096)
def named(classes: str, ids: str) -> tuple[bool, bool]:
    """Whether an element's classes and id name boilerplate, and whether they name a header, whose headings may belong
    to the article. Beside other names, one such as sidebar-left says how a wrapper is laid out."""
    names = [*classes.split(), *ids.split()]
    words = [[w.lower() for w in NAME_WORDS.findall(n)] for n in names]
    bad = [w for n, w in zip(names, words, strict=True) if boilerplate_name(n)]
    header = any("header" in w and w[0] not in STATE_FIRST and w[-1] not in STATE_LAST for w in words)
    return any(w[-1] not in STATE_LAST for w in bad) or (bool(bad) and len(bad) == len(names)), header


def _boilerplate(tag: str, at: dict[str, str]) -> tuple[bool, bool]:
    """Whether an element is boilerplate, and whether it is a header."""
    if tag in DROPPED:
        return True, False
    if at and (at.get("role", "").lower() in ROLES or "hidden" in at or at.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", at.get("style", ""))):
        return True, False
    if tag in ("html", "body", "main") or tag in HEADINGS:
        return False, False
    bad, header = named(at.get("class", ""), at.get("id", "")) if at else (False, False)
    return bad, header or tag == "header"


def _tag(source: str, at: int) -> tuple[dict[str, str], int] | None:
    """Attributes that count of the tag whose name ends at ``at``, and the end of the tag; None if the page cuts it off.
    Each character is looked at a bounded number of times, whatever the quotes."""
    found: dict[str, str] = {}
    n = len(source)
    while at < n:
        if source[at] == ">":
            return found, at + 1
        m = ATTRIBUTE.match(source, at)
        if not m:
            end = source.find(">", at)
            return (found, end + 1) if end >= 0 else None
        at = m.end()
        if (name := m[1].lower()) in KEPT and name not in found:
            found[name] = html.unescape(m[2] or m[3] or m[4] or "")
    return None


def parse(source: str) -> Page:
    """A forgiving parse in one pass: unknown or unclosed markup never fails, and a page cut anywhere keeps its text so
    far. Time and memory grow with the page's length alone, whatever its nesting and quotes."""
    page = Page([Node("html", -1, 0, False, False, 0)])
    nodes, stack = page.nodes, [0]
    opened: Counter = Counter()
    at, n = 0, len(source)

    def text(lo: int, hi: int) -> None:
        if lo < hi:
            piece = source[lo:hi]
            page.pieces.append((stack[-1], html.unescape(piece) if "&" in piece else piece))

    def close(k: int) -> None:
        for i in stack[k:]:
            opened[nodes[i].tag] -= 1
        del stack[k:]

    begun = 0  # where text that isn't stored yet begins
    while at < n:
        k = source.find("<", at)
        if k < 0 or k == n - 1:
            text(begun, k if k == n - 1 else n)
            begun = n
            break
        nxt = source[k + 1]
        if nxt in "!?":
            text(begun, k)
            end = source.find("-->", k + 4) if source.startswith("<!--", k) else source.find(">", k)
            at = begun = n if end < 0 else end + (3 if source.startswith("<!--", k) else 1)
            continue
        closing = nxt == "/"
        m = NAME.match(source, k + 1 + closing)
        if not m:
            at = k + 1
            if closing and k + 2 == n:
                text(begun, k)
                begun = n
            continue
        text(begun, k)
        tag = m[0].lower()
        if closing:
            end = source.find(">", m.end())
            at = begun = n if end < 0 else end + 1
            if opened[tag] > 0:
                for j in range(len(stack) - 1, 0, -1):
                    if nodes[stack[j]].tag == tag:
                        close(j)
                        break
                    if tag not in BLOCKS and nodes[stack[j]].tag in SCOPE:
                        break
            elif tag == "p":
                page.pieces.append((stack[-1], " "))
            continue
        rest = _tag(source, m.end())
        if rest is None:
            begun = n
            break
        attributes, at = rest
        begun = at
        if tag == "html" or (tag == "body" and opened["body"]):
            continue
        if tag in CLOSE_P and opened["p"]:
            for j in range(len(stack) - 1, 0, -1):
                if nodes[stack[j]].tag == "p":
                    close(j)
                    break
                if nodes[stack[j]].tag in SCOPE or nodes[stack[j]].tag in ("td", "th", "li"):
                    break
        if (ends := CLOSES.get(tag)) and any(opened[e] for e in ends):
            for j in range(len(stack) - 1, 0, -1):
                if nodes[stack[j]].tag in ends:
                    close(j)
                elif nodes[stack[j]].tag in SCOPE and tag != "body":
                    break
        up = stack[-1]
        if tag in VOID:
            if tag in ("br", "hr", "wbr"):
                page.pieces.append((up, " " if tag != "wbr" else ""))
            continue
        above, block = nodes[up], tag in BLOCKS
        bad, header = _boilerplate(tag, attributes)
        node = Node(
            tag, up, page.extended(above.path, _generalised(tag, attributes.get("class", ""))) if block else above.path, above.dropped or bad,
            above.link or tag == "a", len(nodes) if block else above.block, (header or above.heading) and tag not in HEADINGS,
        )
        nodes.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
            at = begun = end.end() if end else n
        elif len(stack) < DEPTH:
            stack.append(len(nodes) - 1)
            opened[tag] += 1
    text(begun, n)
    return page


def in_article(page: Page, i: int) -> bool:
    """A header's own text counts as a page's head, but for headings in a header inside a container."""
    return not page.nodes[i].dropped and not page.nodes[i].heading


def best(page: Page) -> tuple[int, float]:
    """The container with the highest score, and its score: its blocks count by the square root of their lengths
    from 25 characters on, less the share in links; a parent gets all of it and a grandparent half."""
    nodes = page.nodes
    for i, piece in page.pieces:
        if not nodes[i].dropped and not nodes[i].heading:
            size = len(piece.strip())
            b = nodes[nodes[i].block]
            b.text, b.linked = b.text + size, b.linked + size * nodes[i].link
    for i in range(len(nodes) - 1, 0, -1):
        x = nodes[i]
        if x.block != i or x.text < 25 or x.tag not in PARAGRAPHS:
            continue
        points = (1 + x.text**0.5) * (1 - x.linked / x.text) ** 2
        share, k = 1.0, i if x.tag in CONTAINERS else x.up
        while k > 0 and share > 0.2:
            if nodes[k].tag in CONTAINERS:
                nodes[k].score += points * share
                share /= 2
            k = nodes[k].up
    top = max(range(len(nodes)), key=lambda i: (nodes[i].score * (1.25 if nodes[i].tag in ("article", "main") else 1), -i))
    return top, nodes[top].score


#: Text of a part beside the article that makes it a part of the article, and the most of it that may be links.
BESIDE, LINKS = 80, 0.25


def running(x: Node, text: int, linked: int) -> bool:
    return not x.dropped and not x.heading and text >= BESIDE and linked <= LINKS * text


def with_parts_beside(page: Page, roots: list[int]) -> list[int]:
    """The roots and those other children of their parents that hold running text and few links: articles in more than
    one part. ``best`` has counted the text of each block before."""
    nodes = page.nodes
    parents = {nodes[i].up for i in roots} - {0}
    loose = {i for i in parents if nodes[i].tag == "body"}  # anything may be here, so only parts that say what they are count
    if not parents:
        return roots
    # The child of such a parent above each node, and what it holds.
    child = [-1] * len(nodes)
    text, linked = Counter(), Counter()
    for i, x in enumerate(nodes):
        child[i] = i if x.up in parents else child[x.up] if x.up >= 0 else -1
        text[child[i]] += x.text
        linked[child[i]] += x.linked
    inside = _inside(page, roots)
    more = [i for i in text if i > 0 and not inside[i] and nodes[i].block == i and running(nodes[i], text[i], linked[i]) and (nodes[i].up not in loose or nodes[i].tag in ("article", "section"))]
    return sorted([*roots, *more])


def _inside(page: Page, roots: list[int]) -> list[bool]:
    inside = [False] * len(page.nodes)
    for i in roots:
        inside[i] = True
    for i, x in enumerate(page.nodes):
        inside[i] = inside[i] or (x.up >= 0 and inside[x.up])
    return inside


def held(page: Page, root: int) -> tuple[int, int]:
    """Text in a container outside boilerplate, and its part in links; ``best`` has counted each block's."""
    inside = _inside(page, [root])
    return sum(x.text for x, i in zip(page.nodes, inside, strict=True) if i), sum(x.linked for x, i in zip(page.nodes, inside, strict=True) if i)


def gathered(page: Page, roots: list[int]) -> str:
    """Text of the blocks inside ``roots`` in page order, each with single spaces, joined by single spaces."""
    inside = _inside(page, roots)
    out, last = [], -1
    for i, piece in page.pieces:
        if inside[i] and in_article(page, i):
            if (block := page.nodes[i].block) != last:
                out.append(" ")
                last = block
            out.append(piece)
    return " ".join("".join(out).split())


def vote(source: str) -> tuple[str, float]:
    page = parse(source)
    top, points = best(page)
    return page.rendered(page.nodes[top].path), points


def extract(source: str, paths: list[str]) -> tuple[str, str]:
    """Text inside the containers at ``paths``, the first path first and at later ones only what neither holds nor is
    inside of what is taken, else in the page's own best container, with the parts beside them; else of all that is not
    boilerplate. And the paths used, apart by a space ('' for the last)."""
    page = parse(source)
    top, points = best(page)
    nodes = page.nodes
    roots: list[int] = []
    used: list[str] = []
    for path in paths:
        number = page.number(path)
        here = [i for i, x in enumerate(nodes) if x.path == number and x.block == i and not x.dropped and i > 0] if number else []
        if not here:
            continue
        inside, holds = _inside(page, roots), set()
        for i in roots:
            while i > 0 and i not in holds:
                holds.add(i)
                i = nodes[i].up
        here = [i for i in here if not inside[i] and i not in holds]
        if roots and here:
            here = [i for i in here if running(nodes[i], *held(page, i))]
        if here and gathered(page, here):
            roots += here
            used.append(path)
    if roots and (text := gathered(page, with_parts_beside(page, roots))):
        return text, " ".join(used)
    if points > 0 and (text := gathered(page, with_parts_beside(page, [top]))):
        return text, page.rendered(nodes[top].path)
    return gathered(page, [0]), ""


def host(url: Column) -> Column:
    """Lower-case host of a URL; null without one."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


#: Paths with at least this share of a host's votes win, so twenty at most.
SHARE = 0.05


def consensus(pages: DataFrame) -> DataFrame:
    """(host, paths) of each host: winning paths, the one with the most votes first; a host whose pages all differ has
    none. Votes are added up before the shuffle, so a host with a third of all pages is a row for each path and task."""

    def votes(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            found = [vote(x) for x in texts(b.column("html"))]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array([p for p, _ in found]), pa.array([s for _, s in found], pa.float64())], names=["host", "path", "points"])

    rows = pages.select(host(F.col("url")).alias("host"), F.col("html")).where("host is not null and html <> ''")
    counted = rows.mapInArrow(votes, "host string, path string, points double").where("points > 0")
    counted = counted.groupBy("host", "path").agg(F.count("*").alias("n"))
    winning = counted.withColumn("all", F.sum("n").over(Window.partitionBy("host"))).where(F.col("n") >= F.col("all") * SHARE)
    listed = winning.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "path"))).alias("p"))
    return listed.select("host", F.expr("transform(p, x -> x.path)").alias("paths"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, path of every row of ``pages(page_id, url, html)``.

    Null or empty html gives the empty text; a page without a host uses its own best container; null ids and
    repeated rows are kept; other columns are ignored; an empty table gives no rows. Pages of any length and nesting
    are read whole.
    """
    winners = settle(consensus(pages), "host-paths")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))

    def read(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            found = [extract(s, p or []) if s else ("", "") for s, p in zip(b.column("html").to_pylist(), b.column("paths").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64()), pa.array([p for _, p in found], pa.string())],
                names=["page_id", "url", "text", "n_chars", "path"],
            )

    joined = small_join(rows, winners, ["host"], "left", 512)
    return joined.select("page_id", "url", "html", "paths").mapInArrow(read, "page_id long, url string, text string, n_chars long, path string")
