"""Secret scans by one combined deterministic automaton.

The rules' regular expressions over bytes become one nondeterministic automaton. Subset construction and
minimisation turn its reversal into transition arrays; reading a text once from its end to its start, the state
before each byte tells which rules have a match that starts there. From those rare places a second automaton of the
same rules, anchored, runs forward to the longest end. Matches of a rule are leftmost and do not overlap.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import whole

#: Between texts in a buffer; it is in no UTF-8 text and no rule's class may hold it.
APART = 0xFF
#: Bytes of texts scanned together, and the lanes they are cut into.
BUFFER, LANES = 6 << 20, 4096


def _assigned(match: bytes) -> bool:
    """The value, after the first : or =, spaces and one quote, has 12 bytes or more."""
    value = match[min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0) + 1 :].lstrip(b" ")
    return len(value[1:] if value[:1] in (b'"', b"'") else value) >= 12


def _at_least(n: int) -> Callable[[bytes], bool]:
    return lambda match: len(match) >= n


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    keep: Callable[[bytes], bool]
    any_case: bool = False


# Fixed patterns of the kinds, in the order in which ties are listed.
RULES = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+", _assigned, True),
    Rule("access", r"AKIA[A-Z0-9]+", _at_least(18)),
    Rule("hex", r"[0-9a-f]{16,}", _at_least(16)),  # in runs of hex digits, the same as one or more and then 16 or more
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", _at_least(24)),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", _at_least(15)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", _at_least(30)),
    Rule("pem", r"-----BEGIN( [A-Z]+)* PRIVATE KEY-----", _at_least(27)),
)
BASE = ("assign", "access", "hex")


class Syntax:
    """Parser of the rules' regular expressions into trees: ('set', frozenset), ('cat', [..]), ('or', [..]),
    ('times', tree, least, most or None)."""

    def __init__(self, pattern: str, any_case: bool):
        self.s, self.i, self.any_case = pattern, 0, any_case

    def parse(self):
        tree = self.alternatives()
        if self.i < len(self.s):
            raise ValueError(f"cannot read {self.s[self.i :]!r}")
        return tree

    def peek(self) -> str:
        return self.s[self.i : self.i + 1]

    def take(self) -> str:
        self.i += 1
        return self.s[self.i - 1]

    def alternatives(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence(self):
        items = []
        while self.peek() and self.peek() not in "|)":
            items.append(self.repeated(self.atom()))
        return ("cat", items)

    def repeated(self, tree):
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                end = self.s.index("}", self.i)
                low, comma, high = self.s[self.i : end].partition(",")
                self.i = end + 1
                tree = ("times", tree, int(low), int(high) if high else None if comma else int(low))
            else:
                tree = ("times", tree, int(c == "+"), 1 if c == "?" else None)
        return tree

    def escape(self) -> str:
        c = self.take()
        if c == "x":
            self.i += 2
            return chr(int(self.s[self.i - 2 : self.i], 16))
        return c

    def atom(self):
        c = self.take()
        if c == "(":
            tree = self.alternatives()
            if self.take() != ")":
                raise ValueError("a group is not closed")
            return tree
        if c == "[":
            return ("set", self.byte_class())
        if c == "\\":
            c = self.escape()
        return ("set", self.cased({ord(c)}))

    def cased(self, found: set[int]) -> frozenset[int]:
        if self.any_case:
            letters = [chr(b) for b in found if b < 128 and chr(b) in string.ascii_letters]
            found = found | {ord(x) for c in letters for x in (c.lower(), c.upper())}
        return frozenset(found - {APART})

    def byte_class(self) -> frozenset[int]:
        # Case is spelled out in classes: only letters outside them may come in either case.
        negated, found = self.peek() == "^", set()
        if negated:
            self.take()
        while (c := self.take()) != "]":
            low = self.escape() if c == "\\" else c
            if self.peek() == "-" and self.s[self.i + 1] != "]":
                self.take()
                high = self.take()
                high = self.escape() if high == "\\" else high
                found |= set(range(ord(low), ord(high) + 1))
            else:
                found.add(ord(low))
        return frozenset((set(range(256)) - found if negated else found) - {APART})


def reverse(tree):
    """The tree of the reversed language."""
    match tree:
        case ("cat", items):
            return ("cat", [reverse(x) for x in reversed(items)])
        case ("or", items):
            return ("or", [reverse(x) for x in items])
        case ("times", x, low, high):
            return ("times", reverse(x), low, high)
    return tree


class Nfa:
    """Nondeterministic automaton built piece by piece: byte edges and empty edges."""

    def __init__(self):
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, tree, start: int) -> int:
        """Add a tree from ``start``; returns the state it ends in."""
        match tree:
            case ("set", found):
                end = self.state()
                self.edges[start].append((found, end))
                return end
            case ("cat", items):
                for x in items:
                    start = self.add(x, start)
                return start
            case ("or", items):
                end = self.state()
                for x in items:
                    self.empty[self.add(x, start)].append(end)
                return end
            case ("times", x, low, high):
                for _ in range(low):
                    start = self.add(x, start)
                if high is None:
                    loop = self.state()
                    self.empty[start].append(loop)
                    self.empty[self.add(x, loop)].append(loop)
                    return loop
                end = self.state()
                self.empty[start].append(end)
                for _ in range(high - low):
                    start = self.add(x, start)
                    self.empty[start].append(end)
                return end
        raise ValueError(tree)

    def closure(self, states: Iterable[int]) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in found:
                    found.add(x)
                    todo.append(x)
        return frozenset(found)


@dataclass
class Automaton:
    """classes: class of each byte; moves[state * n_classes + class]: next state times n_classes; accepts: bit r set
    where rule r is matched; dead: the state from which nothing matches (times n_classes), or -1."""

    classes: np.ndarray
    moves: np.ndarray
    accepts: np.ndarray
    n_classes: int
    dead: int

    @property
    def n_states(self) -> int:
        return len(self.moves) // self.n_classes


def build(trees: list, anywhere: bool) -> Automaton:
    """Subset construction of all rules together, then minimisation by splitting classes of states until their
    transitions agree. ``anywhere``: a match may start at any byte."""
    nfa, finals = Nfa(), {}
    start = nfa.state()
    for r, tree in enumerate(trees):
        first = nfa.state()
        nfa.empty[start].append(first)
        finals[nfa.add(tree, first)] = r
    sets = sorted({found for edges in nfa.edges for found, _ in edges}, key=sorted)
    member = np.array([[b in found for found in sets] for b in range(256)])
    _, classes = np.unique(np.concatenate([member, np.arange(256)[:, None] == APART], 1), axis=0, return_inverse=True)
    classes = classes.ravel()
    n_classes = int(classes.max()) + 1
    sample = [int(np.flatnonzero(classes == c)[0]) for c in range(n_classes)]
    origin = nfa.closure([start])
    number, todo, rows = {origin: 0}, [origin], []
    for states in todo:
        row = []
        for byte in sample:
            if byte == APART:
                nxt = origin if anywhere else frozenset()
            else:
                nxt = nfa.closure({end for s in states for found, end in nfa.edges[s] if byte in found})
                nxt = nxt | origin if anywhere else nxt
            if nxt not in number:
                number[nxt] = len(todo)
                todo.append(nxt)
            row.append(number[nxt])
        rows.append(row)
    moves = np.array(rows)
    accepts = np.array([sum(1 << r for s, r in finals.items() if s in states) for states in todo], np.int64)
    group = np.unique(accepts, return_inverse=True)[1].ravel()
    while True:
        _, finer = np.unique(np.column_stack([group, group[moves]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == group.max():
            break
        group = finer
    # number the merged states so that the start is 0
    order = np.concatenate([[group[0]], [g for g in range(group.max() + 1) if g != group[0]]])
    rank = np.argsort(order)
    one = np.array([np.flatnonzero(group == g)[0] for g in order])
    small, marks = rank[group[moves[one]]], accepts[one]
    loops = np.flatnonzero((small == np.arange(len(one))[:, None]).all(1) & (marks == 0))
    dead = int(loops[0]) * n_classes if len(loops) else -1
    return Automaton(classes.astype(np.uint8), (small * n_classes).ravel().astype(np.int32), marks, n_classes, dead)


class Scanner:
    """All rules as two automata; texts are bytes."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        trees = [Syntax(r.pattern, r.any_case).parse() for r in rules]
        self.rules = rules
        self.starts = build([reverse(t) for t in trees], anywhere=True)
        self.ends = build(trees, anywhere=False)
        self.mark = np.repeat(self.starts.accepts, self.starts.n_classes) != 0
        self.forward = self.ends.moves.tolist()
        self.forward_class = self.ends.classes.tolist()

    def states(self, data: np.ndarray) -> np.ndarray:
        """State of the backward automaton after each byte, read from the last to the first. The buffer is cut into
        lanes that advance together; a lane that turns out to have begun in another state than assumed is read
        again until its states agree with those at hand."""
        a, n = self.starts, len(data)
        lanes = min(LANES, max(1, n // 64))
        steps = -(-n // lanes)
        padded = np.full(lanes * steps, APART, np.uint8)
        padded[:n] = data[::-1]
        codes = np.ascontiguousarray(a.classes[padded].reshape(lanes, steps).T).astype(np.int32)
        out = np.empty((steps, lanes), np.int32)
        state = np.zeros(lanes, np.int32)
        for j in range(steps):
            state = a.moves.take(state + codes[j])
            out[j] = state
        began = np.zeros(lanes, np.int32)
        while True:
            true = np.concatenate([[0], out[-1, :-1]]).astype(np.int32)
            lane = np.flatnonzero(true != began)
            if not len(lane):
                break
            began = true
            state = true[lane]
            for j in range(steps):
                state = a.moves.take(state + codes[j, lane])
                other = state != out[j, lane]
                if not other.all():
                    lane, state = lane[other], state[other]
                    if not len(lane):
                        break
                out[j, lane] = state
        return out.T.ravel()[:n][::-1]

    def longest(self, text: bytes, start: int, rule: int) -> int:
        """End of the longest match of a rule from ``start``."""
        state, end, bit, moves, classes = 0, start, 1 << rule, self.forward, self.forward_class
        n = self.ends.n_classes
        marks = self.ends.accepts
        for i in range(start, len(text)):
            state = moves[state + classes[text[i]]]
            if state == self.ends.dead:
                break
            if marks[state // n] & bit:
                end = i + 1
        return end

    def spans(self, docs: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text its spans (start, rule, end) in code points, by start and then rule."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
        data = np.frombuffer(bytes([APART]).join(docs) + bytes([APART]), np.uint8)
        states = self.states(data)
        hits = np.flatnonzero(self.mark.take(states))
        if not len(hits):
            return out
        firsts = np.concatenate([[0], np.cumsum([len(d) + 1 for d in docs])])
        of = np.searchsorted(firsts, hits, "right") - 1
        bits = self.starts.accepts[states[hits] // self.starts.n_classes]
        for d in np.unique(of).tolist():
            mine = of == d
            places, masks, text = (hits[mine] - firsts[d]).tolist(), bits[mine].tolist(), docs[d]
            found = []
            for r, rule in enumerate(self.rules):
                free = 0
                for place, mask in zip(places, masks, strict=True):
                    if mask >> r & 1 and place >= free:
                        free = self.longest(text, place, r)
                        if rule.keep(text[place:free]):
                            found.append((place, r, free))
            if found:
                before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
                out[d] = sorted((int(before[s]), r, int(before[e])) for s, r, e in found)
        return out


_scanner: list[Scanner] = []


def scanner() -> Scanner:
    """The worker's scanner of the fixed rules, compiled once."""
    if not _scanner:
        _scanner.append(Scanner())
    return _scanner[0]


def _groups(docs: list[bytes]) -> Iterator[list[bytes]]:
    group, size = [], 0
    for d in docs:
        group.append(d)
        size += len(d) + 1
        if size > BUFFER:
            yield group
            group, size = [], 0
    if group:
        yield group


def _all_spans(column) -> list[list[tuple[int, int, int]]]:
    docs = [(x or "").encode("utf-8", "surrogatepass") for x in column.to_pylist()]
    return [s for g in _groups(docs) for s in scanner().spans(g)]


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, stop>>) of every row of ``docs(doc_id, text)``, in code points.

    Null and empty texts have no spans; null ids and repeated rows are kept; other columns are ignored; an empty
    table gives no rows. No shuffle.
    """

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        for b in rows:
            found = [[{"kind": RULES[r].kind, "start": s, "stop": e} for s, r, e in x] for x in _all_spans(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, span)], names=["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind string, start long, stop long>>")


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document; see ``scan``."""
    shown = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    found = scan(docs)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(shown(base), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
    )


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[{}]") -> str:
    """The text with each stretch covered by spans replaced by the kind of its first span."""
    out, at, end = [], 0, -1
    for s, r, e in spans:
        if s >= max(end, 0) or end < 0:
            out += [text[at:s], mark.format(RULES[r].kind)]
        at = end = max(end, e)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets replaced in ``text`` and, where there is one, ``n_chars`` counted anew.
    Every row and column stays; a null text stays null; texts without secrets are unchanged."""
    names = docs.columns

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            at, old = names.index("text"), b.column("text").to_pylist()
            spans = _all_spans(b.column("text"))
            new = [redact(t, s) if s else t for t, s in zip(old, spans, strict=True)]
            columns = list(b.columns)
            columns[at] = pa.array(new, b.schema.field(at).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                counted = [len(t) if s else n for t, s, n in zip(new, spans, b.column(k).to_pylist(), strict=True)]
                columns[k] = pa.array(counted, b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
