"""Secret scans with one combined automaton.

All rule patterns become one automaton by subset construction, which partition
refinement makes minimal; its transition arrays are broadcast (their size depends
on the rules alone) and every text is scanned for all rules in one pass over its
UTF-8 bytes. Where a rule begins to accept, a small automaton of the reversed
rule runs backwards to the leftmost start.

A rule's acceptance must last from the first byte that completes a match to the
longest match's end (a head and then a run of bytes does so). Matches are taken
leftmost-longest and without overlap for each rule; those shorter than the rule's
least length are dropped afterwards, so they still use up their text.

Results for special inputs: a null or empty text has no spans; nulls in other
columns are carried; equal rows give equal rows; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from .common import as_long, map_rows, release

# The base rules and those added, in the order of their listing:
# kind, pattern over bytes, least length of the match, least length of its value
# (the tail of value bytes; 0: no limit).
BASE_RULES = [
    ("assign", rb"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 0, 6),
    ("access", rb"AKIA[A-Z0-9]+", 20, 0),
    ("hex", rb"[0-9a-f]{24,}", 24, 0),
]
MORE_RULES = [
    ("github", rb"gh[pousr]_[A-Za-z0-9]+", 40, 0),
    ("slack", rb"xox[abprs]-[A-Za-z0-9-]+", 20, 0),
    ("google", rb"AIza[A-Za-z0-9_-]+", 39, 0),
    ("jwt", rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40, 0),
    ("pem", rb"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
]
VALUE = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


class Pattern:
    """Reads a rule: bytes, escapes, classes, groups, |, ?, *, + and {n,m}. Nodes are
    (bytes, set), (sequence, nodes), (choice, nodes) and (repeat, node, least, most)."""

    COUNT = re.compile(rb"\?|\*|\+|\{(\d+)(,?)(\d*)\}")

    def __init__(self, text: bytes) -> None:
        self.text, self.i = text, 0

    def next_is(self, stops: bytes) -> bool:
        return self.text[self.i : self.i + 1] in [stops[k : k + 1] for k in range(len(stops))]

    def byte(self) -> int:
        c = self.text[self.i]
        self.i += 1
        if c != 0x5C:
            return c
        c = self.text[self.i]
        self.i += 1
        if c == 0x78:
            self.i += 2
            return int(self.text[self.i - 2 : self.i], 16)
        if chr(c).isalnum():
            raise ValueError(f"rule patterns have no escape {chr(c)}")
        return c

    def choice(self) -> tuple:
        options = [self.sequence()]
        while self.next_is(b"|"):
            self.i += 1
            options.append(self.sequence())
        return ("choice", options)

    def sequence(self) -> tuple:
        items = []
        while self.i < len(self.text) and not self.next_is(b"|)"):
            items.append(self.repeated(self.one()))
        return ("sequence", items)

    def repeated(self, node: tuple) -> tuple:
        m = self.COUNT.match(self.text, self.i)
        if not m:
            return node
        self.i = m.end()
        if m[0] in (b"?", b"*", b"+"):
            return ("repeat", node, int(m[0] == b"+"), 1 if m[0] == b"?" else None)
        return ("repeat", node, int(m[1]), int(m[3]) if m[3] else None if m[2] else int(m[1]))

    def one(self) -> tuple:
        if self.next_is(b"("):
            self.i += 1
            node = self.choice()
            self.i += 1
            return node
        if self.next_is(b".^$*+?{"):
            raise ValueError(f"rule patterns have no {chr(self.text[self.i])} here")
        if not self.next_is(b"["):
            return ("bytes", frozenset([self.byte()]))
        self.i += 1
        found: set[int] = set()
        while not self.next_is(b"]"):
            first = last = self.byte()
            if self.next_is(b"-") and self.text[self.i + 1 : self.i + 2] != b"]":
                self.i += 1
                last = self.byte()
            found.update(range(first, last + 1))
        self.i += 1
        return ("bytes", frozenset(found))


class Nfa:
    """States with empty moves and moves on sets of bytes."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, node: tuple, at: int) -> int:
        """Append a pattern at a state; gives the state behind it."""
        kind, inner, *counts = node
        if kind == "sequence":
            for x in inner:
                at = self.add(x, at)
            return at
        end = self.state()
        if kind == "bytes":
            self.moves[at].append((inner, end))
        elif kind == "choice":
            for x in inner:
                self.empty[self.add(x, at)].append(end)
        else:
            least, most = counts
            for _ in range(least):
                at = self.add(inner, at)
            if most is None:
                loop = self.state()
                self.empty[at].append(loop)
                self.empty[self.add(inner, loop)].append(loop)
                at = loop
            else:
                for _ in range(most - least):
                    self.empty[at].append(end)
                    at = self.add(inner, at)
            self.empty[at].append(end)
        return end

    def reverse(self, start: int, end: int) -> tuple[Nfa, int, int]:
        out = Nfa()
        for _ in self.empty:
            out.state()
        for s, to in enumerate(self.empty):
            for t in to:
                out.empty[t].append(s)
        for s, to in enumerate(self.moves):
            for b, t in to:
                out.moves[t].append((b, s))
        return out, end, start

    def closed(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


@dataclass
class Dfa:
    """next_state[state, byte]; accepts[state] has a bit for each rule. State 0 is
    the start; states that accept come last, from first_accepting on."""

    next_state: np.ndarray
    accepts: np.ndarray
    first_accepting: int


def determinise(nfa: Nfa, start: int, ends: dict[int, int], anywhere: bool) -> Dfa:
    """Subset construction over classes of bytes that no rule tells apart, then
    partition refinement. anywhere: a match may start at each byte."""
    marks: dict[tuple, int] = {}
    sets = list({b for moves in nfa.moves for b, _ in moves})
    kind = np.array([marks.setdefault(tuple(x in b for b in sets), len(marks)) for x in range(256)])
    example = [int(np.flatnonzero(kind == k)[0]) for k in range(len(marks))]
    first = nfa.closed([start])
    ids, todo, table = {first: 0}, [first], []
    while todo:
        now = todo.pop(0)
        row = []
        for x in example:
            to = {t for s in now for b, t in nfa.moves[s] if x in b}
            to = nfa.closed(to | set(first) if anywhere else to)
            if to not in ids:
                ids[to] = len(ids)
                todo.append(to)
            row.append(ids[to])
        table.append(row)
    t = np.array(table)
    accepts = np.array([sum({1 << r for e, r in ends.items() if e in s}) for s in ids], dtype=np.int64)
    part = np.unique(accepts, return_inverse=True)[1]
    while True:  # minimal when no class of states splits any more
        finer = np.unique(np.column_stack([part, part[t]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == part.max():
            break
        part = finer
    example_of = np.unique(part, return_index=True)[1]
    order = sorted(range(len(example_of)), key=lambda p: (accepts[example_of[p]] != 0, p != part[0], p))
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    states = example_of[order]
    return Dfa(place[part[t[states]]][:, kind].astype(np.int32), accepts[states], int((accepts[states] == 0).sum()))


@cache
def _compiled(rules: tuple):
    out = compile_rules(rules)
    release()
    return out


def compile_rules(rules) -> tuple[Dfa, list[tuple[Dfa, Dfa]]]:
    """The combined automaton; for each rule its own one and the reversed one."""
    whole, ends = Nfa(), {}
    start, own = whole.state(), []
    for r, (_, pattern, *_) in enumerate(rules):
        begin = whole.state()
        whole.empty[start].append(begin)
        ends[whole.add(Pattern(pattern).choice(), begin)] = r
        one = Nfa()
        s = one.state()
        e = one.add(Pattern(pattern).choice(), s)
        back, s2, e2 = one.reverse(s, e)
        own.append((determinise(one, s, {e: 0}, True), determinise(back, s2, {e2: 0}, False)))
    return determinise(whole, start, ends, True), own


class Scanner:
    def __init__(self, rules: list[tuple], compiled) -> None:
        self.rules = rules
        whole, own = compiled
        # Bytes that no rule tells apart share a column, and equal numbers an object.
        columns, kind = np.unique(whole.next_state, axis=1, return_inverse=True)
        self.kind, numbers = bytes(kind.ravel().tolist()), list(range(len(columns)))
        self.rows = [[numbers[x] for x in row] for row in columns.tolist()]
        self.first, self.accepts = whole.first_accepting, whole.accepts.tolist()
        self.own = [(f.next_state.tolist(), f.first_accepting) for f, _ in own]
        self.back = [(b.next_state.tolist(), b.first_accepting, self._dead(b)) for _, b in own]

    @staticmethod
    def _dead(d: Dfa) -> int:
        alone = np.flatnonzero((d.next_state == np.arange(len(d.next_state))[:, None]).all(1) & (d.accepts == 0))
        return int(alone[0]) if len(alone) else -1

    def runs(self, data: bytes) -> dict[int, list[tuple[int, int]]]:
        """For each rule the stretches of accepting bytes, as (first end, last end)."""
        rows, first, s, before = self.rows, self.first, 0, 0
        found: dict[int, list[tuple[int, int]]] = {}
        began: dict[int, int] = {}
        for i, b in enumerate(data.translate(self.kind)):
            s = rows[s][b]
            if s >= first or before:
                now = self.accepts[s]
                if now != before:
                    for r in range((now | before).bit_length()):
                        if (now ^ before) >> r & 1:
                            if now >> r & 1:
                                began[r] = i + 1
                            else:
                                found.setdefault(r, []).append((began.pop(r), i))
                    before = now
        for r, i in began.items():
            found.setdefault(r, []).append((i, len(data)))
        return found

    def _start(self, r: int, data: bytes, end: int, least: int) -> int:
        rows, first, dead = self.back[r]
        s, best = 0, -1
        for i in range(end - 1, least - 1, -1):
            s = rows[s][data[i]]
            if s == dead:
                break
            if s >= first:
                best = i
        return best

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(rule, start, end) in code points, by start and then rule."""
        data = (text or "").encode("utf-8", "surrogatepass")
        out = []
        for r, runs in self.runs(data).items():
            _, _, least, least_value = self.rules[r]
            done = 0
            for first_end, end in runs:
                while done < end:
                    start = self._start(r, data, first_end, done) if first_end > done else -1
                    if start < 0:  # its start lies in the match before: look again from there
                        rows, first = self.own[r]
                        s, first_end = 0, 0
                        for i in range(done, end):
                            s = rows[s][data[i]]
                            if s >= first:
                                first_end = i + 1
                                break
                        if not first_end:
                            break
                        start = self._start(r, data, first_end, done)
                    done = end
                    value = end - first_end + 1
                    if end - start >= least and value >= least_value:
                        out.append((r, start, end))
        if out and not data.isascii():
            # Code points before each byte: those that begin before it.
            points = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
            out = [(r, int(points[s] - 1), int(points[e - 1])) for r, s, e in out]
        return sorted(out, key=lambda x: (x[1], x[0]))


def _listed(rules: list[tuple], spans) -> str:
    return ",".join(f"{rules[r][0]}:{s}:{e}" for r, s, e in spans)


def scan_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", more_rules: list[tuple] = MORE_RULES) -> DataFrame:
    """A row for each row of docs: key, the number of spans of each base rule, a
    digest of the base spans and all spans as kind:start:end (code points)."""
    rules = BASE_RULES + list(more_rules)
    shared = docs.sparkSession.sparkContext.broadcast(_compiled(tuple(rules)))
    base = len(BASE_RULES)

    def start():
        scanner = Scanner(rules, shared.value)

        def batch(cols):
            out = []
            for k, t in zip(*cols, strict=True):
                spans = scanner.spans(t)
                own = [x for x in spans if x[0] < base]
                out.append((k, *(sum(x[0] == r for x in own) for r in range(base)), hashlib.sha256(_listed(rules, own).encode()).hexdigest(), _listed(rules, spans)))
            return [list(c) for c in zip(*out, strict=True)] if out else [[]] * (base + 3)

        return batch

    counts = ", ".join(f"n_{kind} long" for kind, *_ in BASE_RULES)
    return map_rows(as_long(docs, key, text), f"{key} long, {counts}, base_sha256 string, spans string", start)


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "[secret]", more_rules: list[tuple] = MORE_RULES) -> DataFrame:
    """docs with each span in the text replaced by mark; overlapping spans share
    one mark. A null text stays null."""
    from pyspark.sql import functions as F
    from pyspark.sql.functions import pandas_udf

    rules = BASE_RULES + list(more_rules)
    shared = docs.sparkSession.sparkContext.broadcast(_compiled(tuple(rules)))

    def clean(batches):
        scanner = Scanner(rules, shared.value)

        def one(t):
            if t is None:
                return None
            out, at = [], 0
            for _, s, e in scanner.spans(t):
                if s >= at:
                    out += [t[at:s], mark]
                at = max(at, e)
            return "".join([*out, t[at:]])

        for texts in batches:
            yield texts.map(one)

    import pandas as pd
    from collections.abc import Iterator

    clean.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(text, pandas_udf(clean, "string")(F.col(text)))
