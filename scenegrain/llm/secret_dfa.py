"""Secret scans with one deterministic automaton for all rules.

Each rule is a regular expression over bytes. It is parsed into a non-deterministic automaton that may start anywhere,
made deterministic by subset construction and minimised; the automata of all rules are then combined into one, by sets
of their states, and minimised again. The result is a transition array that reads each byte of a text once, whatever
the number of rules. Where it accepts, the rule's own automata (the same construction, forwards from a start, and
backwards from an end) give the leftmost start and the longest end; they read a byte a fixed number of times.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

WORD = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


@dataclass(frozen=True)
class Rule:
    """`least`: characters that the value (after `head`) or the match must have; shorter matches are dropped."""

    kind: str
    pattern: str
    least: int = 1
    head: str = ""
    any_case: bool = False


#: The three base rules, in order, then what the method adds.
BASE = (
    Rule("assign", r"[A-Za-z0-9+/_.=-]+", 6, r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?""", True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
ADDED = (
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abpr]-[A-Za-z0-9-]+", 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


class Nfa:
    """Thompson construction for the syntax that rules use: literals, classes, groups, |, ?, *, +, {n}, {n,}, {n,m}."""

    def __init__(self):
        self.eps: list[list[int]] = []
        self.step: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.eps.append([])
        self.step.append([])
        return len(self.eps) - 1

    def build(self, node) -> tuple[int, int]:
        kind = node[0]
        a, b = self.state(), self.state()
        if kind == "set":
            self.step[a].append((node[1], b))
        elif kind == "cat":
            at = a
            for x in node[1]:
                s, e = self.build(x)
                self.eps[at].append(s)
                at = e
            self.eps[at].append(b)
        elif kind == "or":
            for x in node[1]:
                s, e = self.build(x)
                self.eps[a].append(s)
                self.eps[e].append(b)
        else:  # ("rep", node, least, most or None)
            _, x, least, most = node
            at = a
            for _ in range(least):
                s, e = self.build(x)
                self.eps[at].append(s)
                at = e
            if most is None:
                s, e = self.build(x)
                self.eps[at] += [s, b]
                self.eps[e] += [s, b]
            else:
                for _ in range(most - least):
                    s, e = self.build(x)
                    self.eps[at] += [s, b]
                    at = e
                self.eps[at].append(b)
        return a, b

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.eps[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


class Parser:
    def __init__(self, text: str, any_case: bool):
        self.t, self.i, self.any_case = text, 0, any_case

    def peek(self) -> str:
        return self.t[self.i : self.i + 1]

    def take(self) -> str:
        self.i += 1
        return self.t[self.i - 1]

    def byte(self, c: str) -> frozenset:
        return frozenset(c.encode() + (c.swapcase().encode() if self.any_case else b""))

    def either(self):
        parts = [self.run()]
        while self.peek() == "|":
            self.take()
            parts.append(self.run())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def run(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated(self.atom()))
        return ("cat", parts)

    def atom(self):
        c = self.take()
        if c == "(":
            x = self.either()
            self.take()
            return x
        if c == "[":
            out: set[int] = set()
            while (c := self.take()) != "]":
                c = self.take() if c == "\\" else c
                if self.peek() == "-" and self.t[self.i + 1] != "]":
                    self.take()
                    out |= set(range(ord(c), ord(self.take()) + 1))
                else:
                    out.add(ord(c))
            return ("set", frozenset(out))
        return ("set", self.byte(self.take() if c == "\\" else c))

    def repeated(self, x):
        c = self.peek()
        if c in ("?", "*", "+"):
            self.take()
            return ("rep", x, int(c == "+"), 1 if c == "?" else None)
        if c == "{":
            self.take()
            body = ""
            while (c := self.take()) != "}":
                body += c
            a, comma, b = body.partition(",")
            return ("rep", x, int(a), int(b) if b else None if comma else int(a))
        return x


def reverse(node):
    kind = node[0]
    if kind == "cat":
        return ("cat", [reverse(x) for x in node[1][::-1]])
    if kind == "or":
        return ("or", [reverse(x) for x in node[1]])
    return ("rep", reverse(node[1]), *node[2:]) if kind == "rep" else node


@dataclass
class Dfa:
    """move[state * 256 + byte] is the next state times 256; states from `first` (times 256) on accept; `accepts` has
    the rules of each; state `dead` (times 256, or -1) has no way out. State 0 is the start."""

    move: list[int]
    first: int
    accepts: dict[int, tuple[int, ...]]
    dead: int


def compiled(trees: list, anywhere: bool) -> Dfa:
    nfa = Nfa()
    root = nfa.state()
    ends = {}
    for k, tree in enumerate(trees):
        a, b = nfa.build(tree)
        nfa.eps[root].append(a)
        ends[b] = k
    # Bytes that no rule tells apart share a class.
    sets = {s for steps in nfa.step for s, _ in steps}
    signature = [tuple(b in s for s in sets) for b in range(256)]
    classes = {x: i for i, x in enumerate(dict.fromkeys(signature))}
    of = [classes[x] for x in signature]
    member = [of.index(c) for c in range(len(classes))]
    start = nfa.closure([root])
    states, todo, table, accept = {start: 0}, [start], [], []
    for s in todo:  # subset construction; `todo` grows
        accept.append(tuple(sorted(ends[x] for x in s if x in ends)))
        row = []
        for b in member:
            to = nfa.closure([t for x in s for chars, t in nfa.step[x] if b in chars] + [root] * anywhere)
            if to not in states:
                states[to] = len(todo)
                todo.append(to)
            row.append(states[to])
        table.append(row)
    return minimal(table, accept, of)


def combined(parts: list[Dfa]) -> Dfa:
    """One automaton that runs all `parts` in step: pairs of their states, as far as they are reached, minimised."""
    columns = [tuple(d.move[b::256][s] for d in parts for s in range(len(d.move) // 256)) for b in range(256)]
    classes = {x: i for i, x in enumerate(dict.fromkeys(columns))}
    of = [classes[x] for x in columns]
    member = [of.index(c) for c in range(len(classes))]
    start = (0,) * len(parts)
    states, todo, table, accept = {start: 0}, [start], [], []
    for s in todo:
        accept.append(tuple(k for k, (d, x) in enumerate(zip(parts, s)) if x >= d.first))
        row = []
        for b in member:
            to = tuple([d.move[x + b] for d, x in zip(parts, s)])
            if to not in states:
                states[to] = len(todo)
                todo.append(to)
            row.append(states[to])
        table.append(row)
    return minimal(table, accept, of)


def minimal(table: list[list[int]], accept: list[tuple[int, ...]], of: list[int]) -> Dfa:
    # Minimisation: split classes of states until each agrees on what follows.
    part = {x: i for i, x in enumerate(dict.fromkeys(accept))}
    group = [part[x] for x in accept]
    while True:
        key = [(group[i], *(group[t] for t in row)) for i, row in enumerate(table)]
        ids = {x: i for i, x in enumerate(dict.fromkeys(key))}
        new = [ids[x] for x in key]
        if len(ids) == len(set(group)):
            break
        group = new
    plain = [g for g in dict.fromkeys(new) if not accept[new.index(g)]]
    full = [g for g in dict.fromkeys(new) if accept[new.index(g)]]
    plain.sort(key=lambda g: g != new[0])
    number = {g: i for i, g in enumerate(plain + full)}
    move = [0] * (256 * len(number))
    accepts, dead = {}, -1
    times = [i * 256 for i in range(len(number))]  # the same integers in all rows
    for g, i in number.items():
        s = new.index(g)
        row = [times[number[new[t]]] for t in table[s]]
        move[i * 256 : i * 256 + 256] = [row[of[b]] for b in range(256)]
        if accept[s]:
            accepts[i * 256] = accept[s]
        elif set(row) == {i * 256}:
            dead = i * 256
    return Dfa(move, len(plain) * 256, accepts, dead)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        trees = [("cat", [Parser(r.head, r.any_case).either(), Parser(r.pattern, False).either()]) for r in rules]
        self.anywhere = [compiled([t], True) for t in trees]
        self.all = combined(self.anywhere)
        self.forward = [compiled([t], False) for t in trees]
        self.backward = [compiled([reverse(t)], False) for t in trees]
        self.heads = [compiled([Parser(r.head, r.any_case).either()], False) if r.head else None for r in rules]

        # The scan's own table: a column for each class of bytes that no rule tells apart.
        columns = list(zip(*(self.all.move[s : s + 256] for s in range(0, len(self.all.move), 256))))
        classes = {x: i for i, x in enumerate(dict.fromkeys(columns))}
        self.bytes, k = bytes(classes[x] for x in columns), len(classes)
        times = [i * k for i in range(len(columns[0]))]
        self.table = [times[x >> 8] for row in zip(*classes) for x in row]
        self.first = (self.all.first >> 8) * k
        self.ends = {(s >> 8) * k: r for s, r in self.all.accepts.items()}

    @staticmethod
    def longest(d: Dfa, data: bytes, order) -> int:
        """Bytes of the longest match along `order`; 0 if there is none."""
        s = n = best = 0
        for i in order:
            s = d.move[s + data[i]]
            if s == d.dead:
                break
            n += 1
            if s >= d.first:
                best = n
        return best

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, rule, end) in code points, by start, then rule."""
        data = text.encode("utf-8", "replace")
        move, first, accepts = self.table, self.first, self.ends
        done = [0] * len(self.rules)
        again: list[tuple[int, int]] = [(0, -1)] * len(self.rules)
        out = []
        s = 0
        for i, b in enumerate(data.translate(self.bytes)):
            s = move[s + b]
            if s >= first:
                for r in accepts[s]:
                    if i < done[r]:
                        continue
                    # What accepts may have begun before the end of the rule's last match: the rule's own automaton,
                    # started anew there, tells. It reads on from where it stood, so each byte once.
                    state, at = again[r]
                    if at >= 0:
                        own = self.anywhere[r]
                        for b in data[at : i + 1]:
                            state = own.move[state + b]
                        again[r] = state, i + 1
                        if state < own.first:
                            continue
                    a = i + 1 - self.longest(self.backward[r], data, range(i, done[r] - 1, -1))
                    e = a + self.longest(self.forward[r], data, range(a, len(data)))
                    done[r], again[r] = e, (0, e)
                    rule = self.rules[r]
                    value = e - a - (self.longest(self.heads[r], data, range(a, e)) if rule.head else 0)
                    if value >= rule.least:
                        out.append((a, r, e))
        out.sort()
        if out and len(data) != len(text):
            at = sorted({x for a, _, e in out for x in (a, e)})
            chars, last, points = {}, 0, 0
            for x in at:
                points += len(data[last:x].decode("utf-8", "replace"))
                chars[x], last = points, x
            out = [(chars[a], r, chars[e]) for a, r, e in out]
        return out


@lru_cache(4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def secret_spans(text: Column, rules: tuple[Rule, ...] = BASE + ADDED) -> Column:
    """Array of (start, rule, end) of each text: null and empty texts have none."""

    @pandas_udf("array<struct<start:int,rule:int,end:int>>")
    def scan(s: pd.Series) -> pd.Series:
        find = scanner(rules).spans
        return pd.Series([[{"start": a, "rule": r, "end": e} for a, r, e in find(t)] if t else [] for t in s])

    return scan(text)


def scan_secrets(docs: DataFrame, added: tuple[Rule, ...] = ADDED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: a row for each row of `docs`, in place.

    Spans are kind:start:end in code points, end exclusive, by start, then by the order of the rules. Within a kind
    they don't overlap; kinds may overlap each other. Null and empty texts have none; the time for a text grows with its
    length alone. Repeated rows and null ids stay, an empty table gives an empty one, other columns are not read.
    """
    rules = BASE + tuple(added)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    f = d.select("doc_id", secret_spans(F.col("text"), rules).alias("found"))
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["rule"] + 1), x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("found", lambda x: x["rule"] == k)).cast("long").alias(f"n_{BASE[k].kind}")
    return f.select("doc_id", *map(count, range(len(BASE))), F.sha2(said(F.filter("found", lambda x: x["rule"] < len(BASE))), 256).alias("base_sha256"), said(F.col("found")).alias("spans"))
