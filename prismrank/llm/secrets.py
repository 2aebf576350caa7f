"""Secret scanning: all rules in one pass over the bytes of a text.

The rules' triggers are compiled together, by subset construction and
minimisation, into one deterministic automaton over classes of bytes, kept as a
flat array of transitions. One pass over a text gives the places where triggers
end; texts without any, nearly all, are done with it. A rule has two small
automata of its own, compiled the same way: one, of its trigger backwards, goes
from such a place to the starts of possible matches, the other, of its whole
expression, from a start to the longest match. No step looks at a byte more than
a few times, whatever the text.

Triggers leave out most of the rules' counts, as full counters of several rules
would multiply the common automaton's states to over 50,000.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismrank.llm.common import in_batches, text_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret.

    trigger: what every match begins with, to the byte at which it is noticed;
    exact: a whole match, the longest from its start; lead: the part of a match
    that doesn't count towards its length; least: how many bytes count at least.
    Shorter matches are dropped, but what they cover isn't looked at again.
    """

    kind: str
    trigger: str
    exact: str
    lead: str = ""
    least: int = 1


_LEAD = r"""([pP][aA][sS][sS][wW]([oO][rR]|)[dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?"""
BASE = (
    Rule("assign", _LEAD + "[A-Za-z0-9+/_.=-]", _LEAD + "[A-Za-z0-9+/_.=-]+", _LEAD, 6),
    Rule("access", r"AKIA[A-Z0-9]", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{12}", r"[0-9a-f]+", least=24),
)
_KEY = r"([A-Z]+ )*PRIVATE KEY( BLOCK)?-----"
MORE = (
    Rule("private_key", rf"-----BEGIN {_KEY}", rf"-----BEGIN {_KEY}(([^-]|-[^-]|--[^-]|---[^-]|----[^-])*-----END {_KEY})?"),
    Rule("github", r"(gh[pousr]|github_pat)_[A-Za-z0-9_]", r"gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_(live|test)_[0-9A-Za-z]", r"[rs]k_(live|test)_[0-9A-Za-z]{16,}"),
    Rule("npm", r"npm_[A-Za-z0-9]", r"npm_[A-Za-z0-9]{36}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url", r"[a-z][a-z0-9+.-]*://[!-.0-9;-?A-~]+:[!-.0-9;-?A-~]+@", r"[a-z][a-z0-9+.-]*://[!-.0-9;-?A-~]+:[!-.0-9;-?A-~]{3,}@"),
)
RULES = BASE + MORE


class Nfa:
    """Thompson's construction over what Python's parser makes of an expression."""

    def __init__(self, backwards: bool = False) -> None:
        self.backwards = backwards
        self.steps: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def read(self, tree, at: int) -> int:
        """Add the tree from state at; the state after it."""
        for op, arg in reversed(tree) if self.backwards else tree:
            if op is sre.LITERAL:
                at = self.step(at, frozenset([arg]))
            elif op is sre.NOT_LITERAL:
                at = self.step(at, frozenset(range(256)) - {arg})
            elif op is sre.IN:
                at = self.step(at, frozenset(b for kind, x in arg for b in ([x] if kind is sre.LITERAL else range(x[0], x[1] + 1))))
            elif op is sre.SUBPATTERN:
                at = self.read(arg[3], at)
            elif op is sre.BRANCH:
                end = self.state()
                for branch in arg[1]:
                    self.free[self.read(branch, at)].append(end)
                at = end
            elif op is sre.MAX_REPEAT:
                least, most, sub = arg
                for _ in range(least):
                    at = self.read(sub, at)
                if most is sre.MAXREPEAT:
                    loop = self.state()
                    self.free[at].append(loop)
                    self.free[self.read(sub, loop)].append(loop)
                    at = loop
                else:
                    end = self.state()
                    for _ in range(most - least):
                        self.free[at].append(end)
                        at = self.read(sub, at)
                    self.free[at].append(end)
                    at = end
            else:
                raise ValueError(f"not supported in a trigger: {op}")
        return at

    def step(self, at: int, on: frozenset[int]) -> int:
        self.steps[at].append((on, to := self.state()))
        return to

    def closed(self, states: set[int]) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for to in self.free[todo.pop()]:
                if to not in found:
                    found.add(to)
                    todo.append(to)
        return frozenset(found)


@dataclass
class Automaton:
    """classes: of each byte; step: next state, times the number of classes, by state + class; found: mask of the accepted expressions by state, for states of first on; dead: the state that leads nowhere."""

    classes: bytes
    step: list[int]
    first: int
    found: dict[int, int]
    start: int
    dead: int

    def scan(self, text: bytes) -> list[tuple[int, int]]:
        """(end, mask) wherever expressions end."""
        state, step, first, hits = self.start, self.step, self.first, []
        for i, c in enumerate(text.translate(self.classes), 1):
            state = step[state + c]
            if state >= first:
                hits.append((i, self.found[state]))
        return hits

    def ends(self, text: bytes, at: int, to: int = -1) -> list[int]:
        """Where matches that begin at a place end, or, with a place before it to go to, going backwards, begin."""
        state, step, first, dead, classes = self.start, self.step, self.first, self.dead, self.classes
        out = [at] if state >= first else []
        for i in range(at, len(text)) if to < 0 else range(at - 1, to - 1, -1):
            state = step[state + classes[text[i]]]
            if state >= first:
                out.append(i + 1 if to < 0 else i)
            elif state == dead:
                break
        return out


@lru_cache(maxsize=64)
def compiled(expressions: tuple[str, ...], anywhere: bool = True, backwards: bool = False) -> Automaton:
    """The minimal deterministic automaton that accepts wherever one of the expressions ends: begun anywhere, or at the start alone; forwards or backwards."""
    nfa, ends = Nfa(backwards), {}
    start = nfa.state()
    for k, expression in enumerate(expressions):
        begin = nfa.state()
        nfa.free[start].append(begin)
        ends[nfa.read(re._parser.parse(expression), begin)] = k
    sets = sorted({on for steps in nfa.steps for on, _ in steps}, key=sorted)
    by_byte = [tuple(b in on for on in sets) for b in range(256)]
    kinds = sorted(set(by_byte))
    classes = bytes(kinds.index(b) for b in by_byte)
    member = {on: [k for k, kind in enumerate(kinds) if kind[i]] for i, on in enumerate(sets)}
    opening = nfa.closed({start})
    again = opening if anywhere else frozenset()
    reach = [[(member[on], nfa.closed({to})) for on, to in steps] for steps in nfa.steps]
    number, todo, table, masks = {opening: 0, frozenset(): 1}, [opening, frozenset()], [], []
    while todo:
        now = todo.pop(0)
        to: list[set[int]] = [set(again) if now else set() for _ in kinds]
        for s in now:
            for ks, target in reach[s]:
                for k in ks:
                    to[k] |= target
        masks.append(sum(1 << ends[s] for s in now if s in ends))
        row = []
        for t in map(frozenset, to):
            if t not in number:
                number[t] = len(number)
                todo.append(t)
            row.append(number[t])
        table.append(row)
    steps = np.array(table)
    block = np.unique(masks, return_inverse=True)[1]
    while True:  # Moore's refinement: states stay together while their successors do
        finer = np.unique(np.column_stack([block, block[steps]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    n = block.max() + 1
    one = np.zeros(n, dtype=int)
    one[block] = np.arange(len(block))  # any state of each block
    accepts = np.array([masks[s] != 0 for s in one])
    order = np.argsort(accepts, kind="stable")  # accepting states last
    rank = np.empty(n, dtype=int)
    rank[order] = np.arange(n)
    flat = (rank[block[steps[one[order]]]] * len(kinds)).ravel().tolist()
    found = {int(rank[b]) * len(kinds): masks[one[b]] for b in range(n) if accepts[b]}
    return Automaton(classes, flat, int((~accepts).sum()) * len(kinds), found, int(rank[block[0]]) * len(kinds), int(rank[block[1]]) * len(kinds))


def _matches(data: bytes, ends: list[int], rule: Rule) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of a rule, given where its trigger ends."""
    back, whole = compiled((rule.trigger,), False, True), compiled((rule.exact,), False)
    done = 0
    for end in ends:
        if end <= done:
            continue
        for start in reversed(back.ends(data, end, done)):
            if stops := whole.ends(data, start):
                done = stops[-1]
                counted = compiled((rule.lead,), False).ends(data, start)[-1] if rule.lead else start
                if done - counted >= rule.least:
                    yield start, done
                break


def spans_of(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """(start, end, number of the rule) of each secret in code points, by start and then rule; leftmost and non-overlapping for each rule."""
    data = text.encode("utf-8", "replace")
    hits = compiled(tuple(r.trigger for r in rules)).scan(data)
    if not hits:
        return []
    seen = reduce(or_, (mask for _, mask in hits))
    spans = [(a, b, k) for k, rule in enumerate(rules) if seen >> k & 1 for a, b in _matches(data, [e for e, mask in hits if mask >> k & 1], rule)]
    spans.sort(key=lambda s: (s[0], s[2]))
    if len(data) > len(text) and spans:  # places in code points: bytes that begin one, counted
        before = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
        spans = [(int(before[a]), int(before[b]), k) for a, b, k in spans]
    return spans


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end), of every document.

    A null or empty text has none; repeated rows are scanned each; a null
    doc_id stays null; other columns are ignored.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span))])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": rules[k].kind, "start": a, "end": b} for a, b, k in spans_of(t, rules)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, schema.field(1).type)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).transform(in_batches).mapInArrow(over, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digest(found: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """Counts and a digest of the base kinds' spans, and all spans as text; without spans, zeros, the digest of no text and an empty text. Rows of found with the same doc_id stay rows of their own."""
    kinds = [r.kind for r in base]

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    of_base = F.filter("spans", lambda s: s["kind"].isin(kinds))

    def of(kind: str):
        return F.filter("spans", lambda s: s["kind"] == kind)

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(joined(of_base), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with [kind] in place of each secret, and n_chars of the new text. Overlapping spans become one, named after the first.

    A null text stays null; all columns and rows stay.
    """
    at = docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        if not text or not (spans := spans_of(text, rules)):
            return text
        out, done = [], 0
        for a, b, k in spans:
            if a >= done:
                out += [text[done:a], f"[{rules[k].kind}]"]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([clean(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([texts if i == at else batch.column(i) for i in range(batch.num_columns)], schema=batch.schema)

    out = docs.transform(in_batches).mapInArrow(over, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
