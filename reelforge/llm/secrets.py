"""Secret scans by one combined deterministic automaton.

Each rule's regex becomes a Thompson NFA; subset construction with ordered states gives its leftmost-first search
automaton, which starts over by itself after a match; the product of all rules' automata is minimised and laid out as
one transition array over bytes. A text is scanned once, all rules together; where a match ends, a reverse automaton of
its rule finds the start. A rule may name a form of its match that is too short to report: such matches are consumed,
as a regex search would, and dropped. A rule may also name what follows its match and belongs to the secret, as a key's
body follows its first line.

Cases: null counts as empty text; spans are in code points of the text, end exclusive; repeated rows give equal rows;
extra columns are not read by scanned() and kept by redacted(); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as c
import re._parser as parser
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelforge.llm.shared import held, new_run, plainly_named


@dataclass(frozen=True)
class Rule:
    """good and short: regexes of matches to report and to consume alone, after the common head; good comes first.

    rest: a regex of re, matched where a good match ends; the span then ends where rest does. It holds no match of the rule.
    """

    name: str
    head: str
    good: str
    short: str = ""
    base: bool = False
    rest: str = ""


_VALUE = "[A-Za-z0-9+/_.=-]"
# A private key up to its last line, whatever lies between unless another block begins; where the last line is missing,
# the lines of base64 that follow, also quoted or with line ends written as escapes.
_BEGIN, _CLOSE = "(?:-----|---- )BEGIN (?:[A-Z0-9]+ )*", "PRIVATE KEY(?: BLOCK)?(?:-----| ----)"
_BETWEEN, _BASE64 = r"""(?:[\s"'`,;>#*|+]|\\+[nrt])++""", "[A-Za-z0-9+/=]"
_WHOLE = r"(?:(?!-----BEGIN |---- BEGIN )[\s\S])*?(?:-----|---- )END (?:[A-Z0-9]+ )*" + _CLOSE
_CUT = (
    rf"(?:{_BETWEEN}(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|Subject): [^\r\n\\]*+)*+"
    rf"(?:(?:{_BETWEEN}{_BASE64}{{16,}}+)++(?:{_BETWEEN}{_BASE64}++(?=[ \t]*(?:[\r\n\\\"']|\Z))){{0,2}}+|{_BETWEEN}{_BASE64}++(?=\s*\Z))?"
)
# Fixed forms that the scan's contract names, then those of some issuers' published token formats.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", _VALUE + "{8,}", _VALUE + "{1,7}", True),
    Rule("access", "AKIA", "[A-Z0-9]{12,}", "[A-Z0-9]{1,11}", True),
    Rule("hex", "", "[0-9a-f]{32,}", "[0-9a-f]{1,31}", True),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]{10,}", "[A-Za-z0-9-]{1,9}"),
    Rule("pem", _BEGIN + _CLOSE, "", rest=f"{_WHOLE}|{_CUT}"),
)


class Nfa:
    """Thompson's construction over bytes. Each state is ('byte', set, next), ('split', [next...]) or ('match', label)."""

    def __init__(self):
        self.states: list[tuple] = []

    def add(self, *state) -> int:
        self.states.append(state)
        return len(self.states) - 1

    def build(self, pattern: str, then: int, backwards: bool = False) -> int:
        return self._sequence(parser.parse(pattern), then, False, backwards)

    def _sequence(self, items, then: int, fold: bool, backwards: bool) -> int:
        for op, arg in items if backwards else reversed(list(items)):
            then = self._one(op, arg, then, fold, backwards)
        return then

    def _one(self, op, arg, then, fold, backwards) -> int:
        if op is c.LITERAL:
            return self.add("byte", self._folded({arg}, fold), then)
        if op is c.IN:
            found: set[int] = set()
            for kind, x in arg:
                if kind is c.LITERAL:
                    found.add(x)
                elif kind is c.RANGE:
                    found.update(range(x[0], x[1] + 1))
                else:
                    raise ValueError(f"{kind} is not supported in a class")
            return self.add("byte", self._folded(found, fold), then)
        if op is c.SUBPATTERN:
            return self._sequence(arg[3], then, fold or bool(arg[1] & 2), backwards)
        if op is c.BRANCH:
            return self.add("split", [self._sequence(x, then, fold, backwards) for x in arg[1]])
        if op is c.MAX_REPEAT:
            least, most, body = arg
            if most is c.MAXREPEAT:
                loop = self.add("split", [])
                self.states[loop][1].extend([self._sequence(body, loop, fold, backwards), then])
                then = loop
            else:
                for _ in range(most - least):
                    then = self.add("split", [self._sequence(body, then, fold, backwards), then] if then is not None else [])
            for _ in range(least):
                then = self._sequence(body, then, fold, backwards)
            return then
        raise ValueError(f"{op} is not supported in a rule")

    @staticmethod
    def _folded(found: set[int], fold: bool) -> frozenset[int]:
        if fold:
            found = {ord(f(chr(x))) for x in found for f in (str.lower, str.upper)}
        if max(found) > 127:
            raise ValueError("rules are over ASCII")
        return frozenset(found)

    def closure(self, first: int) -> list[int]:
        """The states that consume or match, reached from first, best first."""
        out, seen, todo = [], set(), [first]
        while todo:
            s = todo.pop()
            if s in seen:
                continue
            seen.add(s)
            if self.states[s][0] == "split":
                todo.extend(reversed(self.states[s][1]))
            else:
                out.append(s)
        return out


def search_automaton(rule: Rule) -> tuple[list[list[int]], list[list[int]], list[int]]:
    """Next state and event by state and byte, and event at the text's end. Events: 0 none, 1 short, 2 good match ended."""
    nfa = Nfa()
    ends = [nfa.build(rule.good, nfa.add("match", 2))] + ([nfa.build(rule.short, nfa.add("match", 1))] if rule.short else [])
    start = nfa.closure(nfa.build(rule.head, nfa.add("split", ends)))

    def cut(threads: list[int]) -> tuple[int, ...]:
        out = []
        for t in dict.fromkeys(threads):
            out.append(t)
            if nfa.states[t][0] == "match":
                break
        return tuple(out)

    def label(state: tuple[int, ...]) -> int:
        return nfa.states[state[-1]][1] if state and nfa.states[state[-1]][0] == "match" else 0

    def step(state: tuple[int, ...], b: int) -> tuple[tuple[int, ...], int]:
        held = label(state)
        threads = [y for t in state if nfa.states[t][0] == "byte" and b in nfa.states[t][1] for y in nfa.closure(nfa.states[t][2])]
        if held and not threads:
            return step(cut(start), b)[0], held
        if held and not label(cut(threads)):
            raise ValueError(f"{rule.name}: a match may end before its search does")
        return cut(threads if held else threads + start), 0

    ids, nexts, events, order = {cut(start): 0}, [], [], [cut(start)]
    for state in order:
        row, said = [0] * 256, [0] * 256
        for b in range(256):
            to, said[b] = step(state, b)
            if to not in ids:
                ids[to] = len(order)
                order.append(to)
            row[b] = ids[to]
        nexts.append(row)
        events.append(said)
    return nexts, events, [label(s) for s in order]


class Automaton:
    """The minimised product of the rules' search automata."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        parts = [search_automaton(r) for r in rules]
        # A run of one class of bytes cannot be entered from within a short one: its short ends are no news.
        quiet = [not r.head for r in rules]
        say = lambda found: tuple((k, e) for k, e in enumerate(found) if e == 2 or e and not quiet[k])
        columns: dict[tuple, int] = {}
        self.classes = [columns.setdefault(tuple((tuple(r[b] for r in p[0]), tuple(r[b] for r in p[1])) for p in parts), len(columns)) for b in range(256)]
        byte_of = {k: b for b, k in reversed(list(enumerate(self.classes)))}
        first = (0,) * len(rules)
        ids, order, nexts, events = {first: 0}, [first], [], []
        for state in order:
            row, said = [], []
            for k in range(len(columns)):
                b = byte_of[k]
                to = tuple(p[0][s][b] for p, s in zip(parts, state, strict=True))
                if to not in ids:
                    ids[to] = len(order)
                    order.append(to)
                row.append(ids[to])
                said.append(say(p[1][s][b] for p, s in zip(parts, state, strict=True)))
            nexts.append(row)
            events.append(said)
        last = [say(p[2][s] for p, s in zip(parts, state, strict=True)) for state in order]
        self.subsets = len(order)
        # Moore's refinement: states are one while their events and the blocks they lead to agree.
        block = self._numbered([(last[s], tuple(events[s])) for s in range(len(order))])
        while len(set(block)) < len(set(finer := self._numbered([(block[s], tuple(block[x] for x in nexts[s])) for s in range(len(order))]))):
            block = finer
        shifted = [k << 8 for k in range(len(set(block)))]  # one object per state, not per transition
        lead = {}
        for s, k in enumerate(block):
            lead.setdefault(k, s)
        self.size = len(lead)
        self.said: list[tuple] = [()]  # events by number; a transition with one is negative
        self.table: list[int] = []
        number: dict[tuple, int] = {}
        for k in range(self.size):
            s = lead[k]
            for b in range(256):
                j = self.classes[b]
                to, what = shifted[block[nexts[s][j]]], events[s][j]
                if what:
                    if (what, to) not in number:
                        number[what, to] = len(self.said)
                        self.said.append((what, to))
                    to = -number[what, to]
                self.table.append(to)
        self.start, self.last = block[0] << 8, [last[lead[k]] for k in range(self.size)]
        self.back = [Backwards(r) for r in rules]
        self.rest = [re.compile(r.rest.encode()) if r.rest else None for r in rules]

    @staticmethod
    def _numbered(keys: list) -> list[int]:
        seen: dict = {}
        return [seen.setdefault(k, len(seen)) for k in keys]

    def ends(self, data: bytes) -> Iterator[tuple[int, int, int]]:
        """(end, rule, event) in one pass over the bytes."""
        table, said, s, at = self.table, self.said, self.start, 0
        for b in data:
            s = table[s | b]
            if s < 0:
                what, s = said[-s]
                for rule, event in what:
                    yield at, rule, event
            at += 1
        for rule, event in self.last[s >> 8]:
            yield at, rule, event

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) of all good matches, by start and then rule, in bytes."""
        out, free = [], [0] * len(self.rules)
        for end, rule, event in self.ends(data):
            if event == 2:
                more = self.rest[rule] and self.rest[rule].match(data, end)
                out.append((self.back[rule].start(data, end, free[rule]), rule, more.end() if more else end))
            free[rule] = end
        return sorted(out)


class Backwards:
    """A rule's reversed automaton, made state by state as texts need it."""

    def __init__(self, rule: Rule):
        self.nfa = Nfa()
        match = self.nfa.add("match", 2)
        head = self.nfa.build(rule.head, match, True)
        ends = [self.nfa.build(rule.good, head, True)] + ([self.nfa.build(rule.short, head, True)] if rule.short else [])
        self.first = frozenset(self.nfa.closure(self.nfa.add("split", ends)))
        self.next: dict[tuple[frozenset, int], frozenset] = {}

    def start(self, data: bytes, end: int, least: int) -> int:
        state, found, at = self.first, end, end
        while at > least:
            key = (state, data[at - 1])
            if key not in self.next:
                states = self.nfa.states
                self.next[key] = frozenset(y for t in state if states[t][0] == "byte" and key[1] in states[t][1] for y in self.nfa.closure(states[t][2]))
            state = self.next[key]
            if not state:
                break
            at -= 1
            if any(self.nfa.states[t][0] == "match" for t in state):
                found = at
        return found


@cache
def automaton(rules: tuple[Rule, ...] = RULES) -> Automaton:
    return Automaton(rules)


def find(text: str, rules: tuple[Rule, ...] = RULES, own: Automaton | None = None) -> list[tuple[int, int, int]]:
    """(start, rule, end) in code points."""
    data = text.encode()
    spans = (own or automaton(rules)).spans(data)
    if not spans or len(data) == len(text):
        return spans
    at, chars, where = 0, 0, {}
    for x in sorted({y for s, _, e in spans for y in (s, e)}):
        chars += len(data[at:x].decode())
        at, where[x] = x, chars
    return [(where[s], k, where[e]) for s, k, e in spans]


def listed(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[k].name}:{s}:{e}" for s, k, e in spans)


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, a count per base rule, base_sha256 and spans of every whole text."""
    base, run = [k for k, r in enumerate(rules) if r.base], new_run()

    def scan(batches):
        own_automaton = held(run, Automaton, rules)
        for b in batches:
            rows = []
            for text in b["text"]:
                spans = find(text.as_py() or "", rules, own_automaton)
                own = [x for x in spans if rules[x[1]].base]
                rows.append([*(sum(x[1] == k for x in own) for k in base), hashlib.sha256(listed(own, rules).encode()).hexdigest(), listed(spans, rules)])
            names = [*(f"n_{rules[k].name}" for k in base), "base_sha256", "spans"]
            yield pa.record_batch([b["doc_id"], *(pa.array([r[i] for r in rows], pa.int64() if i < len(base) else pa.string()) for i in range(len(names)))], names=["doc_id", *names])

    counts = ", ".join(f"n_{rules[k].name} long" for k in base)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, f"doc_id long, {counts}, base_sha256 string, spans string")


def redact(text: str, rules: tuple[Rule, ...] = RULES, own: Automaton | None = None) -> str:
    out, at = [], 0
    for start, k, end in find(text, rules, own):
        if start >= at:
            out += [text[at:start], f"[{rules[k].name}]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each secret of its text, overlapping ones as one, replaced by its rule's name; all columns stay."""
    names, run = docs.columns, new_run()
    at = names.index("text")

    def clean(batches):
        own = held(run, Automaton, rules)
        for b in batches:
            texts = [None if (t := x.as_py()) is None else redact(t, rules, own) for x in b.column(at)]
            yield pa.record_batch([pa.array(texts, b.schema.field(at).type) if i == at else b.column(i) for i in range(b.num_columns)], names=names)

    return plainly_named(docs).mapInArrow(clean, docs.schema)
