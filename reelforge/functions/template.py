"""The template language `{path::op::op}` and `{condition["then"||"else"]}`, compiled into one Column expression.

A template is parsed once, when the plan is made; rows are rendered by built-in functions alone. Conditions are
operators after a field (exists istrue isfalse ~ ~= = > >= < <=), joined by `and` within groups and `or` between them;
branches are templates again. Text that is no whole placeholder stands for itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelforge.functions.text import trimmed


@dataclass(frozen=True)
class Value:
    """A column and how it reads: text, number, bytes (a number shown with a unit), bool or list (of strings)."""

    column: Column
    kind: str = "text"


def _scan(text: str, hit: Callable[[str, int, int], bool], nested: bool = True) -> int:
    """The first place outside quotes (and, if nested, parentheses) for which hit(text, place, depth); else -1."""
    quote, depth = "", 0
    for i, ch in enumerate(text):
        if quote:
            quote = "" if ch == quote and text[i - 1 : i] != "\\" else quote
            continue
        if ch in "'\"":
            quote = ch
        elif ch == "(" and nested:
            depth += 1
        elif ch == ")" and nested:
            depth = max(0, depth - 1)
        if hit(text, i, depth):
            return i
    return -1


def _pieces(text: str, mark: str, nested: bool = True) -> list[str]:
    out = []
    while (at := _scan(text, lambda t, i, d: d == 0 and t.startswith(mark, i), nested)) >= 0:
        out.append(text[:at])
        text = text[at + len(mark) :]
    return [*out, text]


def _operators(text: str) -> list[str]:
    return [t for t in (p.strip() for p in _pieces(text, "::")) if t]


def _literal(raw: str) -> str:
    t = raw.strip()
    if len(t) >= 2 and t[0] == t[-1] and t[0] in "'\"":
        t = t[1:-1]
    for a, b in (("\\n", "\n"), ('\\"', '"'), ("\\'", "'"), ("\\\\", "\\")):
        t = t.replace(a, b)
    return t


def _arguments(op: str) -> list[str]:
    a, b = op.find("("), op.rfind(")")
    return [] if a < 0 or b <= a else [_literal(x) for x in _pieces(op[a + 1 : b], ",", False)]


def shown_bytes(n: Column) -> Column:
    """B below 1024, else the largest unit up to TB; one decimal below ten unless it is whole."""
    size = F.abs(n.cast("double"))
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        v = size / float(1024**k) * F.when(n < 0, -1.0).otherwise(1.0)
        tenths = F.floor(v * 10 + 0.5)
        short = F.when((v >= 10) | (v % 1 == 0), v.cast("long").cast("string")).otherwise(F.concat((tenths / 10).cast("long").cast("string"), F.lit("."), F.abs(tenths % 10).cast("string")))
        out = F.when(size >= float(1024**k), F.concat(short, F.lit(f" {unit}"))).otherwise(out)
    return out


def shown_time(n: Column) -> Column:
    s = n.cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    text = lambda *x: F.concat(*(v.cast("string") if isinstance(v, Column) else F.lit(v) for v in x))
    return F.when(h > 0, text(h, "h ", m, "m")).when(m > 0, text(m, "m ", r, "s")).otherwise(text(r, "s"))


def as_text(v: Value) -> Column:
    c = v.column
    if v.kind == "list":
        c = F.array_join(F.filter(c, lambda x: F.coalesce(trimmed(x) != "", F.lit(False))), ", ")
    elif v.kind == "bytes":
        c = shown_bytes(c)
    elif v.kind == "number":
        whole = c.cast("double") % 1 == 0
        c = F.when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))
    elif v.kind == "bool":
        c = F.when(c, "true").when(~c, "false")
    return F.coalesce(c, F.lit(""))


def _number(v: Value) -> Column:
    if v.kind in ("number", "bytes"):
        return v.column.cast("double")
    return v.column.try_cast("double") if v.kind == "text" else F.lit(None).cast("double")


def _exists(v: Value) -> Column:
    if v.kind == "list":
        return F.coalesce(F.size(v.column) > 0, F.lit(False))
    if v.kind == "text":
        return F.coalesce(trimmed(v.column) != "", F.lit(False))
    return v.column.isNotNull()


def _truth(v: Value) -> Column:
    if v.kind == "bool":
        return F.coalesce(v.column, F.lit(False))
    if v.kind in ("number", "bytes"):
        return F.coalesce(v.column != 0, F.lit(False))
    return _exists(v)


def _flag(v: Value, wanted: bool) -> Column:
    if v.kind == "bool":
        return F.coalesce(v.column == wanted, F.lit(False))
    return F.coalesce(v.column == str(wanted).lower(), F.lit(False)) if v.kind == "text" else F.lit(False)


def _compared(v: Value, test: Callable[[Column], Column]) -> Column:
    if v.kind == "list":
        return F.coalesce(F.exists(v.column, lambda x: test(F.lower(x))), F.lit(False))
    return test(F.lower(as_text(v)))


def _ordered(compare: Callable[[Column, Column], Column]) -> Callable:
    def test(v: Value, before: Column | None, target: str) -> Column:
        try:
            return F.coalesce(compare(_number(v), F.lit(float(target))), F.lit(False))
        except ValueError:
            return F.lit(False)

    return test


def _contains(v: Value, before: Column | None, target: str) -> Column:
    return _compared(v, lambda x: F.contains(x, F.lit(target.strip().lower())))


#: What each operator of a term makes of its value, of the result so far (null at first) and of what follows its sign.
_TESTS: dict[str, Callable[[Value, Column | None, str], Column]] = {
    "exists": lambda v, before, target: _exists(v),
    "istrue": lambda v, before, target: _flag(v, True) if before is None else before,
    "isfalse": lambda v, before, target: _flag(v, False) if before is None else ~before,
    "~": _contains,
    "~=": _contains,
    "=": lambda v, before, target: _compared(v, lambda x: trimmed(x) == target.strip().lower()),
    ">=": _ordered(Column.__ge__),
    "<=": _ordered(Column.__le__),
    ">": _ordered(Column.__gt__),
    "<": _ordered(Column.__lt__),
}
_OPERATOR = re.compile(r"(exists|istrue|isfalse)\Z|(~=?|=|>=|<=|>|<)(.*)", re.DOTALL)


@dataclass(frozen=True)
class Term:
    """A field and the operators after it; without any it asks for the field's truth."""

    field: str
    operators: tuple[str, ...]

    def compiled(self, v: Value) -> Column:
        out: Column | None = None
        for m in filter(None, map(_OPERATOR.match, self.operators)):
            out = _TESTS[m[1] or m[2]](v, out, m[3] or "")
        return _truth(v) if not self.operators else F.lit(False) if out is None else out


def parsed_condition(text: str, paths: tuple[str, ...]) -> list[list[Term]]:
    """Alternatives of terms that hold together. A path among a term's operators begins the next term."""
    groups: list[list[Term]] = [[]]
    for word, run in groupby(_operators(text), lambda t: t if t in ("and", "or") else ""):
        tokens = list(run)
        if word == "or":
            groups.append([])
        elif not word:
            starts = [0, *(i for i in range(1, len(tokens)) if tokens[i].startswith(paths))]
            groups[-1] += [Term(tokens[i], tuple(tokens[i + 1 : j])) for i, j in zip(starts, [*starts[1:], len(tokens)], strict=True)]
    return [g for g in groups if g]


class Template:
    def __init__(self, values: dict[str, Value], paths: tuple[str, ...] = ("stream.", "service.", "addon.")):
        self.values, self.paths = values, paths

    def _value(self, name: str) -> Value:
        return self.values.get(name, Value(F.lit(None).cast("string")))

    def render(self, template: str) -> Column:
        parts, rest = [], template
        while rest:
            a = rest.find("{")
            end = _scan(rest[a + 1 :], lambda t, i, d: t[i] == "}", False) if a >= 0 else -1
            if end < 0:
                parts.append(F.lit(rest))
                break
            parts += [F.lit(rest[:a]), self._expression(rest[a + 1 : a + 1 + end])]
            rest = rest[a + 2 + end :]
        return F.concat(*parts) if parts else F.lit("")

    def _expression(self, text: str) -> Column:
        at = _scan(text, lambda t, i, d: d == 0 and t[i] == "[")
        if at >= 0 and text.endswith("]"):
            branches = _pieces(text[at + 1 : -1], "||", False)
            then, other = _literal(branches[0]), _literal("||".join(branches[1:])) if len(branches) > 1 else ""
            return F.when(self.condition(text[:at]), self.render(then)).otherwise(self.render(other))
        tokens = _operators(text)
        if not tokens:
            return F.lit("")
        v = self._value(tokens[0])
        for op in tokens[1:]:
            v = self._transform(v, op)
        return as_text(v)

    def _transform(self, v: Value, op: str) -> Value:
        if op in ("lower", "upper"):
            return Value(getattr(F, op)(as_text(v)))
        if op == "title":
            return Value(F.initcap(F.regexp_replace(as_text(v), r"\s+", " ")))
        if op in ("bytes", "time"):
            return Value(F.coalesce((shown_bytes if op == "bytes" else shown_time)(_number(v)), F.lit("")))
        if op.startswith("join("):
            if v.kind != "list":
                return Value(as_text(v))
            args = _arguments(op)
            return Value(F.coalesce(F.array_join(F.filter(v.column, lambda x: F.coalesce(trimmed(x) != "", F.lit(False))), args[0] if args else ", "), F.lit("")))
        if op.startswith("replace("):
            args = _arguments(op)
            return Value(as_text(v) if len(args) < 2 else F.replace(as_text(v), F.lit(args[0]), F.lit(args[1])))
        return v

    def condition(self, text: str) -> Column:
        together = (reduce(Column.__and__, (t.compiled(self._value(t.field)) for t in group)) for group in parsed_condition(text, self.paths))
        return reduce(Column.__or__, together, F.lit(False))
