"""A small statistical expression language, compiled to Columns.

Rules and derived columns are written in a documented subset of R's syntax.
Text is parsed to a tree and the tree compiled to Catalyst expressions; nothing
is ever evaluated as Python.

Statements are separated by new lines or semicolons; the last one is the value.
``x <- e`` names a value, ``x[mask] <- e`` replaces it where the mask is true
(a subscript by the same mask on the right side is taken off), comments begin
with #.  Literals: numbers, strings, TRUE, FALSE, NA, NULL and ``c(...)``.
Operators by falling precedence: ^, unary -, * /, + -, comparisons and %in%, !,
& &&, | ||.  Logic is three-valued, %in% and is.na are never missing, a missing
mask counts as false.  Division by zero is missing.  Aggregates (all, any, mean,
sd, min, max, sum, length) run over the whole table.  Anything else is an error.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import derive, predicates
from ..operators import ranks


class ExpressionError(ValueError):
    """The text is not in the language, or a name in it is unknown."""


_TOKEN = re.compile(r"""(?P<space>[ \t\r]+|\#[^\n]*)|(?P<end>[\n;])|(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?L?|\.\d+)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>(?:[A-Za-z.][A-Za-z0-9._]*::)?[A-Za-z.][A-Za-z0-9._]*)|(?P<op><-|<=|>=|==|!=|&&|\|\||%in%|[-+*/^<>!&|()\[\],={}])""")

#: Left and right binding power of infix operators.
_POWER = {"|": (1, 2), "||": (1, 2), "&": (3, 4), "&&": (3, 4), "==": (7, 8), "!=": (7, 8), "<": (7, 8), "<=": (7, 8), ">": (7, 8), ">=": (7, 8), "+": (9, 10), "-": (9, 10), "*": (11, 12), "/": (11, 12), "%in%": (13, 14), "^": (18, 17)}
_NOT, _MINUS = 5, 15


@dataclass(frozen=True)
class Node:
    kind: str  # num str name const call infix not minus index assign
    value: Any = None
    args: tuple[Any, ...] = field(default=())


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected character {text[at]!r} at {at}")
        at = m.end()
        if m.lastgroup != "space":
            out.append((m.lastgroup or "", m[0]))
    return [*out, ("end", "\n"), ("eof", "")]


class Parser:
    def __init__(self, text: str):
        self.t, self.i, self.depth = tokens(text), 0, 0

    def peek(self) -> tuple[str, str]:
        while self.depth and self.t[self.i] == ("end", "\n"):
            self.i += 1
        return self.t[self.i]

    def next(self) -> tuple[str, str]:
        x = self.peek()
        self.i += 1
        return x

    def expect(self, op: str) -> None:
        if (got := self.next())[1] != op:
            raise ExpressionError(f"expected {op!r}, found {got[1]!r}")

    def program(self) -> list[Node]:
        out = []
        while self.peek()[0] != "eof":
            if self.peek()[0] == "end":
                self.i += 1
                continue
            out.append(self.statement())
            if self.peek()[0] not in ("end", "eof"):
                raise ExpressionError(f"unexpected {self.peek()[1]!r}")
        return out

    def statement(self) -> Node:
        left = self.expr(0)
        if self.peek()[1] in ("<-", "=") and left.kind in ("name", "index"):
            self.next()
            while self.peek() == ("end", "\n"):
                self.i += 1
            return Node("assign", left, (self.expr(0),))
        return left

    def expr(self, least: int) -> Node:
        kind, text = self.next()
        if kind == "num":
            left = Node("num", float(text.rstrip("L")))
        elif kind == "str":
            left = Node("str", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1]))
        elif kind == "name":
            name = text.split("::")[-1]
            const = {"TRUE": True, "FALSE": False, "T": True, "F": False, "NA": None, "NULL": None, "NA_character_": None, "NA_real_": None, "NA_integer_": None}
            left = Node("const", const[name]) if name in const else Node("name", name)
        elif text == "(":
            self.depth += 1
            left = self.expr(0)
            self.expect(")")
            self.depth -= 1
        elif text == "!":
            left = Node("not", None, (self.expr(_NOT),))
        elif text in "-+" and text:
            inner = self.expr(_MINUS)
            left = Node("minus", None, (inner,)) if text == "-" else inner
        else:
            raise ExpressionError(f"unexpected {text!r}")
        while True:
            kind, text = self.peek()
            if text == "(" and left.kind == "name":
                self.next()
                self.depth += 1
                args = []
                while self.peek()[1] != ")":
                    name = None
                    if self.peek()[0] == "name" and self.t[self.i + 1][1] == "=":
                        name = self.next()[1]
                        self.next()
                    args.append((name, self.expr(0)))
                    if self.peek()[1] == ",":
                        self.next()
                self.expect(")")
                self.depth -= 1
                left = Node("call", left.value, tuple(args))
            elif text == "[":
                self.next()
                self.depth += 1
                inner = self.expr(0)
                self.expect("]")
                self.depth -= 1
                left = Node("index", left, (inner,))
            elif kind == "op" and text in _POWER and _POWER[text][0] >= least:
                self.next()
                while self.peek() == ("end", "\n"):
                    self.i += 1
                left = Node("infix", text, (left, self.expr(_POWER[text][1])))
            else:
                return left


def parse(text: str) -> list[Node]:
    return Parser(text).program()


def names(nodes: Iterable[Node]) -> set[str]:
    """Free names: columns that the statements read."""
    local: set[str] = set()
    out: set[str] = set()

    def walk(n: Any) -> None:
        if isinstance(n, tuple) and len(n) == 2 and not isinstance(n, Node):
            walk(n[1])
        elif isinstance(n, Node):
            if n.kind == "name" and n.value not in local:
                out.add(n.value)
            if n.kind == "index":
                walk(n.value)
            for a in n.args:
                walk(a)

    for n in nodes:
        if n.kind == "assign":
            walk(n.args[0])
            target = n.value
            if target.kind == "index":
                walk(target.value)
                walk(target.args[0])
                target = target.value
            local.add(target.value)
        else:
            walk(n)
    return out


@dataclass(frozen=True)
class Vector:
    """Several literals, as c(...) makes them."""

    items: tuple[Any, ...]


def literal(x: Any) -> Any:
    return x.items if isinstance(x, Vector) else (x,)


def _column(x: Any) -> Column:
    if isinstance(x, Vector):
        if len(x.items) != 1:
            raise ExpressionError("a vector stands where one value is needed")
        x = x.items[0]
    return x if isinstance(x, Column) else F.lit(x)


def _bind(name: str, params: list[str], args: tuple[Any, ...]) -> dict[str, Any]:
    """Arguments by exact or unique partial name, the rest by place."""
    out: dict[str, Any] = {}
    rest = []
    for k, v in args:
        if k is None:
            rest.append(v)
            continue
        hit = [p for p in params if p == k] or [p for p in params if p.startswith(k)]
        if len(hit) != 1 or hit[0] in out:
            raise ExpressionError(f"{name}: argument {k!r} is unknown or not unique")
        out[hit[0]] = v
    free = [p for p in params if p not in out]
    if len(rest) > len(free):
        raise ExpressionError(f"{name}: too many arguments")
    return out | dict(zip(free, rest, strict=False))


class Compiler:
    """Compiles statements over the given columns; ``levels`` orders ordinal columns for comparisons."""

    def __init__(self, columns: dict[str, Column], levels: dict[str, list[str]] | None = None):
        self.columns, self.levels = columns, levels or {}
        self.locals: dict[str, Any] = {}
        #: Whether anything but aggregates and literals was read.
        self.rowwise = False
        #: Columns to be added one after the other before the value is computed.
        self.steps: list[tuple[str, Column]] = []

    def run(self, text: str) -> Any:
        out: Any = None
        for n in parse(text):
            out = self.assign(n) if n.kind == "assign" else self.value(n)
        if out is None:
            raise ExpressionError("the expression is empty")
        return out

    def assign(self, n: Node) -> Any:
        target, source = n.value, n.args[0]
        if target.kind == "name":
            self.locals[target.value] = self.value(source)
            return self.locals[target.value]
        mask = self.value(target.args[0])
        if target.value.kind != "name":
            raise ExpressionError("only a name can be subscripted on the left side")
        old = self.value(target.value)
        new = self.value(_strip(source, target.args[0]))
        self.locals[target.value.value] = F.when(F.coalesce(_column(mask), F.lit(False)), _column(new)).otherwise(_column(old))
        return self.locals[target.value.value]

    def value(self, n: Node) -> Any:
        if n.kind in ("num", "str", "const"):
            return n.value
        if n.kind == "name":
            if n.value in self.locals:
                return self.locals[n.value]
            if n.value in self.columns:
                self.rowwise = True
                return self.columns[n.value]
            raise ExpressionError(f"unknown name {n.value!r}")
        if n.kind == "not":
            return ~_column(self.value(n.args[0]))
        if n.kind == "minus":
            x = self.value(n.args[0])
            return -x if isinstance(x, float) else -_column(x)
        if n.kind == "infix":
            return self.infix(n)
        if n.kind == "call":
            return self.call(n)
        raise ExpressionError("a subscript stands only on the left of an assignment, or with its mask on the right")

    def infix(self, n: Node) -> Any:
        op, (l, r) = n.value, n.args
        a, b = self.value(l), self.value(r)
        if op == "%in%":
            return predicates.among(_column(a), list(literal(b)))
        x, y = _column(a), _column(b)
        for side, other in ((l, r), (r, l)):
            if side.kind == "name" and side.value in self.levels and op in ("<", "<=", ">", ">="):
                order = F.array(*[F.lit(v) for v in self.levels[side.value]])
                rank = lambda c, order=order: F.nullif(F.array_position(order, c), F.lit(0))
                x, y = rank(_column(a)), rank(_column(b))
                break
        table: dict[str, Callable[[], Column]] = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x.cast("double"), y.cast("double")), "^": lambda: F.pow(x, y), "==": lambda: x == y, "!=": lambda: x != y, "<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y, "&": lambda: x & y, "&&": lambda: x & y, "|": lambda: x | y, "||": lambda: x | y}
        return table[op]()

    def call(self, n: Node) -> Any:
        name = n.value
        if name in ("c", "list"):
            return Vector(tuple(x for _, a in n.args for x in literal(self.value(a))))
        if name == "rep":  # rep(NA, length(x)): a column of one value
            return _column(self.value(n.args[0][1]))
        aggregates: dict[str, Callable[[Column], Column]] = {"all": F.bool_and, "any": F.bool_or, "mean": F.avg, "sd": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum, "length": lambda c: F.count(F.lit(1))}
        if name in aggregates:
            before = self.rowwise
            x = _column(self.value(n.args[0][1]))
            self.rowwise = before
            return aggregates[name](x).over(W.partitionBy())
        if name == "derive.rank.normal.transform":
            return self.rank_normal({k: self.value(v) for k, v in _bind(name, ["variable", "offset", "stratification.vars"], n.args).items()})
        if name not in CALLS:
            raise ExpressionError(f"unknown function {name!r}")
        params, build = CALLS[name]
        bound = _bind(name, params, n.args)
        return build({k: self.value(v) for k, v in bound.items()})


    def rank_normal(self, a: dict[str, Any]) -> Column:
        """By ranks with stable ties; strata need the first transform as a column of its own."""
        x, offset = _column(a["variable"]), a.get("offset", 0.5)
        strata = [_column(s) for s in literal(a.get("stratification.vars", Vector(())))]
        if strata:
            name = f"__rank{len(self.steps)}_{abs(hash(str(x))) % 10**8}"
            self.steps.append((name, ranks.rank_normal_column(x, offset, strata)))
            x = F.col(name)
        return ranks.rank_normal_column(x, offset)


def _strip(n: Node, mask: Node) -> Node:
    if n.kind == "index" and n.args[0] == mask:
        return n.value
    args = tuple(_strip(a, mask) if isinstance(a, Node) else (a[0], _strip(a[1], mask)) for a in n.args)
    return Node(n.kind, n.value, args)


def _replacement(text: str) -> str:
    return re.sub(r"\\(\d)", r"$\1", text.replace("$", "\\$"))


def _replace_first(c: Column, pattern: str, new: str) -> Column:
    """Replaces the first match; what stands before it is kept as a group in front."""
    shifted = re.sub(r"\\(\d)", lambda m: f"${int(m[1]) + 1}", new.replace("$", "\\$"))
    return F.regexp_replace(c, rf"\A([\s\S]*?)(?:{pattern})", "$1" + shifted)


def _need(a: dict[str, Any], *keys: str) -> list[Column]:
    missing = [k for k in keys if k not in a]
    if missing:
        raise ExpressionError(f"argument {missing[0]!r} is missing")
    return [_column(a[k]) for k in keys]


def _members(a: dict[str, Any], key: str) -> list[Any]:
    return [x for x in literal(a.get(key, Vector(())))]


def _if_else(a: dict[str, Any]) -> Column:
    test, yes, no = _need(a, "test", "yes", "no")
    return F.when(test, yes).when(~test, no)


#: Function to parameter names in order, and what it compiles to.
CALLS: dict[str, tuple[list[str], Callable[[dict[str, Any]], Any]]] = {
    "is.na": (["x"], lambda a: _need(a, "x")[0].isNull()),
    "ifelse": (["test", "yes", "no"], _if_else),
    "abs": (["x"], lambda a: F.abs(_need(a, "x")[0])),
    "sqrt": (["x"], lambda a: F.sqrt(_need(a, "x")[0])),
    "log": (["x"], lambda a: F.ln(_need(a, "x")[0])),
    "exp": (["x"], lambda a: F.exp(_need(a, "x")[0])),
    "round": (["x", "digits"], lambda a: F.round(_need(a, "x")[0], int(a.get("digits", 0)))),
    "tolower": (["x"], lambda a: F.lower(_need(a, "x")[0])),
    "as.numeric": (["x"], lambda a: _need(a, "x")[0].try_cast("double")),
    "as.character": (["x"], lambda a: _need(a, "x")[0].cast("string")),
    "factor": (["x", "levels"], lambda a: F.when(_need(a, "x")[0].isin(*_members(a, "levels")), _need(a, "x")[0]) if "levels" in a else _need(a, "x")[0].cast("string")),
    "str_detect": (["string", "pattern"], lambda a: _need(a, "string")[0].rlike(a["pattern"])),
    "str_replace": (["string", "pattern", "replacement"], lambda a: _replace_first(_need(a, "string")[0], a["pattern"], a["replacement"])),
    "str_replace_all": (["string", "pattern", "replacement"], lambda a: F.regexp_replace(_need(a, "string")[0], a["pattern"], _replacement(a["replacement"]))),
    "derive.first.degree": (["x"], lambda a: derive.first_degree(_need(a, "x")[0])),
    "response.depends.on.yes": (["dependent.variable", "independent.variable", "yes.aliases", "independent.na.aliases", "dependent.na.aliases"], lambda a: predicates.depends_on_yes(*_need(a, "dependent.variable", "independent.variable"), _members(a, "yes.aliases") or ["yes"], _members(a, "independent.na.aliases"), _members(a, "dependent.na.aliases"))),
    "response.depends.on.not.na": (["dependent.variable", "independent.variable", "independent.na.aliases", "dependent.na.aliases"], lambda a: predicates.depends_on_not_na(*_need(a, "dependent.variable", "independent.variable"), _members(a, "independent.na.aliases"), _members(a, "dependent.na.aliases"))),
    "response.is.less.than": (["dependent.variable", "independent.variable"], lambda a: predicates.less_than(*_need(a, "dependent.variable", "independent.variable"))),
    "response.is.greater.than": (["dependent.variable", "independent.variable", "allow.equal"], lambda a: predicates.greater_than(*_need(a, "dependent.variable", "independent.variable"), a.get("allow.equal", True))),
    "response.is.duplicate.of": (["dependent.variable", "independent.variable"], lambda a: predicates.duplicate_of(*_need(a, "dependent.variable", "independent.variable"))),
    "response.is.computed.bmi": (["bmi", "weight", "height", "tolerance"], lambda a: predicates.computed_bmi(*_need(a, "bmi", "weight", "height"), a["tolerance"])),
    "year.is.consistent.with.age": (["reported.year", "reported.age", "reference.year", "acceptable.tolerance"], lambda a: predicates.year_fits_age(*_need(a, "reported.year", "reported.age", "reference.year"), a["acceptable.tolerance"])),
}


@dataclass(frozen=True)
class Compiled:
    """A value; helper columns to add before it; whether it depends on rows, not on aggregates and literals only."""

    value: Column
    steps: tuple[tuple[str, Column], ...]
    rowwise: bool


def compile_text(text: str, columns: dict[str, Column], levels: dict[str, list[str]] | None = None) -> Compiled:
    c = Compiler(columns, levels)
    out = _column(c.run(text))
    return Compiled(out, tuple(c.steps), c.rowwise)
