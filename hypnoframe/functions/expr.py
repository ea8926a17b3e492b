"""The expression language, compiled to Column expressions.

Operators by falling precedence: unary ! and -, ^, * / %, + -, comparisons, == != =~,
&&, ||.  Unlike SQL, && and || are null as soon as either side is.  ``/`` always
divides as floating point.  Vectors are arrays; indices start at 1 and 0 is refused.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<str>\"[^\"]*\"|'[^']*')|(?P<name>[A-Za-z_][\w.]*)|(?P<op>&&|\|\||==|=~|!=|<=|>=|[-+*/%^<>!()\[\],=]))")
_LEVEL = {"||": 1, "&&": 2, "==": 3, "=~": 3, "!=": 3, "<": 4, "<=": 4, ">": 4, ">=": 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6, "^": 7}


class ExpressionError(ValueError):
    pass


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            rest = text[at:].lstrip()
            raise ExpressionError("unterminated quote" if rest[:1] in "\"'" else f"unexpected character {rest[:1]!r}")
        kind = m.lastgroup
        if kind == "num" and re.match(r"[\w.]", text[m.end() : m.end() + 1] or " "):
            raise ExpressionError(f"malformed number {m['num'] + text[m.end()]!r}")
        out.append((kind, m[kind]))
        at = m.end()
    return out


def names_in(text: str) -> list[str]:
    """Names that an expression (or ``;``-separated assignments) uses and doesn't assign itself, in order; functions aside."""
    used, own = [], set()
    for part in filter(None, (p.strip() for p in text.split(";"))):
        found = tokens(part)
        target = found[0][1] if len(found) > 2 and found[0][0] == "name" and found[1] == ("op", "=") else None
        for k, (kind, word) in enumerate(found):
            call = k + 1 < len(found) and found[k + 1] == ("op", "(") and word in FUNCTIONS
            if kind == "name" and not call and not (k == 0 and target) and word not in own and word not in used and word.lower() not in ("true", "false"):
                used.append(word)
        own |= {target} if target else set()
    return used


def _vector(c: Column) -> Column:
    return c


def _sd(v: Column) -> Column:
    n = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / (n - 1))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


FUNCTIONS: dict[str, tuple[int, Callable[..., Column]]] = {
    "if": (1, lambda x: x.isNotNull()),
    "ifnot": (1, lambda x: x.isNull()),
    "sqrt": (1, F.sqrt),
    "sqr": (1, lambda x: x * x),
    "pow": (2, F.pow),
    "exp": (1, F.exp),
    "log": (1, F.log),
    "log10": (1, F.log10),
    "abs": (1, F.abs),
    "floor": (1, F.floor),
    "round": (1, F.round),
    "rnd": (0, lambda: F.rand(1)),
    "rand": (1, lambda n: F.floor(F.rand(1) * n)),
    "ifelse": (3, lambda c, t, f: F.when(c, t).when(~c, f)),
    "element": (2, lambda v, i: F.element_at(v, i.cast("int"))),
    "length": (1, F.size),
    "size": (1, F.size),
    "min": (1, F.array_min),
    "max": (1, F.array_max),
    "sum": (1, _sum),
    "mean": (1, lambda v: _sum(v) / F.size(v)),
    "sd": (1, _sd),
    "sort": (1, F.sort_array),
    "any": (1, lambda v: F.exists(v, lambda x: x)),
    "all": (1, lambda v: F.forall(v, lambda x: x)),
    "contains": (2, lambda v, x: F.array_contains(v, x)),
    "countif": (2, lambda v, x: F.size(F.filter(v, lambda y: y == x))),
    "num": (-1, lambda *x: F.array(*(y.cast("double") for y in x))),
    "int": (-1, lambda *x: F.array(*(y.cast("long") for y in x))),
    "txt": (-1, lambda *x: F.array(*(y.cast("string") for y in x))),
    "bool": (-1, lambda *x: F.array(*(y.cast("boolean") for y in x))),
    "c": (-1, lambda *x: F.concat(*x)),
}


def _binary(op: str, a: Column, b: Column) -> Column:
    if op in ("&&", "||"):
        both = (a & b) if op == "&&" else (a | b)
        return F.when(a.isNotNull() & b.isNotNull(), both)
    return {
        "==": lambda: a == b,
        "=~": lambda: F.array_contains(a, b),
        "!=": lambda: a != b,
        "<": lambda: a < b,
        "<=": lambda: a <= b,
        ">": lambda: a > b,
        ">=": lambda: a >= b,
        "+": lambda: a + b,
        "-": lambda: a - b,
        "*": lambda: a * b,
        "/": lambda: F.when(b != 0, a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))),
        "%": lambda: a % F.nullif(b, F.lit(0)),
        "^": lambda: F.pow(a, b),
    }[op]()


class _Parser:
    def __init__(self, text: str, names: Mapping[str, Column]):
        self.left, self.names = tokens(text), names

    def peek(self) -> str | None:
        return self.left[0][1] if self.left and self.left[0][0] == "op" else None

    def take(self, what: str) -> None:
        if self.peek() != what:
            raise ExpressionError(f"missing {what}" + (" bracket" if what in ")]" else ""))
        self.left.pop(0)

    def expression(self, least: int = 1) -> Column:
        a = self.unary()
        while (op := self.peek()) in _LEVEL and _LEVEL[op] >= least:
            self.left.pop(0)
            a = _binary(op, a, self.expression(_LEVEL[op] + 1))
        return a

    def unary(self) -> Column:
        if self.peek() in ("-", "!"):
            op = self.left.pop(0)[1]
            x = self.unary()
            return -x if op == "-" else ~x
        x = self.primary()
        while self.peek() == "[":
            self.left.pop(0)
            if self.left and self.left[0] == ("num", "0"):
                raise ExpressionError("index 0 is out of range: indices start at 1")
            i = self.expression()
            self.take("]")
            x = F.element_at(x, i.cast("int"))
        return x

    def primary(self) -> Column:
        if not self.left:
            raise ExpressionError("missing operand")
        kind, text = self.left.pop(0)
        if kind == "num":
            return F.lit(float(text) if re.search(r"[.eE]", text) else int(text))
        if kind == "str":
            return F.lit(text[1:-1])
        if kind == "op":
            if text == "(":
                x = self.expression()
                self.take(")")
                return x
            raise ExpressionError(f"unexpected {text}")
        if self.peek() == "(":
            if text not in FUNCTIONS:
                raise ExpressionError(f"unknown function {text}")
            self.left.pop(0)
            args = []
            while self.peek() != ")":
                args.append(self.expression())
                if self.peek() != ",":
                    break
                self.left.pop(0)
            self.take(")")
            arity, f = FUNCTIONS[text]
            if arity not in (-1, len(args)):
                raise ExpressionError(f"{text} takes {arity} arguments")
            return f(*args)
        if text in ("true", "T", "false", "F") and text not in self.names:
            return F.lit(text in ("true", "T"))
        if text == "pi" and text not in self.names:
            return F.lit(math.pi)
        if text not in self.names:
            raise ExpressionError(f"undefined operand {text}")
        return self.names[text]


def compiled(text: str, names: Sequence[str] | Mapping[str, Column]) -> Column:
    """Column of an expression over the given names."""
    if not isinstance(names, Mapping):
        names = {n: F.col(f"`{n}`") for n in names}
    p = _Parser(text.replace("\t", " "), names)
    x = p.expression()
    if p.left:
        raise ExpressionError("missing operator before " + p.left[0][1] if p.peek() not in (")", "]") else "missing opening bracket")
    return x


def assignments(text: str, names: Sequence[str]) -> dict[str, Column]:
    """``a = expr ; b = expr``: later expressions see earlier names."""
    have = {n: F.col(f"`{n}`") for n in names}
    out: dict[str, Column] = {}
    for part in filter(None, (p.strip() for p in text.split(";"))):
        m = re.match(r"([A-Za-z_][\w.]*)\s*=(?![=~])(.*)", part, re.S)
        name, body = (m[1], m[2]) if m else ("_value", part)
        out[name] = have[name] = compiled(body, have)
    return out
