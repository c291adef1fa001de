"""Nested function expressions to Columns: and(contains(text,'a'), greater_than(length(text), 10))."""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

_TOKEN = re.compile(r"\s*(?:(?P<name>[A-Za-z_]\w*)|(?P<number>-?\d+(?:\.\d+)?)|(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<sign>[(),]))")


def _number(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


OPERATORS = {
    "concat": lambda *a: F.concat(*a),
    "contains": lambda a, b: F.contains(a, b),
    "content": lambda a: a,
    "count": lambda a: F.size(a),
    "ends_with": lambda a, b: F.endswith(a, b),
    "equals": lambda a, b: a == b,
    "exists": lambda a: a.isNotNull(),
    "greater_than": lambda a, b: a > b,
    "less_than": lambda a, b: a < b,
    "item": lambda a, i: F.get(a, i.cast("int")),
    "length": lambda a: F.length(a),
    "lower": lambda a: F.lower(a),
    "upper": lambda a: F.upper(a),
    "normalize": lambda a: T.normalize_space(a),
    "reg_matches": lambda a, p: F.rlike(a, p),
    "starts_with": lambda a, b: F.startswith(a, b),
    "substring": lambda a, i, n: F.substring(a, i.cast("int"), n.cast("int")),
    "words": lambda a: T.words(a),
    "and": lambda *a: _fold(lambda x, y: x & y, a),
    "or": lambda *a: _fold(lambda x, y: x | y, a),
    "not": lambda a: ~a,
}


def _fold(f, items):
    out = items[0]
    for x in items[1:]:
        out = f(out, x)
    return out


def parse(expression: str, columns: list[str]) -> Column:
    """The Column of an expression over known columns; unknown names raise ValueError."""
    tokens, at = [], 0
    while at < len(expression.rstrip()):
        m = _TOKEN.match(expression, at)
        if not m:
            raise ValueError(f"cannot read {expression[at:]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    pos = 0

    def sign(x: str) -> bool:
        nonlocal pos
        if pos < len(tokens) and tokens[pos] == ("sign", x):
            pos += 1
            return True
        return False

    def term() -> Column:
        nonlocal pos
        if pos >= len(tokens):
            raise ValueError("the expression ends early")
        kind, value = tokens[pos]
        pos += 1
        if kind == "number":
            return F.lit(float(value) if "." in value else int(value))
        if kind == "string":
            return F.lit(re.sub(r"\\(.)", r"\1", value[1:-1]))
        if kind == "name" and sign("("):
            if value not in OPERATORS:
                raise ValueError(f"unknown function {value}")
            args = []
            while not sign(")"):
                args.append(term())
                if not sign(",") and tokens[pos : pos + 1] != [("sign", ")")]:
                    raise ValueError(f"a comma or ) is missing after an argument of {value}")
            return OPERATORS[value](*args)
        if kind == "name" and value in columns:
            return F.col(value)
        raise ValueError(f"unexpected {value!r}")

    out = term()
    if pos != len(tokens):
        raise ValueError(f"unexpected {tokens[pos][1]!r}")
    return out
