"""Two filter languages compiled to Columns: a text mini-language and a JSON form."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\()|(\))|(<=|>=|!=|<>|=|<|>)|'((?:[^']|'')*)'|(-?\d+\.\d+(?:[eE][+-]?\d+)?)|(-?\d+)|([A-Za-z_][A-Za-z0-9_.]*))")
_COMPARE = {"=": Column.__eq__, "!=": Column.__ne__, "<>": Column.__ne__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}


def _tokens(text: str) -> list[tuple[str, object]]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at:].strip()[:20]!r} in filter")
        at = m.end()
        kind = m.lastindex
        word = (m[7] or "").upper()
        if kind in (1, 2, 3):
            out.append(("sign", m[kind]))
        elif kind == 4:
            out.append(("value", m[4].replace("''", "'")))
        elif kind in (5, 6):
            out.append(("value", float(m[5]) if kind == 5 else int(m[6])))
        elif word in ("AND", "OR", "NOT"):
            out.append(("sign", word))
        elif word in ("TRUE", "FALSE"):
            out.append(("value", word == "TRUE"))
        else:
            out.append(("name", m[7]))
    return out


def text_filter(text: str, fields: set[str] | None = None) -> Column:
    """Compile ``field op value`` with AND, OR, NOT and parentheses; op is = != <> < <= > >=, a value an integer, a
    float, a quoted string or a boolean. With ``fields``, any other name is an error."""
    tokens, at = _tokens(text), 0

    def peek() -> tuple[str, object]:
        return tokens[at] if at < len(tokens) else ("end", None)

    def take(kind: str, value: object = None) -> object:
        nonlocal at
        found = peek()
        if found[0] != kind or (value is not None and found[1] != value):
            raise ValueError(f"expected {value or kind} in filter, found {found[1]!r}")
        at += 1
        return found[1]

    def either() -> Column:
        out = both()
        while peek() == ("sign", "OR"):
            take("sign")
            out = out | both()
        return out

    def both() -> Column:
        out = single()
        while peek() == ("sign", "AND"):
            take("sign")
            out = out & single()
        return out

    def single() -> Column:
        if peek() == ("sign", "NOT"):
            take("sign")
            return ~single()
        if peek() == ("sign", "("):
            take("sign")
            out = either()
            take("sign", ")")
            return out
        name = take("name")
        if fields is not None and name not in fields:
            raise ValueError(f"unknown field {name!r}")
        op = take("sign")
        if op not in _COMPARE:
            raise ValueError(f"unknown operator {op!r}")
        return _COMPARE[op](F.col(name), F.lit(take("value")))

    out = either()
    if peek()[0] != "end":
        raise ValueError(f"unexpected {peek()[1]!r} in filter")
    return out


_OPERATORS = {
    "$eq": lambda c, v: c == F.lit(v),
    "$ne": lambda c, v: c != F.lit(v),
    "$gt": lambda c, v: c > F.lit(v),
    "$gte": lambda c, v: c >= F.lit(v),
    "$lt": lambda c, v: c < F.lit(v),
    "$lte": lambda c, v: c <= F.lit(v),
    "$in": lambda c, v: c.isin(list(v)),
    "$nin": lambda c, v: ~c.isin(list(v)),
    "$between": lambda c, v: c.between(*v),
}


def json_filter(spec: dict | str) -> Column:
    """Compile {field: value}, {field: {$op: value}}, {$and: [...]} and {$or: [...]}; an empty dict is true."""
    spec = json.loads(spec) if isinstance(spec, str) else spec
    parts = []
    for key, value in spec.items():
        if key in ("$and", "$or"):
            parts.append(reduce(Column.__and__ if key == "$and" else Column.__or__, map(json_filter, value)))
        elif key == "$not":
            parts.append(~json_filter(value))
        elif isinstance(value, dict):
            parts += [_OPERATORS[op](F.col(key), v) for op, v in value.items()]
        else:
            parts.append(F.col(key) == F.lit(value))
    return reduce(Column.__and__, parts) if parts else F.lit(True)
