"""Datalog programs over DataFrames by semi-naive iteration, with set semantics."""

from __future__ import annotations

import re
import tempfile
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ATOM = re.compile(r"(\w+)\s*\(([^()]*)\)")


def _parse(text: str) -> tuple[str, list[str]]:
    m = _ATOM.fullmatch(text.strip())
    if not m:
        raise ValueError(f"expected an atom, found {text!r}")
    return m[1], [x.strip() for x in m[2].split(",")]


def _value(term: str):
    return int(term) if re.fullmatch(r"-?\d+", term) else term.strip("'\"")


def _is_variable(term: str) -> bool:
    return bool(re.fullmatch(r"[A-Z_]\w*|[a-z]", term))


def _bind(df: DataFrame, terms: list[str]) -> DataFrame:
    """Rows as variable bindings: constants filter, repeated variables must agree."""
    df = df.toDF(*[f"_{i}" for i in range(len(terms))])
    first = {}
    for i, t in enumerate(terms):
        if not _is_variable(t):
            df = df.where(F.col(f"_{i}") == F.lit(_value(t)))
        elif t in first:
            df = df.where(F.col(f"_{i}") == F.col(first[t]))
        elif t != "_":
            first[t] = f"_{i}"
    return df.select(*(F.col(c).alias(v) for v, c in first.items()))


def _body(atoms: list[tuple[DataFrame, list[str]]], head: list[str]) -> DataFrame:
    out = None
    for df, terms in atoms:
        rows = _bind(df, terms)
        shared = [] if out is None else [c for c in rows.columns if c in out.columns]
        out = rows if out is None else out.join(rows, shared) if shared else out.join(rows, F.lit(True))
    return out.select(*((F.col(t) if _is_variable(t) else F.lit(_value(t))).alias(f"c{i}") for i, t in enumerate(head)))


def evaluate(rules: list[str], facts: dict[str, DataFrame], rounds: int = 1000) -> dict[str, DataFrame]:
    """All derived relations of rules such as "path(x, z) :- edge(x, y), path(y, z)".

    Variables are single lower-case letters or start upper-case; other words and numbers are constants. Each round
    joins the last round's new rows into every body that uses their relation, and keeps what isn't known yet; an
    empty relation stays empty. Columns are c0, c1, ...
    """
    spark = next(iter(facts.values())).sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
    parsed = []
    for rule in rules:
        head, _, body = rule.rstrip(". ").partition(":-")
        parsed.append((_parse(head), [_parse(m[0]) for m in _ATOM.finditer(body)]))
    derived = {head for (head, _), _ in parsed}
    known: dict[str, DataFrame] = {}
    for (name, head), body in parsed:  # rules over facts alone
        if not any(a in derived for a, _ in body):
            rows = _body([(facts[a], t) for a, t in body], head)
            known[name] = known[name].union(rows) if name in known else rows
    known = {k: v.distinct().checkpoint() for k, v in known.items()}
    new = dict(known)
    for _ in range(rounds):
        found: dict[str, list[DataFrame]] = {}
        for (name, head), body in parsed:
            for i, (a, _) in enumerate(body):
                if a in derived and a in new and all(b in facts or b in known for b, _ in body):
                    atoms = [(new[b] if j == i else known[b] if b in derived else facts[b], t) for j, (b, t) in enumerate(body)]
                    found.setdefault(name, []).append(_body(atoms, head))
        fresh = {}
        for name, parts in found.items():
            rows = reduce(DataFrame.union, parts).distinct()
            rows = (rows.exceptAll(known[name]) if name in known else rows).checkpoint()
            if not rows.isEmpty():
                fresh[name] = rows
        if not fresh:
            break
        for name, rows in fresh.items():
            known[name] = known[name].union(rows).checkpoint() if name in known else rows
        new = fresh
    return known
