"""Typed ranges, their conjunctions and disjunctions, and the SELECT text around them."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Type names of range files, and what they read as.
TYPES = {"SHORT": int, "INT": int, "LONG": int, "DOUBLE": float, "STRING": str, "BOOLEAN": lambda s: s.lower() == "true"}
#: A test that no value passes.
NEVER = "never"
_FLIPPED = {"<": ">=", "<=": ">", ">": "<=", ">=": "<", "=": "!=", "!=": "="}
_TESTS = {
    "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v, "=": lambda c, v: c == v, "!=": lambda c, v: c != v,
    NEVER: lambda c, v: F.lit(False),
}


@dataclass(frozen=True)
class Range:
    """Up to two comparisons of one column; both must hold, and a NULL never does."""

    column: str
    tests: tuple[tuple[str, Any], ...] = ()

    def predicate(self) -> Column:
        made = [_TESTS[op](F.col(self.column), F.lit(v)) for op, v in self.tests]
        return reduce(lambda a, b: a & b, made, F.col(self.column).isNotNull())

    def complement(self) -> list[list[Range]]:
        """The rows whose column has a value outside the range, as a disjunction.  A range without tests holds every value: nothing is outside."""
        if not self.tests:
            return [[Range(self.column, ((NEVER, None),))]]
        if any(op == NEVER for op, _ in self.tests):
            return [[Range(self.column)]]
        return [[Range(self.column, ((_FLIPPED[op], v),))] for op, v in self.tests]


Dnf = Sequence[Sequence[Range]]


def between(column: str, low: Any, high: Any) -> Range:
    return Range(column, ((">=", low), ("<=", high)))


def where(column: str, op: str, value: Any) -> Range:
    return Range(column, (("=" if op == "==" else op, value),))


def predicate(dnf: Dnf) -> Column:
    """OR of ANDs; an empty disjunction holds everywhere."""
    if not dnf:
        return F.lit(True)
    parts = [reduce(lambda a, b: a & b, [r.predicate() for r in conjunct], F.lit(True)) for conjunct in dnf]
    return reduce(lambda a, b: a | b, parts)


def range_query(df: DataFrame, dnf: Dnf, columns: Sequence[str] | None = None, union_all: bool = False) -> DataFrame:
    """Rows that a disjunct fits.  ``union_all`` gives a row once for each disjunct it fits."""
    if union_all and len(dnf) > 1:
        out = reduce(DataFrame.unionAll, [df.filter(predicate([c])) for c in dnf])
    else:
        out = df.filter(predicate(dnf))
    return out.select(*columns) if columns else out


def read_ranges(lines: Sequence[str], names: dict[str, str] | None = None) -> list[Range]:
    """Ranges from tab-separated lines ``column type op value [op value]``; # begins a comment."""
    out = []
    for line in lines:
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        column, kind, *rest = re.split(r"\t+", line)
        read = TYPES[kind.upper()]
        tests = tuple(("=" if rest[i] == "==" else rest[i], read(rest[i + 1])) for i in range(0, len(rest), 2))
        out.append(Range((names or {}).get(column, column), tests))
    return out


@dataclass(frozen=True)
class Select:
    columns: tuple[str, ...]  # empty: all
    table: str
    dnf: tuple[tuple[Range, ...], ...] = ()


_SQL = re.compile(r"\s*('(?:[^']|'')*'|-?\d+(?:\.\d+)?|[A-Za-z_][\w:.]*|<=|>=|!=|<>|==|[<>=,*()])")


def parse_select(text: str) -> Select:
    """``select a, f:b from t [where c >= 1 and d = 'x' or e < 2]``; parentheses group, AND binds before OR."""
    tokens, at = [], 0
    text = text.strip().rstrip(";")
    while at < len(text):
        m = _SQL.match(text, at)
        if not m:
            raise ValueError(f"not understood: {text[at:]!r}")
        tokens.append(m.group(1))
        at = m.end()
    pos = 0

    def peek() -> str:
        return tokens[pos] if pos < len(tokens) else ""

    def take(word: str | None = None) -> str:
        nonlocal pos
        token = peek()
        if not token or (word and token.lower() != word):
            raise ValueError(f"expected {word or 'more'}, found {token or 'the end'}")
        pos += 1
        return token

    take("select")
    columns: list[str] = []
    if peek() == "*":
        take()
    else:
        columns.append(take())
        while peek() == "," or (peek() and peek().lower() != "from"):
            if peek() == ",":
                take()
            columns.append(take())
    take("from")
    table = take()

    def value(token: str) -> Any:
        if token.startswith("'"):
            return token[1:-1].replace("''", "'")
        if token.lower() in ("true", "false"):
            return token.lower() == "true"
        return float(token) if "." in token else int(token)

    def condition() -> list[list[Range]]:
        if peek() == "(":
            take()
            inner = disjunction()
            take(")")
            return inner
        column, op = take(), take()
        op = {"<>": "!=", "==": "="}.get(op, op)
        if op not in _FLIPPED:
            raise ValueError(f"unknown operator {op}")
        return [[Range(column.rpartition(":")[2], ((op, value(take())),))]]

    def conjunction() -> list[list[Range]]:
        out = condition()
        while peek().lower() == "and":
            take()
            more = condition()
            out = [a + b for a in out for b in more]
        return out

    def disjunction() -> list[list[Range]]:
        out = conjunction()
        while peek().lower() == "or":
            take()
            out = out + conjunction()
        return out

    dnf: list[list[Range]] = []
    if peek().lower() == "where":
        take()
        dnf = disjunction()
    if peek():
        raise ValueError(f"unexpected {peek()!r}")
    return Select(tuple(c.rpartition(":")[2] for c in columns), table, tuple(map(tuple, dnf)))


def select(text: str, tables: dict[str, DataFrame], key: str | None = None, start: Any = None, end: Any = None) -> DataFrame:
    """Run a SELECT text; without WHERE a key range can be given, its end inclusive."""
    query = parse_select(text)
    df = tables[query.table]
    if key is not None and start is not None:
        df = df.filter(F.col(key) >= start)
    if key is not None and end is not None:
        df = df.filter(F.col(key) <= end)
    return range_query(df, query.dnf, query.columns or None)
