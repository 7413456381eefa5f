"""The column-filter mini-language.

``col op value``, ``value op col`` and ``lo op col op hi``, joined by ``and``,
``&`` or ``&&``; operators are ``< <= = == >= > !=``. Text is tokenised, so that
a column whose name contains "and" is no separator, and signed numbers are
accepted. Parsed predicates are Catalyst columns: they push down to the scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "=": lambda c, v: c == v,
    "==": lambda c, v: c == v,
    ">=": lambda c, v: c >= v,
    ">": lambda c, v: c > v,
    "!=": lambda c, v: c != v,
}
MIRRORED = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "=", "==": "==", "!=": "!="}

_TOKEN = re.compile(
    r"""\s*(?:(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?![\w.]))|(?P<string>'[^']*'|"[^"]*")|(?P<name>`[^`]+`|[^\W\d][\w.]*)|(?P<op><=|>=|==|!=|<|>|=)|(?P<and>&&?))"""
)


class Predicate(NamedTuple):
    """One comparison of a column; ``operand`` is a float or a string, and ``operator`` a symbol or a function of (columns..., operand)."""

    column: str | tuple[str, ...]
    operator: str | Callable[..., Column]
    operand: Any

    def to_column(self) -> Column:
        if isinstance(self.operator, str):
            return OPERATORS[self.operator](F.col(f"`{self.column}`"), F.lit(self.operand))
        names = (self.column,) if isinstance(self.column, str) else tuple(self.column)
        return self.operator(*[F.col(f"`{n}`") for n in names], self.operand)


def tokens(text: str) -> list[tuple[str, Any]]:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot parse {text!r} from position {at}")
        kind, raw = m.lastgroup, m[m.lastgroup]
        if kind == "name" and raw.lower() == "and":
            kind = "and"
        out.append((kind, {"number": float, "string": lambda s: s[1:-1], "name": lambda s: s.strip("`")}.get(kind, str)(raw)))
        at = m.end()
    return out


def _term(part: list[tuple[str, Any]], text: str) -> list[Predicate]:
    kinds = [k for k, _ in part]
    v = [x for _, x in part]
    literal = {"number", "string"}
    if len(part) == 3 and kinds[1] == "op":
        if kinds[0] == "name" and kinds[2] in literal | {"name"}:
            return [Predicate(v[0], v[1], v[2])]
        if kinds[0] in literal and kinds[2] == "name":
            return [Predicate(v[2], MIRRORED[v[1]], v[0])]
    if len(part) == 5 and kinds[1] == kinds[3] == "op" and kinds[2] == "name" and kinds[0] in literal and kinds[4] in literal:
        return [Predicate(v[2], MIRRORED[v[1]], v[0]), Predicate(v[2], v[3], v[4])]
    raise ValueError(f"cannot parse filter definition {text!r}")


def parse_filter(text: str) -> list[Predicate]:
    """The predicates of one filter string."""
    parts: list[list[tuple[str, Any]]] = [[]]
    for kind, value in tokens(text):
        if kind == "and":
            parts.append([])
        else:
            parts[-1].append((kind, value))
    return [p for part in parts for p in _term(part, text)]


def parse_filters(*definitions: Any) -> list[Predicate]:
    """The predicates of strings, tuples ``(columns, function, operand)`` and nested lists of both."""
    out: list[Predicate] = []
    for d in definitions:
        if isinstance(d, str):
            out += parse_filter(d)
        elif is_filter_tuple(d):
            out.append(Predicate(*d))
        else:
            out += parse_filters(*d)
    return out


def is_filter_tuple(d: Any) -> bool:
    return isinstance(d, Predicate) or (isinstance(d, tuple) and len(d) == 3 and isinstance(d[0], str | tuple) and (callable(d[1]) or d[1] in OPERATORS))


def condition(*definitions: Any) -> Column:
    """All predicates ANDed; true without any."""
    out = F.lit(True)
    for p in parse_filters(*definitions):
        out = out & p.to_column()
    return out


def where(df: DataFrame, *definitions: Any) -> DataFrame:
    return df.where(condition(*definitions))


def sql_where(definitions: Iterable[Any]) -> str:
    """The predicates as the text of a SQL condition, for sources that take a query."""
    parts = []
    for p in parse_filters(*definitions):
        if not isinstance(p.operator, str):
            raise TypeError("functions cannot be written as SQL")
        value = "'" + p.operand.replace("'", "''") + "'" if isinstance(p.operand, str) else repr(p.operand)
        parts.append(f"{p.column} {'=' if p.operator == '==' else p.operator} {value}")
    return " AND ".join(parts)


def sql_query(table: str, columns: list[str] | None = None, *, where: Any = None, order_by: str | list[str] | None = None, descending: bool = False) -> str:
    """SELECT text with a column list, a conjunctive WHERE and ORDER BY."""
    text = f"SELECT {', '.join(columns) if columns else '*'} FROM {table}"
    if where:
        text += f" WHERE {sql_where([where] if isinstance(where, str) or is_filter_tuple(where) else where)}"
    if order_by:
        names = [order_by] if isinstance(order_by, str) else order_by
        text += " ORDER BY " + ", ".join(names) + (" DESC" if descending else "")
    return text
