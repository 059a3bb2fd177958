"""Small predicate languages compiled to Columns.

Two forms are read: JSONPath filters like ``$[?(@.score > 0.3 & @.score <= 0.5)]`` and jq conditions like
``.metadata.task == "x"`` or ``.score < 0.3 or .lang != "en"``. A comparison with a missing or null field is false, and
so is its document's match; ``null_policy="drop"`` makes a number comparison ``<`` or ``<=`` with null true, as jq
orders null below numbers.
"""

from __future__ import annotations

import json
import operator
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE: dict[str, Callable] = {"==": operator.eq, "!=": operator.ne, "<=": operator.le, ">=": operator.ge, "<": operator.lt, ">": operator.gt}
_TOKEN = re.compile(
    r"""\s*(?:(?P<field>[@.][\w.\-]*(?:\["[^"]*"\])*)|(?P<number>-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)|(?P<text>"(?:[^"\\]|\\.)*"|'[^']*')"""
    r"""|(?P<compare>==|!=|<=|>=|<|>)|(?P<join>&&?|\|\|?|\band\b|\bor\b)|(?P<not>!|\bnot\b)|(?P<word>\btrue\b|\bfalse\b|\bnull\b)|(?P<open>\()|(?P<close>\)))"""
)

Field = Callable[[str], Column]


def struct_field(path: str) -> Column:
    """A column, or a field within structs, by dotted path."""
    first, *rest = path.split(".")
    column = F.col(f"`{first}`")
    for name in rest:
        column = column.getField(name)
    return column


def json_field(column: str, kind: str = "double") -> Field:
    """Fields of a JSON text column, read as the given type."""
    return lambda path: F.get_json_object(F.col(column), f"$.{path}").cast(kind)


class _Reader:
    def __init__(self, source: str, field: Field, null_policy: str):
        self.field, self.null_policy, self.at = field, null_policy, 0
        self.items: list[tuple[str, str]] = []
        end = 0
        while source[end:].strip():
            found = _TOKEN.match(source, end)
            if not found or found.end() == end:
                raise ValueError(f"cannot read {source[end:]!r}")
            self.items.append((found.lastgroup or "", found.group(found.lastgroup or 0)))
            end = found.end()

    def peek(self) -> str:
        return self.items[self.at][0] if self.at < len(self.items) else ""

    def take(self) -> str:
        self.at += 1
        return self.items[self.at - 1][1]

    def either(self) -> Column:
        left = self.both()
        while self.peek() == "join" and self.items[self.at][1] in ("|", "||", "or"):
            self.take()
            left = left | self.both()
        return left

    def both(self) -> Column:
        left = self.one()
        while self.peek() == "join" and self.items[self.at][1] in ("&", "&&", "and"):
            self.take()
            left = left & self.one()
        return left

    def one(self) -> Column:
        if self.peek() == "not":
            self.take()
            return ~self.one()
        if self.peek() == "open":
            self.take()
            inner = self.either()
            if self.peek() != "close":
                raise ValueError("missing )")
            self.take()
            return inner
        if self.peek() != "field":
            raise ValueError(f"a field is wanted, not {self.items[self.at :][:1]}")
        path = self.take().lstrip("@.").replace('["', ".").replace('"]', "")
        value = self.field(path)
        if self.peek() != "compare":
            return F.coalesce(value.cast("boolean"), F.lit(False))
        compare = self.take()
        kind, raw = self.items[self.at]
        self.take()
        if raw == "null":
            return value.isNull() if compare == "==" else value.isNotNull()
        literal = float(raw) if kind == "number" else (raw == "true" if kind == "word" else json.loads(raw) if raw[0] == '"' else raw[1:-1])
        met = _COMPARE[compare](value, F.lit(literal))
        below = self.null_policy == "drop" and compare in ("<", "<=") and kind == "number"
        return F.coalesce(met, F.lit(below))


def compiled(predicate: str, field: Field = struct_field, null_policy: str = "keep") -> Column:
    """The condition as a two-valued Column."""
    inner = re.fullmatch(r"\s*\$(?:\[\*\]|\.\.)?\[\?\(?(.*?)\)?\]\s*", predicate, re.DOTALL)
    reader = _Reader(inner[1] if inner else predicate, field, null_policy)
    out = reader.either()
    if reader.at < len(reader.items):
        raise ValueError(f"cannot read from {reader.items[reader.at][1]!r}")
    return out


def first_value(column: Column, path: str | None, default: Column) -> Column:
    """The JSON text's value at the path; default where the path is None or absent, null where it is an explicit null."""
    if path is None:
        return default
    parsed = F.try_parse_json(column)
    there = F.is_variant_null(F.try_variant_get(parsed, path, "variant"))
    return F.when(F.coalesce(there, F.lit(False)), F.lit(None)).otherwise(F.coalesce(F.try_variant_get(parsed, path, "string"), default))
