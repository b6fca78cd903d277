"""Walking a schema: which values of a table hold text, however deep they sit.

A table column becomes one or more ``Field``s: struct members get dotted paths,
list items and map entries count under the list's or map's own path.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import types as T

from cloakframe.functions import sql
from cloakframe.functions.detect import SPAN, has_type, merge_spans, spans, type_tests
from cloakframe.functions.text import INTEGERS, STRINGS, pii_text
from cloakframe.rules import Detection, Rules


@dataclass(frozen=True)
class Scope:
    """Which scalar types are scanned besides strings."""

    numbers: bool = True
    doubles: bool = False

    def covers(self, dtype: T.DataType) -> bool:
        if isinstance(dtype, STRINGS):
            return True
        if isinstance(dtype, INTEGERS + (T.DecimalType,)):
            return self.numbers
        return self.doubles and isinstance(dtype, (T.FloatType, T.DoubleType))


TEXT_ONLY = Scope(numbers=False)


@dataclass(frozen=True)
class Field:
    """A scanned place of a table: dotted path, owning column, value (SQL) and type."""

    path: str
    column: str
    value: str
    dtype: T.DataType

    def holds(self, detection: Detection, scope: Scope) -> str:
        return _holds(self.value, self.dtype, detection, scope, 0)

    def tests(self, rules: Rules, scope: Scope) -> list[tuple[str | None, list[tuple[int, str]]]]:
        """Tests of the detections by number, in groups that share a guard (or none). A null value hits nothing."""
        if isinstance(self.dtype, STRINGS):
            return type_tests(self.value, rules)
        held = [(i, self.holds(d, scope)) for i, d in enumerate(rules.detections)]
        held = [(i, test) for i, test in held if test != "false"]
        return [(None, held)] if held else []

    def holds_any(self, rules: Rules, scope: Scope) -> str:
        return sql.any_of(self.holds(d, scope) for d in rules.detections)

    def spans(self, rules: Rules, scope: Scope) -> str:
        return _spans(self.value, self.dtype, rules, scope, 0)


def fields(schema: T.StructType, scope: Scope = Scope(), columns: list[str] | None = None) -> list[Field]:
    """Scanned places of the given columns (default: all of them)."""
    out: list[Field] = []
    for f in schema.fields:
        if columns is None or f.name in columns:
            out += _expand(f.name, f.name, sql.name(f.name), f.dataType, scope)
    return out


def _expand(path: str, column: str, x: str, dtype: T.DataType, scope: Scope) -> list[Field]:
    if isinstance(dtype, T.StructType):
        return [
            leaf
            for f in dtype.fields
            for leaf in _expand(f"{path}.{f.name}", column, f"{x}.{sql.name(f.name)}", f.dataType, scope)
        ]
    return [Field(path, column, x, dtype)] if scanned(dtype, scope) else []


def scanned(dtype: T.DataType, scope: Scope) -> bool:
    """Is there anything to scan in values of this type?"""
    if isinstance(dtype, T.StructType):
        return any(scanned(f.dataType, scope) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return scanned(dtype.elementType, scope)
    if isinstance(dtype, T.MapType):
        return scanned(dtype.keyType, scope) or scanned(dtype.valueType, scope)
    return scope.covers(dtype)


def _holds(x: str, dtype: T.DataType, d: Detection, scope: Scope, depth: int) -> str:
    """Does the value, or anything inside it, hold the type?  Never null."""
    if not scanned(dtype, scope):
        return "false"
    e = f"__e{depth}"
    if isinstance(dtype, T.StructType):
        return sql.any_of(_holds(f"{x}.{sql.name(f.name)}", f.dataType, d, scope, depth) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return sql.any_of([f"exists({x}, {e} -> {_holds(e, dtype.elementType, d, scope, depth + 1)})"])
    if isinstance(dtype, T.MapType):
        return sql.any_of(
            f"exists({part}({x}), {e} -> {_holds(e, kind, d, scope, depth + 1)})"
            for part, kind in (("map_keys", dtype.keyType), ("map_values", dtype.valueType))
        )
    test = has_type(pii_text(x, dtype), d)
    if isinstance(dtype, INTEGERS):
        if d.smallest_int == float("inf"):
            return "false"
        if d.smallest_int:
            # no abs(): it fails on the least value of the type
            low = int(d.smallest_int)
            return f"(coalesce({x} >= {low}L OR {x} <= -{low}L, false) AND {test})"
    return test


def _spans(x: str, dtype: T.DataType, rules: Rules, scope: Scope, depth: int) -> str:
    if not scanned(dtype, scope):
        return sql.array([], SPAN)
    e = f"__e{depth}"
    if isinstance(dtype, T.StructType):
        return merge_spans(*[_spans(f"{x}.{sql.name(f.name)}", f.dataType, rules, scope, depth) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        return merge_spans(f"flatten(transform({x}, {e} -> {_spans(e, dtype.elementType, rules, scope, depth + 1)}))")
    if isinstance(dtype, T.MapType):
        return merge_spans(
            *[
                f"flatten(transform({part}({x}), {e} -> {_spans(e, kind, rules, scope, depth + 1)}))"
                for part, kind in (("map_keys", dtype.keyType), ("map_values", dtype.valueType))
            ]
        )
    return merge_spans(spans(pii_text(x, dtype), rules))


def map_text(x: str, dtype: T.DataType, change: Callable[[str], str], depth: int = 0) -> str:
    """Apply a text function to every string inside a value, keeping its type.

    Map keys stay as they are: changing them could make two keys equal.
    """
    if isinstance(dtype, STRINGS):
        return change(x)
    if not scanned(dtype, TEXT_ONLY):
        return x
    e = f"__e{depth}"
    if isinstance(dtype, T.StructType):
        inner = ", ".join(
            f"{sql.lit(f.name)}, {map_text(f'{x}.{sql.name(f.name)}', f.dataType, change, depth)}" for f in dtype.fields
        )
        return f"IF({x} IS NULL, NULL, named_struct({inner}))"
    if isinstance(dtype, T.ArrayType):
        return f"transform({x}, {e} -> {map_text(e, dtype.elementType, change, depth + 1)})"
    if isinstance(dtype, T.MapType):
        return f"transform_values({x}, (__k{depth}, {e}) -> {map_text(e, dtype.valueType, change, depth + 1)})"
    return x
