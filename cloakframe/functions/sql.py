"""Small helpers for composing SQL expression text.

The functions of this package take and return SQL expressions as text, to be used
with ``F.expr``, ``selectExpr`` or inside SQL.  One large expression then reaches
the JVM in one call and can also be the body of a SQL function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable


def lit(value: str | bool | int | None) -> str:
    """A literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name(column: str) -> str:
    """A column reference, quoted."""
    return "`" + column.replace("`", "``") + "`"


def array(items: Iterable[str], kind: str) -> str:
    """An array of expressions; typed, so that an empty one works too."""
    return f"CAST(array({', '.join(items)}) AS ARRAY<{kind}>)"


def any_of(tests: Iterable[str]) -> str:
    """Disjunction that is never null."""
    return f"coalesce({' OR '.join(f'({t})' for t in tests) or 'false'}, false)"


def let(value: str, variable: str, body: str) -> str:
    """``body`` with ``variable`` bound to ``value``, which is evaluated once."""
    return f"transform(array({value}), {variable} -> {body})[0]"


# Arrays are folded in chunks of this size: an array that grows item by item is copied
# every time, so only short ones may grow.
_CHUNK = 64


def _chunks(items: str) -> str:
    return f"transform(sequence(0, (size({items}) - 1) DIV {_CHUNK}), __i -> slice({items}, __i * {_CHUNK} + 1, {_CHUNK}))"


def running(
    items: str, first: str, whole: Callable[[str, str], str], after: Callable[[str, str], str], make: Callable[[str, str], str], kind: str
) -> str:
    """``make(state, item)`` for every item of a (variable) array, in time linear in its size.

    ``first`` is the state before the first item, ``after(state, item)`` the one behind an
    item, ``whole(state, chunk)`` the one behind a chunk of items (the same, but quickly).
    ``kind`` is the type of what ``make`` gives.
    """
    none = array([], kind)
    # the state before each chunk; what the last chunk does to it isn't needed
    before = (
        f"aggregate(slice(__k, 1, size(__k) - 1), struct({first} AS at, array({first}) AS all), (__t, __s) -> "
        f"struct({whole('__t.at', '__s')} AS at, array_append(__t.all, {whole('__t.at', '__s')}) AS all), __t -> __t.all)"
    )
    inside = (
        f"aggregate(__c, struct(__o AS at, {none} AS out), (__t, __s) -> "
        f"struct({after('__t.at', '__s')} AS at, array_append(__t.out, {make('__t.at', '__s')}) AS out), __t -> __t.out)"
    )
    each = f"flatten(zip_with(__k, {before}, (__c, __o) -> {inside}))"
    return let(_chunks(items), "__k", each)
