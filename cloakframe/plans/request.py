"""A data request: one table, equality filters, aggregates, order and a limit."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from typing import Any

# Bounds, allowed functions and the shapes of the small expressions.
INTENT_LENGTH = (5, 500)
LIMIT_RANGE = (1, 1000)
POLICIES = ("mask", "hash", "deny", "auto")
FUNCTIONS = (
    "COUNT", "SUM", "AVG", "MIN", "MAX", "STDDEV", "VARIANCE", "ARRAY_AGG", "BOOL_AND",
    "BOOL_OR", "EVERY", "APPROX_DISTINCT", "APPROX_PERCENTILE", "ARBITRARY",
)
SQL_PATTERNS = (
    r"\bSELECT\b", r"\bFROM\b", r"\bWHERE\b", r"\bJOIN\b", r"\bINSERT\b", r"\bUPDATE\b",
    r"\bDELETE\b", r"\bDROP\b", r"\bCREATE\b", r"\bALTER\b", r"\bGRANT\b", r"\bREVOKE\b",
    r";\s*$", r"--", r"/\*",
)
DANGEROUS_VALUES = (r";\s*--", r";\s*\w", r"\/\*", r"\*\/", r"xp_", r"EXEC\s", r"EXECUTE\s")
IDENTIFIER = r"[a-zA-Z_][a-zA-Z0-9_]*"

_AGGREGATE = re.compile(
    rf"(?P<func>[A-Z_]+)\s*\(\s*(?P<col>\*|{IDENTIFIER})\s*(?:,\s*(?P<p>0?\.\d+|[01](?:\.0*)?)\s*)?\)"
    rf"(?:\s+AS\s+(?P<alias>{IDENTIFIER}))?",
    re.IGNORECASE,
)
_ORDER = re.compile(
    rf"(?P<col>{IDENTIFIER})(?:\s+(?P<dir>ASC|DESC))?(?:\s+NULLS\s+(?P<nulls>FIRST|LAST))?", re.IGNORECASE
)


class RequestError(ValueError):
    """The request is not acceptable."""


class PolicyDenied(ValueError):
    """The result holds personal data and the policy does not allow it."""


@dataclass(frozen=True)
class Aggregate:
    function: str
    column: str
    alias: str
    percentile: float | None = None


@dataclass(frozen=True)
class SortKey:
    column: str
    descending: bool = False
    nulls: str | None = None


@dataclass(frozen=True)
class Request:
    """What is asked for; ``checked()`` gives the same request if it is acceptable."""

    backend: str
    intent: str
    entity: str | None = None
    filters: dict[str, Any] = field(default_factory=dict)
    aggregations: tuple[str, ...] = ()
    group_by: tuple[str, ...] = ()
    order_by: tuple[str, ...] = ()
    limit: int | None = None
    pii_policy: str = "mask"

    @classmethod
    def from_dict(cls, spec: dict[str, Any]) -> Request:
        unknown = set(spec) - set(cls.__dataclass_fields__)
        if unknown or not {"backend", "intent"} <= set(spec):
            raise RequestError(f"a request needs backend and intent; unknown fields: {sorted(unknown)}")
        lists = {k: tuple(spec[k] or ()) for k in ("aggregations", "group_by", "order_by") if k in spec}
        return cls(**{**spec, **lists, "filters": dict(spec.get("filters") or {})})

    def checked(self, most_rows: int = LIMIT_RANGE[1]) -> Request:
        """``most_rows`` is the largest limit a caller may write; without a limit all rows are meant."""
        low, high = INTENT_LENGTH
        if not low <= len(self.intent) <= high:
            raise RequestError(f"the intent must have {low} to {high} characters")
        for p in SQL_PATTERNS:
            if re.search(p, self.intent, re.IGNORECASE):
                raise RequestError(f"the intent looks like SQL (matches {p}); describe what you need in words")
        low, n = LIMIT_RANGE[0], self.limit
        if n is not None and (isinstance(n, bool) or not isinstance(n, int) or not low <= n <= most_rows):
            raise RequestError(f"the limit must be {low} to {most_rows}")
        if self.pii_policy not in POLICIES:
            raise RequestError(f"unknown policy '{self.pii_policy}', choose one of {POLICIES}")
        for name in (*self.filters, *self.group_by):
            check_identifier(name)
        for value in self.filters.values():
            check_literal(value)
        if self.group_by and not self.aggregations:
            raise RequestError("group_by needs aggregations")
        self.aggregates()
        self.sort_keys()
        return self

    def aggregates(self) -> list[Aggregate]:
        return [parse_aggregate(a) for a in self.aggregations]

    def sort_keys(self) -> list[SortKey]:
        return [parse_sort(o) for o in self.order_by]


def check_identifier(name: str) -> str:
    if not isinstance(name, str) or not re.fullmatch(IDENTIFIER, name):
        raise RequestError(f"'{name}' is not a plain name (letters, digits, underscores)")
    return name


def check_literal(value: Any) -> Any:
    """Filters compare with null, bool, int, float or str; not with NaN or infinity."""
    if value is not None and not isinstance(value, (bool, int, float, str)):
        raise RequestError(f"unsupported filter value type: {type(value).__name__}")
    if isinstance(value, float) and not math.isfinite(value):
        raise RequestError("NaN and infinity are not allowed in filters")
    return value


def parse_aggregate(text: str) -> Aggregate:
    """``FUNC(column | *) [AS alias]``; a percentile may follow the column."""
    m = _AGGREGATE.fullmatch(text.strip())
    if m is None:
        raise RequestError(f"'{text}' is not of the form FUNCTION(column) [AS alias]")
    func, column = m["func"].upper(), m["col"]
    if func not in FUNCTIONS:
        raise RequestError(f"function {func} is not allowed: {', '.join(FUNCTIONS)}")
    if column == "*" and func != "COUNT":
        raise RequestError(f"{func}(*) has no meaning")
    if m["p"] and func != "APPROX_PERCENTILE":
        raise RequestError(f"{func} takes one argument")
    alias = m["alias"] or f"{func.lower()}_{'all' if column == '*' else column}"
    p = float(m["p"] or 0.5) if func == "APPROX_PERCENTILE" else None
    return Aggregate(func, column, alias, p)


def parse_sort(text: str) -> SortKey:
    """``column [ASC|DESC] [NULLS FIRST|LAST]``."""
    m = _ORDER.fullmatch(text.strip())
    if m is None:
        raise RequestError(f"'{text}' is not of the form column [ASC|DESC] [NULLS FIRST|LAST]")
    nulls = m["nulls"].lower() if m["nulls"] else None
    return SortKey(m["col"], (m["dir"] or "").upper() == "DESC", nulls)
