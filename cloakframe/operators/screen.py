"""Screening tables of requests: the checks on one request, as expressions.

A request table has ``backend, intent, entity, filters map<string,string>,
aggregations, group_by, order_by array<string>, limit, pii_policy``; functions
need only the columns they read.  All of it is row-local.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from cloakframe.functions.detect import FOUND, found
from cloakframe.functions.mask import redact
from cloakframe.functions.regex import java_pattern
from cloakframe.functions.sql import any_of, array, let, lit, name
from cloakframe.functions.tokens import resolve_salt, token
from cloakframe.plans.request import (
    DANGEROUS_VALUES,
    FUNCTIONS,
    IDENTIFIER,
    INTENT_LENGTH,
    LIMIT_RANGE,
    POLICIES,
    SQL_PATTERNS,
)
from cloakframe.rules import DEFAULT_RULES, Rules
from cloakframe.sources.profiles import backends, get_profile


def sql_pattern(x: str) -> str:
    """The first SQL pattern the intent matches; null when it is clean.

    One scan for any keyword or mark at all decides about most intents.
    """
    marks = "|".join(p.replace(r"\b", "").removesuffix(r"\s*$") for p in SQL_PATTERNS)
    whens = " ".join(f"WHEN {x} RLIKE {lit(java_pattern(p))} THEN {lit(p)}" for p in SQL_PATTERNS)
    return f"CASE WHEN NOT {x} RLIKE {lit(java_pattern(marks))} THEN NULL {whens} END"


def intent_length_ok(x: str) -> str:
    low, high = INTENT_LENGTH
    return f"coalesce(char_length({x}) BETWEEN {low} AND {high}, false)"


def limit_ok(x: str) -> str:
    """Within the bounds; without a limit all rows are meant."""
    low, high = LIMIT_RANGE
    return f"({x} IS NULL OR {x} BETWEEN {low} AND {high})"


# One aggregate and one sort key, as ``parse_aggregate`` and ``parse_sort`` accept them.
_ALIAS = rf"(?:\s+AS\s+{IDENTIFIER})?"
_PLAIN = "|".join(f for f in FUNCTIONS if f not in ("COUNT", "APPROX_PERCENTILE"))
_AGGREGATE = (
    rf"^\s*(?:COUNT\s*\(\s*(?:\*|{IDENTIFIER})\s*\)|(?:{_PLAIN})\s*\(\s*{IDENTIFIER}\s*\)"
    rf"|APPROX_PERCENTILE\s*\(\s*{IDENTIFIER}\s*(?:,\s*(?:0?\.\d+|[01](?:\.0*)?)\s*)?\)){_ALIAS}\s*\Z"
)
_SORT_KEY = rf"^\s*{IDENTIFIER}(?:\s+(?:ASC|DESC))?(?:\s+NULLS\s+(?:FIRST|LAST))?\s*\Z"


def all_match(x: str, pattern: str) -> str:
    """Every item of an array matches (null and empty pass)."""
    return f"coalesce(forall({x}, __n -> coalesce(__n RLIKE {lit(java_pattern(pattern))}, false)), true)"


def aggregations_ok(x: str) -> str:
    return all_match(x, _AGGREGATE)


def sort_keys_ok(x: str) -> str:
    return all_match(x, _SORT_KEY)


def policy_ok(x: str) -> str:
    return f"coalesce(array_contains({array([lit(p) for p in POLICIES], 'STRING')}, {x}), false)"


def identifier_ok(x: str) -> str:
    return f"coalesce({x} RLIKE {lit(f'^{IDENTIFIER}' + chr(92) + 'z')}, false)"


def names_ok(x: str) -> str:
    """Every name of an array is a plain identifier (null and empty pass)."""
    return f"coalesce(forall({x}, __n -> {identifier_ok('__n')}), true)"


def dangerous_value(x: str) -> str:
    """Does a string literal contain one of the injection patterns?"""
    hits = any_of(f"{x} RLIKE {lit(java_pattern(p))}" for p in DANGEROUS_VALUES)
    # every pattern needs one of these pieces
    return f"(coalesce({x} RLIKE {lit(java_pattern(r';|[*]|xp_|EXEC'))}, false) AND {hits})"


def route(backend: str, intent: str, entity: str = "NULL") -> str:
    """The table a request reads: its entity, else the backend's first keyword in the intent."""
    per_backend = []
    for b in backends():
        keywords = get_profile(b).keywords
        if keywords:
            whens = " ".join(f"WHEN contains(lower({intent}), {lit(k)}) THEN {lit(t)}" for k, t in keywords.items())
            per_backend.append(f"WHEN {lit(b)} THEN CASE {whens} END")
    return f"coalesce({entity}, CASE lower({backend}) {' '.join(per_backend)} END)"


def table_allowed(backend: str, table: str) -> str:
    """Is the table on the backend's allow-list (backends without one allow all)?"""
    whens = []
    for b in backends():
        names = get_profile(b).allowed_tables
        if names is not None:
            listed = array([lit(n) for n in sorted(names)], "STRING")
            whens.append(f"WHEN {lit(b)} THEN array_contains({listed}, lower({table}))")
    return f"coalesce(CASE lower({backend}) {' '.join(whens)} ELSE true END, false)"


def screen_intents(df: DataFrame, intent: str = "intent") -> DataFrame:
    """Add ``sql_pattern, length_ok, accepted`` for a column of intents."""
    checked = df.selectExpr("*", f"{sql_pattern(intent)} AS sql_pattern", f"{intent_length_ok(intent)} AS length_ok")
    return checked.selectExpr("*", "sql_pattern IS NULL AND length_ok AS accepted")


def screen_requests(df: DataFrame) -> DataFrame:
    """Add routing, every check, and the first ``reject_reason`` of each request.

    A request without a reason is one that ``Request.checked`` accepts, for a known
    backend and an allowed table.  Columns that the table lacks count as null.
    """
    for column, kind in (("aggregations", "array<string>"), ("order_by", "array<string>")):
        if column not in df.columns:
            df = df.selectExpr("*", f"CAST(NULL AS {kind}) AS {column}")
    known = array([lit(b) for b in backends() if get_profile(b).kind == "table"], "STRING")
    checked = df.selectExpr(
        "*",
        f"{sql_pattern('intent')} AS sql_pattern",
        f"{route('backend', 'intent', 'entity')} AS routed_table",
        f"map_keys(map_filter(filters, (__k, __v) -> {dangerous_value('__v')})) AS dangerous_filters",
    )
    reasons = {
        "unknown backend": f"NOT coalesce(array_contains({known}, lower(backend)), false)",
        "intent length": f"NOT {intent_length_ok('intent')}",
        "sql in intent": "sql_pattern IS NOT NULL",
        "limit out of range": f"NOT {limit_ok('`limit`')}",
        "policy": f"NOT {policy_ok('pii_policy')}",
        "filter key": f"NOT {names_ok('map_keys(filters)')}",
        "group by column": f"NOT {names_ok('group_by')}",
        "group by without aggregation": "size(coalesce(group_by, array())) > 0 AND size(coalesce(aggregations, array())) = 0",
        "aggregation": f"NOT {aggregations_ok('aggregations')}",
        "order by": f"NOT {sort_keys_ok('order_by')}",
        "no table": "routed_table IS NULL",
        "table name": f"NOT {identifier_ok('routed_table')}",
        "table not allowed": f"NOT {table_allowed('backend', 'routed_table')}",
    }
    whens = " ".join(f"WHEN {test} THEN {lit(why)}" for why, test in reasons.items())
    return checked.selectExpr("*", f"CASE {whens} END AS reject_reason")


def scan_filters(df: DataFrame, salt: str, filters: str = "filters", rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Add ``pii_filters`` (keys whose values hold personal data), ``safe_filters``
    (those values as tokens) and ``logged_filters`` (values masked, for logs).

    Each value is searched once; the three forms come from what was found in it.
    """
    salt = resolve_salt(salt)
    forms = (
        f"struct(size(__f) > 0 AS hit, IF(size(__f) > 0, {token('__v', salt)}, __v) AS safe, "
        f"{redact('__v', rules, hits='__f')} AS logged)"
    )
    hits = f"coalesce({found('__v', rules)}, {array([], FOUND)})"
    scanned = f"transform_values({filters}, (__k, __v) -> {let(hits, '__f', forms)})"
    return df.selectExpr("*", f"{scanned} AS __forms").selectExpr(
        *[name(c) for c in df.columns],
        "array_sort(map_keys(map_filter(__forms, (__k, __v) -> __v.hit))) AS pii_filters",
        "transform_values(__forms, (__k, __v) -> __v.safe) AS safe_filters",
        "transform_values(__forms, (__k, __v) -> __v.logged) AS logged_filters",
    )
