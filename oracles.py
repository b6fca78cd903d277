"""SQL twins of the registered queries, for checking results with another engine.

Written independently of the package: only the patterns, word lists and mask
formats are shared, because they define the results.
"""

from __future__ import annotations

import hashlib

from cloakframe.rules import EXACT_NAMES, NAME_FRAGMENTS, NAME_PATTERNS, PATTERNS

TYPES = list(PATTERNS)
# Sensitivity and default action of the types.
SENSITIVITY = {
    "email": "high",
    "phone": "high",
    "phone_international": "high",
    "ssn": "critical",
    "iban": "critical",
    "credit_card": "critical",
    "ip_address": "medium",
    "date_of_birth": "high",
}
ACTION = {
    "email": "mask",
    "phone": "mask",
    "phone_international": "mask",
    "ssn": "deny",
    "iban": "hash",
    "credit_card": "deny",
    "ip_address": "hash",
    "date_of_birth": "mask",
}
INTS = ("int", "bigint")
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
COLUMNS = {t: [tuple(c.split(" ")) for c in spec.split(", ")] for t, spec in SCHEMAS.items()}


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def pattern(kind: str) -> str:
    return lit("(?i)" + PATTERNS[kind])


def hit(x: str, kind: str) -> str:
    return f"coalesce(regexp_matches({x}, {pattern(kind)}), false)"


def any_hit(x: str) -> str:
    return "(" + " OR ".join(hit(x, t) for t in TYPES) + ")"


def types_text(x: str) -> str:
    """Sorted type names found in a text, comma-separated."""
    found = ", ".join(f"CASE WHEN {hit(x, t)} THEN {lit(t)} END" for t in sorted(TYPES))
    return f"concat_ws(',', {found})"


def mask(v: str, kind: str) -> str:
    stars = f"repeat('*', length({v}))"
    if kind == "email":
        return f"substring({v}, 1, 2) || '***@***.***'"
    if kind in ("phone", "credit_card"):
        return f"CASE WHEN length({v}) <= 4 THEN {stars} ELSE repeat('*', length({v}) - 4) || right({v}, 4) END"
    if kind == "iban":
        shown = f"substring({v}, 1, 4) || repeat('*', length({v}) - 8) || right({v}, 4)"
        return f"CASE WHEN length({v}) <= 8 THEN {stars} ELSE {shown} END"
    fixed = {"ssn": "***-**-****", "ip_address": "***.***.***.***", "date_of_birth": "**/**/****"}
    return lit(fixed[kind]) if kind in fixed else stars


def spans_sql(source: str, keys: str, x: str) -> str:
    """Rows ``keys, ord, kind, v, st`` (0-based) of everything found in ``source.x``."""
    parts = []
    for i, t in enumerate(TYPES):
        parts.append(
            f"""SELECT {keys}, {i} AS ord, {lit(t)} AS kind, hits[j] AS v,
       CAST(coalesce(list_sum(list_transform(gaps[1:j], lambda g: length(g))), 0)
          + coalesce(list_sum(list_transform(hits[1:j-1], lambda h: length(h))), 0) AS INTEGER) AS st
FROM (SELECT {keys}, hits, gaps, unnest(range(1, len(hits) + 1)) AS j
      FROM (SELECT {keys}, regexp_extract_all({x}, {pattern(t)}) AS hits, string_split_regex({x}, {pattern(t)}) AS gaps
            FROM {source} WHERE regexp_matches({x}, {pattern(t)})))"""
        )
    return "\nUNION ALL\n".join(parts)


def redact_ctes(source: str, keys: str, x: str, name: str = "red") -> str:
    """CTEs ending in ``<name>(keys, clean)``: the texts that change, changed."""
    masks = " ".join(f"WHEN {i} THEN {mask('v', t)}" for i, t in enumerate(TYPES))
    first = keys.split(", ")
    on = " AND ".join(f"s.{k} = p.{k}" for k in first)
    return f"""{name}_s AS ({spans_sql(source, keys, x)}),
{name}_p AS (SELECT {keys}, list(struct_pack(st := st, en := CAST(st + length(v) AS INTEGER), t := CASE ord {masks} END)
                  ORDER BY st DESC, ord) AS found FROM {name}_s GROUP BY {keys}),
{name} AS (SELECT {', '.join('s.' + k for k in first)}, list_reduce(
    list_prepend(struct_pack(st := 0, en := 0, t := s.{x}), found),
    lambda acc, f: struct_pack(st := 0, en := 0,
        t := substring(acc.t, 1, f.st) || f.t || substring(acc.t, f.en + 1))).t AS clean
  FROM {source} s JOIN {name}_p p ON {on})"""


def redact_query(source: str, keys: str, x: str, select: str, ctes: str = "") -> str:
    """``select`` may use ``b`` (the source) and ``clean`` (the redacted text)."""
    on = " AND ".join(f"b.{k} = r.{k}" for k in keys.split(", "))
    return f"""WITH {ctes}{redact_ctes(source, keys, x)}
SELECT {select.replace('clean', f'coalesce(r.clean, b.{x})')} FROM {source} b LEFT JOIN red r ON {on}"""


def _pads(salt: str) -> tuple[str, str]:
    key = salt.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def digest(x: str, salt: str, n_bytes: int) -> str:
    inner, outer = _pads(salt)
    return (
        f"upper(left(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({x})))), {2 * n_bytes}))"
    )


def token(x: str, salt: str) -> str:
    return f"coalesce('HASH_' || {digest(x, salt, 16)}, 'HASH_NULL')"


def lookup(x: str, context: str, salt: str) -> str:
    return f"'{context.upper()}_HASH_' || {digest(x, context + ':' + salt, 12)}"


def profile_sql(tables: list[str]) -> str:
    """``tbl, path, pii_type, n_rows, rows_scanned`` like the profile of those tables."""
    parts = []
    for t in tables:
        for c, kind in COLUMNS[t]:
            if kind == "string" or kind in INTS:
                for p in TYPES:
                    parts.append(
                        f"SELECT {lit(t)} AS tbl, {lit(c)} AS path, {lit(p)} AS pii_type, "
                        f"count(*) FILTER (WHERE {hit(f'CAST({c} AS VARCHAR)', p)}) AS n_rows, "
                        f"count(*) AS rows_scanned FROM {t}"
                    )
            else:
                parts.append(
                    f"SELECT {lit(t)} AS tbl, {lit(c)} AS path, CAST(NULL AS VARCHAR) AS pii_type, "
                    f"CAST(0 AS BIGINT) AS n_rows, count(*) AS rows_scanned FROM {t}"
                )
    return "\nUNION ALL\n".join(parts)


def name_reason(c: str) -> str:
    """Why a column name counts as personal data (SQL over a name)."""
    low = f"lower({c})"
    whens = [f"WHEN {low} IN ({', '.join(lit(n) for n in EXACT_NAMES)}) THEN 'exact_match'"]
    whens += [f"WHEN contains({low}, {lit(f)}) THEN {lit('contains_pattern:' + f)}" for f in NAME_FRAGMENTS]
    whens += [f"WHEN regexp_matches({low}, {lit(p)}) THEN {lit('regex_pattern:' + p)}" for p in NAME_PATTERNS]
    return f"CASE {' '.join(whens)} END"


def catalog_values() -> str:
    rows = [
        f"({lit(t)}, {lit(c)}, {lit(kind)}, {i})" for t, cols in COLUMNS.items() for i, (c, kind) in enumerate(cols)
    ]
    return f"(VALUES {', '.join(rows)}) AS names(tbl, column_name, data_type, position)"


def decisions_sql(tables: list[str], policy: str, levels: bool) -> str:
    """``tbl, col, is_named, types, sensitivity, action`` per column with personal data."""
    rank = {"none": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
    act = {"mask": 1, "hash": 2, "deny": 3}
    floor = {0: 1, 1: 1, 2: 1, 3: 2, 4: 3}
    by_type = " ".join(f"WHEN {lit(t)} THEN {rank[SENSITIVITY[t]]}" for t in TYPES)
    act_type = " ".join(f"WHEN {lit(t)} THEN {act[ACTION[t]]}" for t in TYPES)
    chosen = "found_act" if policy == "auto" else str(act[policy])
    if levels:
        floors = " ".join(f"WHEN {k} THEN {v}" for k, v in floor.items())
        chosen = f"greatest({chosen}, CASE lvl {floors} END)"
    names = " ".join(f"WHEN {v} THEN {lit(k)}" for k, v in rank.items())
    acts = " ".join(f"WHEN {v} THEN {lit(k)}" for k, v in act.items())
    # every column of these tables that is named personal data is so by the medium name rule
    return f"""WITH prof AS ({profile_sql(tables)}),
per AS (SELECT tbl, path AS col,
   coalesce(string_agg(pii_type, ',' ORDER BY pii_type) FILTER (WHERE n_rows > 0), '') AS types,
   coalesce(max(CASE pii_type {by_type} END) FILTER (WHERE n_rows > 0), 0) AS found_lvl,
   coalesce(max(CASE pii_type {act_type} END) FILTER (WHERE n_rows > 0), 1) AS found_act,
   {name_reason('path')} IS NOT NULL AS is_named
 FROM prof WHERE rows_scanned > 0 GROUP BY tbl, path),
lev AS (SELECT *, greatest(found_lvl, CASE WHEN is_named THEN 2 ELSE 0 END) AS lvl FROM per
 WHERE is_named OR types <> '')
SELECT tbl, col, is_named, types, CASE lvl {names} END AS sensitivity, CASE {chosen} {acts} END AS action FROM lev"""
