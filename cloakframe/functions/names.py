"""Labelling column names, as SQL expressions over a table of names."""

from __future__ import annotations

from cloakframe.functions.regex import java_pattern
from cloakframe.functions.sql import array, lit
from cloakframe.rules import CATEGORY_KEYWORDS, CRITICAL_KEYWORDS, DEFAULT_RULES, HIGH_KEYWORDS, SENSITIVITY_RANK, Rules


def _strings(items: tuple[str, ...]) -> str:
    return array([lit(i) for i in items], "STRING")


def _holds_any(x: str, keywords: tuple[str, ...]) -> str:
    return f"exists({_strings(keywords)}, __k -> contains({x}, __k))"


def match_reason(x: str, rules: Rules = DEFAULT_RULES, backend: str | None = None) -> str:
    """Why a name counts as personal data; null when it does not.

    The rules are part of the expression, so labelling needs no join.  The first
    rule in order wins.  ``backend`` is an expression too.
    """
    low, n = f"lower({x})", rules.names
    reasons = [
        f"IF(array_contains({_strings(n.exact)}, {low}), 'exact_match', NULL)",
        f"concat('contains_pattern:', get(filter({_strings(n.contains)}, __k -> contains({low}, __k)), 0))",
    ]
    reasons += [f"IF({low} RLIKE {lit(java_pattern(p))}, {lit('regex_pattern:' + p)}, NULL)" for p in n.patterns]
    for b, names in n.backends.items():
        if backend is not None and names:
            hit = f"{backend} = {lit(b)} AND array_contains({_strings(names)}, {low})"
            reasons.append(f"IF({hit}, {lit('backend_override:' + b)}, NULL)")
    return f"coalesce({', '.join(reasons)})"


def name_sensitivity(x: str, reason: str) -> str:
    low = f"lower({x})"
    worded = f"(startswith({reason}, 'exact_match') OR startswith({reason}, 'contains_pattern:'))"
    return f"""CASE WHEN {reason} IS NULL THEN 'none'
        WHEN {worded} AND {_holds_any(low, CRITICAL_KEYWORDS)} THEN 'critical'
        WHEN {worded} AND {_holds_any(low, HIGH_KEYWORDS)} THEN 'high' ELSE 'medium' END"""


def name_category(x: str, reason: str) -> str:
    low = f"lower({x})"
    whens = " ".join(f"WHEN {_holds_any(low, keys)} THEN {lit(c)}" for c, keys in CATEGORY_KEYWORDS.items())
    return f"""CASE WHEN {reason} IS NULL THEN NULL WHEN startswith({reason}, 'regex_pattern:') THEN 'inferred'
        WHEN startswith({reason}, 'backend_override:') THEN 'backend_specific' {whens} ELSE 'unknown' END"""


def sensitivity_rank(level: str) -> str:
    """none 0 … critical 4."""
    whens = " ".join(f"WHEN {lit(k)} THEN {v}" for k, v in SENSITIVITY_RANK.items())
    return f"CASE {level} {whens} END"
