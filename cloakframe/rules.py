"""Rules: what counts as personal data, how it is masked, how strict to be.

Everything here is plain driver-side data.  The operators turn a ``Rules``
object into Catalyst expressions; nothing in this module touches rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace
from typing import Any

from cloakframe.functions.regex import java_pattern

SENSITIVITY_RANK = {"none": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
POLICY_RANK = {"mask": 1, "hash": 2, "deny": 3}


@dataclass(frozen=True)
class Detection:
    """One kind of personal data, found by a pattern in a value.

    ``pattern`` is in Python ``re`` syntax, matched ignoring case.  ``java`` is an
    equivalent hand-tuned form for the JVM; when absent it is derived.
    ``needs`` is a cheap necessary condition (a literal, or a JVM regex when it
    starts with ``re:``) tested before the pattern.  ``smallest_int`` is the
    least absolute integer whose digits can match (``inf``: none can).
    """

    name: str
    pattern: str
    sensitivity: str = "medium"
    default_action: str = "mask"
    description: str = ""
    java: str | None = None
    needs: str | None = None
    smallest_int: float = 0

    @property
    def java_regex(self) -> str:
        return self.java or java_pattern(self.pattern)


@dataclass(frozen=True)
class Mask:
    """How a found value is masked: template, else fixed length, else kept ends."""

    keep_start: int = 0
    keep_end: int = 0
    char: str = "*"
    fixed_length: int | None = None
    template: str | None = None


@dataclass(frozen=True)
class NameLabel:
    """Label of one column name."""

    column_name: str
    is_pii: bool
    sensitivity: str = "none"
    category: str | None = None
    match_reason: str | None = None


@dataclass(frozen=True)
class NameRules:
    """Column-name rules, tried in the order exact, contains, pattern, backend."""

    exact: tuple[str, ...] = ()
    contains: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    backends: dict[str, tuple[str, ...]] = field(default_factory=dict)


# ---------------------------------------------------------------------------
# Fixed values.  Patterns, names, keywords and mask formats below define the
# results and are therefore stated as they must be.
# ---------------------------------------------------------------------------
PATTERNS = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone": r"(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}",
    "phone_international": r"\+[1-9]\d{1,14}",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "iban": r"[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}[A-Z0-9]{0,16}",
    "credit_card": r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b",
    "ip_address": r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b",
    "date_of_birth": r"\b(?:0[1-9]|1[0-2])[-/](?:0[1-9]|[12][0-9]|3[01])[-/](?:19|20)\d{2}\b",
}
EXACT_NAMES = (
    "email", "email_address", "phone", "phone_number", "mobile", "cell", "ssn",
    "social_security", "social_security_number", "iban", "bank_account",
    "credit_card", "cc_number", "card_number", "password", "passwd", "secret",
    "api_key", "access_token", "refresh_token", "dob", "date_of_birth",
    "birthdate", "birth_date",
)
NAME_FRAGMENTS = (
    "_email", "_phone", "_ssn", "_iban", "_password", "_secret", "_token",
    "first_name", "last_name", "full_name", "customer_name", "user_name",
    "address", "street", "city", "zip", "postal", "country",
)
NAME_PATTERNS = (
    r"name_?(?:first|last|full)?",
    r"(?:home|work|cell|mobile)_?(?:phone|tel)",
    r"addr(?:ess)?_?(?:line)?_?\d?",
)
BACKEND_NAMES = {"snowflake": ("variant_data",)}
CRITICAL_KEYWORDS = ("ssn", "social_security", "password", "credit_card", "iban")
HIGH_KEYWORDS = ("email", "phone", "dob", "date_of_birth", "address")
CATEGORY_KEYWORDS = {
    "contact": ("email", "phone", "mobile", "cell"),
    "identity": ("ssn", "social_security", "passport", "license"),
    "financial": ("credit_card", "iban", "bank", "account"),
    "personal": ("name", "dob", "birth", "age"),
    "location": ("address", "street", "city", "zip", "postal"),
    "credentials": ("password", "secret", "token", "key"),
}
ALLOWED_BY_LEVEL = {
    "critical": ("deny",),
    "high": ("deny", "hash"),
    "medium": ("deny", "hash", "mask"),
    "low": ("deny", "hash", "mask"),
}
MASKS = {
    "email": Mask(keep_start=2, template="{start}***@***.***"),
    "phone": Mask(keep_end=4),
    "ssn": Mask(fixed_length=11, template="***-**-****"),
    "iban": Mask(keep_start=4, keep_end=4),
    "credit_card": Mask(keep_end=4),
    "ip_address": Mask(fixed_length=11, template="***.***.***.***"),
    "date_of_birth": Mask(fixed_length=10, template="**/**/****"),
}
# ---------------------------------------------------------------------------

# Ignoring case, an ASCII letter range also takes in these four letters.
_FOLD = "İıſK"
# A word boundary before (after) a digit: no word character on the other side.
_OPEN = r"(?<![\p{L}\p{N}_])"
_SHUT = r"(?![\p{L}\p{N}_])"
_LOCAL = rf"a-zA-Z0-9._%+\-{_FOLD}"
_FOUR_DIGITS = r"re:\p{Nd}{4}"

# JVM forms of PATTERNS.  Where letters occur their case folding is spelt out, so
# that no case-insensitive flag is needed (it makes every digit class slow); a
# look-ahead on the first character stands before the boundary test.  The e-mail
# form starts a run only at its beginning (or right after the last match), which
# makes a long run without "@" linear instead of quadratic.
_JAVA = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[a-zA-Z0-9.\-{_FOLD}]+\.[a-zA-Z{_FOLD}]{{2,}}",
    "phone": r"(?=[+(0-9])(?:\+?1[-.{s}]?)?\(?[0-9]{3}\)?[-.{s}]?[0-9]{3}[-.{s}]?[0-9]{4}".replace(
        "{s}", r"\s\p{Z}\x1c-\x1f\x85"
    ),
    "phone_international": r"\+[1-9]\p{Nd}{1,14}",
    "ssn": rf"(?=\p{{Nd}}){_OPEN}\p{{Nd}}{{3}}-\p{{Nd}}{{2}}-\p{{Nd}}{{4}}{_SHUT}",
    "iban": rf"[A-Za-z{_FOLD}]{{2}}\p{{Nd}}{{2}}[A-Za-z0-9{_FOLD}]{{4}}\p{{Nd}}{{7}}[A-Za-z0-9{_FOLD}]{{0,16}}",
    "credit_card": PATTERNS["credit_card"].replace(r"\b", rf"(?=[3-6]){_OPEN}", 1).replace(r"\b", _SHUT),
    "ip_address": PATTERNS["ip_address"].replace(r"\b", rf"(?=[0-9]){_OPEN}", 1).replace(r"\b", _SHUT),
    "date_of_birth": PATTERNS["date_of_birth"].replace(r"\b", rf"(?=[01]){_OPEN}", 1)
    .replace(r"\b", _SHUT)
    .replace(r"\d", r"\p{Nd}"),
}


def _builtin(name: str, sensitivity: str, action: str, about: str, needs: str, smallest_int: float) -> Detection:
    return Detection(name, PATTERNS[name], sensitivity, action, about, _JAVA[name], needs, smallest_int)


DETECTIONS = (
    _builtin("email", "high", "mask", "Mailboxes, as in name@host.tld", "@", math.inf),
    _builtin("phone", "high", "mask", "Phone numbers of ten digits, as written in North America", _FOUR_DIGITS, 10**9),
    _builtin("phone_international", "high", "mask", "Phone numbers with a plus sign and country code", "+", math.inf),
    _builtin("ssn", "critical", "deny", "Social security numbers, nine digits in three groups", _FOUR_DIGITS, math.inf),
    _builtin("iban", "critical", "hash", "Bank account numbers that begin with a country", _FOUR_DIGITS, math.inf),
    _builtin("credit_card", "critical", "deny", "Payment card numbers of the large issuers", _FOUR_DIGITS, 10**12),
    _builtin("ip_address", "medium", "hash", "Internet addresses of four numbers", r"re:[0-9]\.[0-9]", math.inf),
    _builtin("date_of_birth", "high", "mask", "Dates written month, day, year", _FOUR_DIGITS, math.inf),
)


@dataclass(frozen=True)
class Rules:
    """A full rule set: detections, masks, name rules and sensitivity levels."""

    detections: tuple[Detection, ...] = DETECTIONS
    masks: dict[str, Mask] = field(default_factory=lambda: dict(MASKS))
    names: NameRules = NameRules(EXACT_NAMES, NAME_FRAGMENTS, NAME_PATTERNS, BACKEND_NAMES)
    levels: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(ALLOWED_BY_LEVEL))

    # -- building -----------------------------------------------------------
    def with_masks(self, **masks: Mask) -> Rules:
        """Same rules with some masks replaced or added."""
        return replace(self, masks={**self.masks, **masks})

    @classmethod
    def from_yaml(cls, path: str) -> Rules:
        """Load a policy file (see README for its layout)."""
        import yaml

        with open(path, encoding="utf-8") as handle:
            return cls.from_dict(yaml.safe_load(handle) or {})

    @classmethod
    def from_dict(cls, spec: dict[str, Any]) -> Rules:
        """Build rules from the parsed policy file; absent sections mean "none"."""
        names = spec.get("column_classifications") or {}
        known = {d.name: d for d in DETECTIONS}
        detections = []
        for name, entry in (spec.get("detection_patterns") or {}).items():
            if not entry.get("pattern"):
                continue
            base = known.get(name)
            same = base is not None and base.pattern == entry["pattern"].replace("([A-Z0-9]?){0,16}", "[A-Z0-9]{0,16}")
            fresh = base if same else Detection(name, entry["pattern"])
            detections.append(
                replace(
                    fresh,
                    sensitivity=entry.get("sensitivity", "medium"),
                    default_action=entry.get("default_action", "mask"),
                    description=entry.get("description", ""),
                )
            )
        levels = {
            level: tuple(entry.get("allowed_policies") or ())
            for level, entry in (spec.get("sensitivity_levels") or {}).items()
        }
        rules = cls(
            detections=tuple(detections),
            names=NameRules(
                exact=tuple(n.lower() for n in names.get("exact") or ()),
                contains=tuple(n.lower() for n in names.get("contains") or ()),
                patterns=tuple(names.get("patterns") or ()),
                backends={
                    b: tuple(c.lower() for c in (e or {}).get("additional_pii_columns") or ())
                    for b, e in (spec.get("backend_overrides") or {}).items()
                },
            ),
            levels=levels or dict(ALLOWED_BY_LEVEL),
        )
        rules.validate()
        return rules

    def validate(self) -> None:
        """Reject rules that cannot work: bad patterns, levels or actions."""
        for d in self.detections:
            if re.compile(d.pattern, re.IGNORECASE).match(""):
                raise ValueError(f"pattern of '{d.name}' matches the empty string")
            java_pattern(d.pattern)
            if d.sensitivity not in SENSITIVITY_RANK:
                raise ValueError(f"unknown sensitivity '{d.sensitivity}' of '{d.name}'")
            if d.default_action not in POLICY_RANK:
                raise ValueError(f"unknown action '{d.default_action}' of '{d.name}'")
        for p in self.names.patterns:
            re.compile(p)
            java_pattern(p)
        for level, allowed in self.levels.items():
            if level not in SENSITIVITY_RANK or not allowed or any(a not in POLICY_RANK for a in allowed):
                raise ValueError(f"bad sensitivity level '{level}'")

    # -- looking up ---------------------------------------------------------
    @property
    def types(self) -> list[str]:
        return [d.name for d in self.detections]

    def detection(self, name: str) -> Detection | None:
        return next((d for d in self.detections if d.name == name), None)

    def mask_of(self, pii_type: str) -> Mask:
        return self.masks.get(pii_type, Mask())

    def label(self, name: str, backend: str | None = None) -> NameLabel:
        """Label one column name on the driver (plans are built from schemas)."""
        low = name.lower()
        n = self.names
        if low in n.exact:
            return NameLabel(name, True, name_sensitivity(low), name_category(low), "exact_match")
        for piece in n.contains:
            if piece in low:
                return NameLabel(name, True, name_sensitivity(low), name_category(low), f"contains_pattern:{piece}")
        for p in n.patterns:
            if re.search(p, low, re.IGNORECASE):
                return NameLabel(name, True, "medium", "inferred", f"regex_pattern:{p}")
        if backend and low in n.backends.get(backend, ()):
            return NameLabel(name, True, "medium", "backend_specific", f"backend_override:{backend}")
        return NameLabel(name, False)

    def named_pii(self, columns: list[str], backend: str | None = None) -> list[str]:
        return [c for c in columns if self.label(c, backend).is_pii]

    def weakest_allowed(self, sensitivity: str) -> str:
        """The mildest policy a sensitivity level allows."""
        allowed = self.levels.get(sensitivity) or tuple(POLICY_RANK)
        return min(allowed, key=POLICY_RANK.__getitem__)


def name_sensitivity(low: str) -> str:
    if any(k in low for k in CRITICAL_KEYWORDS):
        return "critical"
    return "high" if any(k in low for k in HIGH_KEYWORDS) else "medium"


def name_category(low: str) -> str:
    hits = (c for c, keys in CATEGORY_KEYWORDS.items() if any(k in low for k in keys))
    return next(hits, "unknown")


DEFAULT_RULES = Rules()
