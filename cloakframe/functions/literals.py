"""The few checks that concern single values on the driver: filter literals and
error messages.  Tables never come here."""

from __future__ import annotations

import re
from typing import Any

from cloakframe.rules import DEFAULT_RULES, Mask, Rules


def find(value: Any, rules: Rules = DEFAULT_RULES) -> list[tuple[int, int, str]]:
    """(start, end, type) of everything found in one literal."""
    if value is None:
        return []
    text = str(value)
    return [
        (m.start(), m.end(), d.name)
        for d in rules.detections
        for m in re.finditer(d.pattern, text, re.IGNORECASE)
    ]


def mask_literal(value: str, rule: Mask) -> str:
    if rule.template:
        return rule.template.replace("{start}", value[: rule.keep_start])
    if rule.fixed_length:
        return rule.char * rule.fixed_length
    hidden = len(value) - rule.keep_start - rule.keep_end
    if hidden <= 0:
        return rule.char * len(value)
    return value[: rule.keep_start] + rule.char * hidden + value[len(value) - rule.keep_end :]


def scrub(text: str, rules: Rules = DEFAULT_RULES) -> str:
    """A message with everything found in it masked."""
    out = text
    for start, end, kind in sorted(find(text, rules), key=lambda hit: -hit[0]):
        out = out[:start] + mask_literal(text[start:end], rules.mask_of(kind)) + out[end:]
    return out


def scrub_map(values: dict[str, Any], rules: Rules = DEFAULT_RULES) -> dict[str, Any]:
    """Filter values fit for a log; nested maps are followed."""
    return {
        k: scrub(v, rules) if isinstance(v, str) else scrub_map(v, rules) if isinstance(v, dict) else v
        for k, v in values.items()
    }
