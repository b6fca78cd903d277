"""Python ``re`` patterns as JVM regular expressions.

The two dialects differ in what ``\\w``, ``\\b`` and ``\\s`` cover beyond ASCII, in
``$`` and in ``[`` inside a class.  A missed match is a leak, so patterns are
rewritten to match exactly what Python would.
"""

from __future__ import annotations

import re

WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
NOT_SPACE = r"[^\s\p{Z}\x1c-\x1f\x85]"
BOUNDARY = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
INNER = rf"(?:(?<={WORD})(?={WORD})|(?<!{WORD})(?!{WORD}))"

_ESCAPES = {
    "w": WORD,
    "W": NOT_WORD,
    "s": SPACE,
    "S": NOT_SPACE,
    "d": r"\p{Nd}",
    "D": r"\P{Nd}",
}
_IN_CLASS = {
    "w": r"\p{L}\p{N}_",
    "s": r"\s\p{Z}\x1c-\x1f\x85",
}
_ANCHORS = {"b": BOUNDARY, "B": INNER, "Z": r"\z"}
BEFORE_WORD = rf"(?<!{WORD})"
AFTER_WORD = rf"(?!{WORD})"


def _word_follows(pattern: str, at: int) -> bool:
    """Does a word character certainly follow at this place of the pattern?"""
    if pattern[at : at + 2] in (r"\d", r"\w"):
        at += 2
    elif pattern[at : at + 1].isalnum() or pattern[at : at + 1] == "_":
        at += 1
    else:
        return False
    return pattern[at : at + 1] not in ("?", "*", "{")


def _boundary(pattern: str, at: int) -> str:
    """A word boundary; one look-around is enough beside a certain word character."""
    if _word_follows(pattern, at + 2):
        return BEFORE_WORD
    before = pattern[:at]
    literal = before[-1:].isalnum() and not re.search(r"\\.$", before)
    return AFTER_WORD if literal or re.search(r"(?<!\\)(?:\\\\)*\\[dw]$", before) else BOUNDARY


def java_pattern(pattern: str, ignore_case: bool = True) -> str:
    """JVM form of a Python pattern (flags: ignore case, Unicode, ``\\n`` lines)."""
    re.compile(pattern)
    if "(?P" in pattern or re.search(r"\(\?[aiLmsux]", pattern) or "(?(" in pattern:
        raise ValueError(f"named groups, inline flags and conditionals are not supported: {pattern}")
    out, in_class, first, i = [], False, False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            e = pattern[i + 1]
            if e in _ESCAPES:
                out.append(_IN_CLASS.get(e, _ESCAPES[e]) if in_class else _ESCAPES[e])
            elif e == "b" and not in_class:
                out.append(_boundary(pattern, i))
            elif e in _ANCHORS and not in_class:
                out.append(_ANCHORS[e])
            elif e == "b":
                out.append(r"\x08")
            else:
                out.append(c + e)
            i, first = i + 2, False
            continue
        if in_class:
            if c == "]" and not first:
                in_class = False
                out.append(c)
            elif c in "[&]":
                out.append("\\" + c)
            else:
                out.append(c)
            first = first and c == "^"
        elif c == "[":
            in_class = first = True
            out.append(c)
        else:
            out.append(c)
        i += 1
    return ("(?iud)" if ignore_case else "(?d)") + "".join(out)
