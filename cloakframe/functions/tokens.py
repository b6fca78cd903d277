"""Keyed tokens: the same value always gives the same token, under a secret salt.

HMAC-SHA256 (RFC 2104) is composed from ``sha2``, so it runs in generated code.
"""

from __future__ import annotations

import hashlib
import hmac
import os
from typing import Any

from pyspark.sql import SparkSession

from cloakframe.functions.sql import lit

# Token formats and the well-known salt that must not be used.
NULL_TOKEN = "HASH_NULL"
TOKEN_PREFIX = "HASH_"
TOKEN_BYTES = 16
LOOKUP_INFIX = "_HASH_"
LOOKUP_BYTES = 12
KNOWN_SALT = "change-me-in-production"
SALT_VARIABLE = "PII_HASH_SALT"

_BLOCK = 64


def resolve_salt(salt: str | None = None) -> str:
    """The given salt, else the one in the environment; the well-known one is refused."""
    salt = os.environ.get(SALT_VARIABLE) if salt is None else salt
    if not salt or salt == KNOWN_SALT:
        raise ValueError(f"a secret salt is needed: pass salt=... or set {SALT_VARIABLE}")
    return salt


def pads(salt: str) -> tuple[bytes, bytes]:
    """Inner and outer HMAC pads of a salt."""
    key = salt.encode("utf-8")
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def _hmac_hex(x: str, salt: str, n_bytes: int) -> str:
    session = SparkSession.getActiveSession()
    if session is not None:  # plans that hold the pads must not show them
        hide_salt(session)
    inner, outer = (p.hex().upper() for p in pads(salt))
    first = f"unhex(sha2(concat(X'{inner}', encode({x}, 'UTF-8')), 256))"
    return f"upper(left(sha2(concat(X'{outer}', {first}), 256), {2 * n_bytes}))"


def token(x: str, salt: str) -> str:
    """``HASH_`` and 32 hex digits; null gives ``HASH_NULL``."""
    return f"coalesce(concat({lit(TOKEN_PREFIX)}, {_hmac_hex(x, resolve_salt(salt), TOKEN_BYTES)}), {lit(NULL_TOKEN)})"


def lookup_token(x: str, context: str, salt: str) -> str:
    """Token of a separate name space: ``<CONTEXT>_HASH_`` and 24 hex digits.

    A null identifier is spelt ``None``, so that every row gets a token.
    """
    digest = _hmac_hex(f"coalesce({x}, 'None')", f"{context}:{resolve_salt(salt)}", LOOKUP_BYTES)
    return f"concat({lit(context.upper() + LOOKUP_INFIX)}, {digest})"


def token_if(x: str, flag: str, salt: str) -> str:
    """Token where the flag holds, the text itself elsewhere."""
    return f"IF({flag}, {token(x, salt)}, {x})"


def is_token(x: str) -> str:
    """Does the text look like a token of either kind?  Never null."""

    def hexes(part: str, n_bytes: int) -> str:
        return f"{part} RLIKE {lit(rf'^[0-9A-F]{{{2 * n_bytes}}}' + chr(92) + 'z')}"

    plain = f"{x} = {lit(NULL_TOKEN)} OR " + hexes(f"substring({x}, {len(TOKEN_PREFIX) + 1})", TOKEN_BYTES)
    at = f"instr({x}, {lit(LOOKUP_INFIX)})"
    lookup = f"{at} > 0 AND " + hexes(f"substring({x}, {at} + {len(LOOKUP_INFIX)})", LOOKUP_BYTES)
    return f"coalesce(IF(startswith({x}, {lit(TOKEN_PREFIX)}), {plain}, {lookup}), false)"


def token_of(value: Any, salt: str) -> str:
    """Token of one literal on the driver (for filters on tokenised columns)."""
    if value is None:
        return NULL_TOKEN
    salt = resolve_salt(salt)
    digest = hmac.new(salt.encode("utf-8"), str(value).encode("utf-8"), hashlib.sha256).digest()
    return TOKEN_PREFIX + digest[:TOKEN_BYTES].hex().upper()


# A pad as SQL text and as plans print it.
_PAD = r"(?i)(?:X'|0x)[0-9A-F]{128}'?"


def hide_salt(spark: SparkSession) -> None:
    """Keep the HMAC pads, which are literals of the plan, out of displayed plans."""
    key = "spark.sql.redaction.string.regex"
    before = spark.conf.get(key, None)
    if not before or _PAD not in before:
        spark.conf.set(key, f"{before}|{_PAD}" if before else _PAD)
