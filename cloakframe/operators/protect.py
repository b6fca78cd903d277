"""Masking and tokenising whole tables: row-local, no shuffle, batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cloakframe.functions.detect import found, types_of
from cloakframe.functions.mask import apply_mask, redact
from cloakframe.functions.sql import name
from cloakframe.functions.text import pii_text
from cloakframe.functions.tokens import token, token_if
from cloakframe.operators.fields import TEXT_ONLY, Scope, map_text, scanned
from cloakframe.rules import DEFAULT_RULES, Mask, Rules


def _change(df: DataFrame, columns: list[str] | None, body) -> DataFrame:
    """Replace columns (default: all) by ``body(expression, type)``; None keeps one."""
    missing = [c for c in columns or [] if c not in df.columns]
    if missing:
        raise ValueError(f"no such column: {missing}")
    chosen = set(columns or df.columns)
    out = []
    for f in df.schema.fields:
        x = name(f.name)
        new = body(x, f.dataType) if f.name in chosen else None
        out.append(x if new is None else f"{new} AS {x}")
    return df.selectExpr(*out)


def redact_table(
    df: DataFrame,
    columns: list[str] | None = None,
    rules: Rules = DEFAULT_RULES,
    overlap: str = "each",
    numbers: bool = False,
) -> DataFrame:
    """Mask every found value in the given columns (default: all), strings at any depth.

    With ``numbers`` integers and decimals are masked too and become strings.
    """

    def body(x: str, dtype: T.DataType) -> str | None:
        if numbers and isinstance(dtype, T.NumericType) and Scope().covers(dtype):
            return redact(pii_text(x, dtype), rules, overlap)
        if scanned(dtype, TEXT_ONLY):
            return map_text(x, dtype, lambda v: redact(v, rules, overlap))
        return None

    return _change(df, columns, body)


def redact_with_types(
    df: DataFrame, column: str, types_column: str = "pii_types", rules: Rules = DEFAULT_RULES, overlap: str = "each"
) -> DataFrame:
    """Redact one text column and say which types it held, scanning it once."""
    x = name(column)
    kept = [f"{redact(x, rules, overlap, hits='__found')} AS {x}" if c == column else name(c) for c in df.columns]
    scanned_once = df.selectExpr("*", f"{found(x, rules)} AS __found")
    return scanned_once.selectExpr(*kept, f"coalesce({types_of('__found', rules)}, array()) AS {name(types_column)}")


def star_columns(df: DataFrame, columns: list[str], mask: Mask = Mask()) -> DataFrame:
    """Mask whole values of the given columns, whatever they hold."""
    return _change(df, columns, lambda x, dtype: apply_mask(pii_text(x, dtype), mask))


def hash_table(df: DataFrame, salt: str, columns: list[str] | None = None) -> DataFrame:
    """Replace whole values of the given columns (default: all) by tokens."""
    return _change(df, columns, lambda x, dtype: token(pii_text(x, dtype), salt))


def hash_where(df: DataFrame, column: str, flag: str, salt: str) -> DataFrame:
    """Tokenise a column in the rows where a boolean expression holds."""
    return _change(df, [column], lambda x, dtype: token_if(pii_text(x, dtype), flag, salt))
