"""Text form of values: what the detectors scan and the tokens are made of."""

from __future__ import annotations

from pyspark.sql import types as T

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
STRINGS = (T.StringType, T.CharType, T.VarcharType)


def pii_text(x: str, dtype: T.DataType) -> str:
    """A value as text, spelt the way Python's ``str`` spells it.

    Nested values become JSON.  The same value must give the same token whatever
    produced it, so the form does not depend on Spark's own display rules.
    """
    if isinstance(dtype, STRINGS):
        return x
    if isinstance(dtype, T.BooleanType):
        return f"initcap(CAST({x} AS STRING))"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return _double_text(f"CAST({x} AS DOUBLE)")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        micros = f"date_format({x}, 'SSSSSS')"
        base = f"date_format({x}, 'yyyy-MM-dd HH:mm:ss')"
        return f"IF({micros} = '000000', {base}, concat_ws('.', {base}, {micros}))"
    if isinstance(dtype, T.BinaryType):
        return f"base64({x})"
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        return f"to_json({x})"
    return f"CAST({x} AS STRING)"


def _double_text(x: str) -> str:
    """``str(float)``: plain digits from 1e-4 up to 1e16, ``1e-05`` style beyond."""
    text = f"CAST({x} AS STRING)"
    plain = f"regexp_replace(CAST(try_cast({x} AS DECIMAL(38,21)) AS STRING), r'(\\.[0-9]*?)0+$', '$1')"
    exponent = f"CAST(substring_index({text}, 'E', -1) AS INT)"
    scientific = (
        f"concat(regexp_replace(substring_index({text}, 'E', 1), r'\\.0$', ''), IF({exponent} < 0, 'e-', 'e+'), "
        f"IF(abs({exponent}) < 10, '0', ''), CAST(abs({exponent}) AS STRING))"
    )
    return f"""CASE WHEN {x} IS NULL THEN NULL WHEN isnan({x}) THEN 'nan'
        WHEN {x} = double('Infinity') THEN 'inf' WHEN {x} = double('-Infinity') THEN '-inf'
        WHEN abs({x}) >= 1e-3 AND abs({x}) < 1e7 OR {x} = 0 THEN {text}
        WHEN abs({x}) >= 1e-4 AND abs({x}) < 1e16 THEN IF(endswith({plain}, '.'), concat({plain}, '0'), {plain})
        ELSE {scientific} END"""
