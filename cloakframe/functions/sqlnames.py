"""The expressions as SQL functions of a session.

They are SQL functions, not UDFs: Spark inlines their bodies into the plan.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from cloakframe.functions.detect import SPAN, has_pii, pii_types, spans
from cloakframe.functions.mask import mask_by_type, redact
from cloakframe.functions.tokens import is_token, token
from cloakframe.rules import DEFAULT_RULES, Rules


def register_sql_functions(spark: SparkSession, salt: str | None = None, rules: Rules = DEFAULT_RULES) -> list[str]:
    """Create ``pii_spans(x)``, ``pii_has(x)``, ``pii_types(x)``, ``pii_redact(x)``,
    ``pii_mask(x, kind)``, ``pii_is_token(x)`` and, given a salt, ``pii_token(x)``."""
    bodies = {
        "pii_spans(x STRING)": (f"ARRAY<{SPAN}>", spans("x", rules)),
        "pii_has(x STRING)": ("BOOLEAN", has_pii("x", rules)),
        "pii_types(x STRING)": ("ARRAY<STRING>", pii_types("x", rules)),
        "pii_mask(x STRING, kind STRING)": ("STRING", mask_by_type("x", "kind", rules)),
        "pii_redact(x STRING)": ("STRING", redact("x", rules)),
        "pii_is_token(x STRING)": ("BOOLEAN", is_token("x")),
    }
    if salt is not None:
        bodies["pii_token(x STRING)"] = ("STRING", token("x", salt))
    for signature, (kind, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    return [s.split("(")[0] for s in bodies]
