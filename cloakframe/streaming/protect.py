"""Protecting streams with the same expressions as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cloakframe.functions.sql import any_of
from cloakframe.operators.fields import Scope, fields
from cloakframe.operators.protect import hash_table, redact_table
from cloakframe.rules import DEFAULT_RULES, Rules


def protect_stream(
    stream: DataFrame,
    mask_columns: list[str] | None = None,
    hash_columns: list[str] | None = None,
    salt: str | None = None,
    rules: Rules = DEFAULT_RULES,
    overlap: str = "each",
) -> DataFrame:
    """Mask and tokenise columns fixed beforehand (by name, or from a profile of past data).

    Stateless: each micro-batch is one narrow stage.
    """
    hashed = hash_columns or []
    masked = [c for c in (stream.columns if mask_columns is None else mask_columns) if c not in hashed]
    out = redact_table(stream, masked, rules, overlap) if masked else stream
    return hash_table(out, salt, hashed) if hashed else out


def append_stream(
    stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", trigger: dict | None = None
) -> StreamingQuery:
    """Write a protected stream to files, each row exactly once."""
    return (
        stream.writeStream.format(fmt)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )


def quarantine_stream(
    stream: DataFrame,
    clean_path: str,
    quarantine_path: str,
    checkpoint: str,
    columns: list[str] | None = None,
    rules: Rules = DEFAULT_RULES,
    scope: Scope = Scope(),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Deny for streams: rows with personal data go to a guarded place, the rest pass.

    A batch is scanned once and written by one partitioned write per side into a
    folder of its own, so a batch that is replayed overwrites itself.
    """
    places = fields(stream.schema, scope, columns)
    hit = F.expr(any_of(p.holds_any(rules, scope) for p in places))

    def write(batch: DataFrame, batch_id: int) -> None:
        flagged = batch.withColumn("__held", hit).persist()
        try:
            for held, path in ((False, clean_path), (True, quarantine_path)):
                side = flagged.where(F.col("__held") == held).drop("__held")
                side.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            flagged.unpersist()

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
