"""The audit log as a table: append-only JSON lines with one fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

AUDIT_SCHEMA = (
    "ts timestamp, event_type string, service string, version string, session_id string, "
    "invocation_id string, level string, tool_name string, backend string, intent string, "
    "pii_policy string, filter_keys array<string>, detected_pii_types array<string>, "
    "affected_columns array<string>, rows_scanned bigint, policy string, "
    "columns_affected array<string>, action_taken string, operation string, duration_ms double, "
    "row_count bigint, success boolean, reason string, error_type string, error_message string, "
    "total_invocations bigint"
)


def append_audit(events: DataFrame, path: str) -> None:
    """Append events to the log; every task writes its own files."""
    events.write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)


def append_audit_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The same for a stream of events, each exactly once."""
    return (
        events.writeStream.format("json")
        .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The log with its fixed schema (nothing is inferred)."""
    return spark.read.schema(AUDIT_SCHEMA).json(path)
