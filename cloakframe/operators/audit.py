"""Audit events from request tables, and reports over the event table."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.functions.mask import redact
from cloakframe.rules import DEFAULT_RULES, Rules
from cloakframe.sources.audit_log import AUDIT_SCHEMA

SERVICE = "cloakframe"
VERSION = "0.1.0"
TOOL = "query_data"
# The event types and the severity they are logged at.
EVENT_LEVELS = {
    "tool_invocation": "info",
    "query_executed": "info",
    "pii_detected": "info",
    "policy_applied": "info",
    "access_denied": "warning",
    "backend_call": "info",
    "error": "error",
    "session_start": "info",
    "session_end": "info",
}


def event(spark: SparkSession, event_type: str, **values: Any) -> DataFrame:
    """One event row; fields not given are null."""
    if event_type not in EVENT_LEVELS:
        raise ValueError(f"unknown event type '{event_type}'")
    given = {"event_type": event_type, "service": SERVICE, "version": VERSION, "level": EVENT_LEVELS[event_type], **values}
    parts = _schema_parts()
    unknown = set(given) - {name for name, _ in parts}
    if unknown:
        raise ValueError(f"unknown audit fields: {sorted(unknown)}")
    columns = {name: _literal(value) for name, value in given.items()}
    columns.setdefault("ts", F.current_timestamp())
    return spark.range(1).select(*[columns.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in parts])


def _literal(value: Any) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, (list, tuple)):
        return F.array(*[F.lit(v) for v in value])
    return F.lit(value)


def _schema_parts() -> list[tuple[str, str]]:
    return [tuple(p.split(" ", 1)) for p in AUDIT_SCHEMA.split(", ")]


def as_events(df: DataFrame, event_type: str, **columns: Column) -> DataFrame:
    """Event rows computed from the rows of any table."""
    given = {
        "event_type": F.lit(event_type),
        "service": F.lit(SERVICE),
        "version": F.lit(VERSION),
        "level": F.lit(EVENT_LEVELS[event_type]),
        **columns,
    }
    null = F.lit(None)
    return df.select(*[given.get(name, null).cast(kind).alias(name) for name, kind in _schema_parts()])


def invocation_events(requests: DataFrame, ts: Column, invocation_id: Column, session_id: Column, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """A ``tool_invocation`` event per request; what the intent says is masked first."""
    return as_events(
        requests,
        "tool_invocation",
        ts=ts,
        session_id=session_id,
        invocation_id=invocation_id,
        tool_name=F.lit(TOOL),
        backend=F.col("backend"),
        intent=F.expr(redact("intent", rules)),
        pii_policy=F.col("pii_policy"),
        filter_keys=F.map_keys("filters"),
    )


def denial_events(screened: DataFrame, ts: Column, invocation_id: Column, session_id: Column, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """An ``access_denied`` event per rejected request of ``screen_requests``."""
    return as_events(
        screened.where("reject_reason IS NOT NULL"),
        "access_denied",
        ts=ts,
        session_id=session_id,
        invocation_id=invocation_id,
        backend=F.col("backend"),
        reason=F.expr(redact("reject_reason", rules)),
    )


def detection_events(profile: DataFrame, ts: Column, invocation_id: Column, session_id: Column) -> DataFrame:
    """A ``pii_detected`` event per column and type of a profile."""
    return as_events(
        profile.where("n_rows > 0"),
        "pii_detected",
        ts=ts,
        session_id=session_id,
        invocation_id=invocation_id,
        detected_pii_types=F.array("pii_type"),
        affected_columns=F.array("path"),
        rows_scanned=F.col("rows_scanned"),
    )


def policy_events(decided: DataFrame, policy: str, ts: Column, invocation_id: Column, session_id: Column) -> DataFrame:
    """A ``policy_applied`` event per column of a decision table."""
    return as_events(
        decided,
        "policy_applied",
        ts=ts,
        session_id=session_id,
        invocation_id=invocation_id,
        policy=F.lit(policy),
        columns_affected=F.array("column"),
        action_taken=F.concat(F.lit("applied "), F.col("action")),
    )


def call_events(calls: DataFrame, ts: Column, session_id: Column, operation: Column, duration_ms: Column, success: Column) -> DataFrame:
    """A ``backend_call`` event per call, and an ``error`` event for each that failed."""
    done = as_events(calls, "backend_call", ts=ts, session_id=session_id, operation=operation, duration_ms=duration_ms, success=success)
    failed = as_events(calls.where(~success), "error", ts=ts, session_id=session_id, operation=operation, success=success)
    return done.unionByName(failed)


def session_events(report: DataFrame, key: str = "session_id") -> DataFrame:
    """A ``session_start`` and a ``session_end`` event per row of ``session_report``."""
    start = as_events(report, "session_start", ts=F.col("started_at"), session_id=F.col(key))
    end = as_events(report, "session_end", ts=F.col("ended_at"), session_id=F.col(key), total_invocations=F.col("total_invocations"))
    return start.unionByName(end)


# -- reports --------------------------------------------------------------------
def invocation_report(
    events: DataFrame, key: str = "invocation_id", ts: str = "ts", event_type: str = "event_type"
) -> DataFrame:
    """The trail of each invocation: span, number, kinds and last kind of its events.

    Every aggregate has a bounded partial state (the set of kinds is small), so a
    hot key is reduced before the shuffle.
    """
    return events.groupBy(key).agg(
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.count(F.lit(1)).alias("n_events"),
        F.array_sort(F.collect_set(event_type)).alias("event_types"),
        F.max_by(event_type, F.struct(ts, event_type)).alias("last_event_type"),
    )


def backend_report(
    events: DataFrame,
    keys: list[str] | None = None,
    duration: str = "duration_ms",
    success: Column | None = None,
    rows: str | None = "row_count",
) -> DataFrame:
    """Calls, successes and durations per backend and operation."""
    ok = F.col("success") if success is None else success
    extra = [F.sum(rows).alias("rows_returned")] if rows else []
    d = F.col(duration)
    return events.groupBy(*(keys or ["backend", "operation"])).agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.count_if(ok).alias("n_success"),
        F.avg(d).alias("avg_ms"),
        F.min(d).alias("min_ms"),
        F.max(d).alias("max_ms"),
        F.percentile_approx(d, F.lit(0.95)).alias("p95_ms"),
        *extra,
    )


def session_report(
    events: DataFrame, key: Column | str = "session_id", ts: str = "ts", invocation: Column | None = None
) -> DataFrame:
    """Start, end and number of invocations per session, counted from the events."""
    is_call = (F.col("event_type") == "tool_invocation") if invocation is None else invocation
    by = F.col(key).alias(key) if isinstance(key, str) else key
    return events.groupBy(by).agg(
        F.min(ts).alias("started_at"),
        F.max(ts).alias("ended_at"),
        F.count_if(is_call).alias("total_invocations"),
        F.count(F.lit(1)).alias("n_events"),
    )


def window_counts(events: DataFrame, ts: str = "ts", width: str = "1 hour") -> DataFrame:
    """Events per type and tumbling window of event time (batch twin of the stream)."""
    return (
        events.groupBy(F.window(ts, width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n_events")
    )
