"""Sessions found by gaps in time, in streams and in tables.

A session is a run of a key's events of which each follows the one before by the gap at most. In
a stream the open sessions are merging windows: a late event may join two of them. State is one
row for each open session, however many events it has. A session is emitted when the watermark has passed its
end, and events later than the lateness are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def gap_sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", invocation: Column | None = None, lateness: str | None = None) -> DataFrame:
    """``key``, ``started_at``, ``ended_at`` (of the last event), ``n_events``, ``total_invocations`` of each session; ``lateness`` for streams.

    Events without a time belong to no session. Events at the same time are one session; a null key is a key.
    """
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("__ts", lateness) if lateness else timed
    counted = F.lit(True) if invocation is None else invocation
    sessions = timed.groupBy(F.session_window("__ts", gap).alias("__w"), F.col(key)).agg(
        F.min("__ts").alias("started_at"), F.max("__ts").alias("ended_at"), F.count(F.lit(1)).alias("n_events"), F.count_if(counted).alias("total_invocations")
    )
    return sessions.drop("__w").select(key, "started_at", "ended_at", "n_events", "total_invocations")


def sessions_stream(stream: DataFrame, key: str, path: str, checkpoint: str, ts: str = "ts", gap: str = "30 minutes", invocation: Column | None = None, lateness: str = "1 hour", trigger: dict | None = None) -> StreamingQuery:
    """Write closed sessions, a folder for each batch; a batch that is replayed overwrites its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    sessions = gap_sessions(stream, key, ts, gap, invocation, lateness)
    return sessions.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
