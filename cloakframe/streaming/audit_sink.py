"""An audit log written exactly once from a stream of JSON lines.

Lines that are no event are kept apart, as they came. Events that were sent again are dropped by
state of bounded age: equal events within ``lateness`` of each other are one. Each batch writes a
folder of its own and a batch that is replayed writes the same folder again, so what a failure
left half written is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cloakframe.operators.audit import EVENT_LEVELS
from cloakframe.sources.audit_log import AUDIT_SCHEMA


def parsed_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``line``, ``event`` (null where the line is none) of every line: an object of the log's fields with a known event type and a time."""
    event = F.from_json(F.col(column), AUDIT_SCHEMA + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    known = F.col("event.event_type").isin(*EVENT_LEVELS) & F.col("event.ts").isNotNull() & F.col("event._bad").isNull()
    return lines.select(F.col(column).alias("line"), event.alias("event")).withColumn("event", F.when(known, F.col("event").dropFields("_bad")))


def event_key() -> Column:
    """What makes an event one: a digest of all its fields."""
    return F.sha2(F.to_json("event"), 256)


def _batches(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def audit_sink(
    lines: DataFrame, path: str, bad_path: str, checkpoint: str, lateness: str = "1 hour", column: str = "value", trigger: dict | None = None
) -> tuple[StreamingQuery, StreamingQuery]:
    """Start the two streams: events to ``path``, each once, and lines that are none to ``bad_path``."""
    events = parsed_lines(lines, column).where("event IS NOT NULL").select(event_key().alias("event_key"), "event.*")
    once = events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_key"])
    bad = parsed_lines(lines, column).where("event IS NULL").select("line")
    return _batches(once, path, f"{checkpoint}/events", trigger), _batches(bad, bad_path, f"{checkpoint}/bad", trigger)


def read_sink(spark: SparkSession, path: str) -> DataFrame:
    """The events of a sink."""
    return spark.read.schema("event_key string, " + AUDIT_SCHEMA).parquet(f"{path}/batch=*")
