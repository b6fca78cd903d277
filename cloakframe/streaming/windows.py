"""Counting audit events by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def audit_counts(stream: DataFrame, ts: str = "ts", width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Events per type and tumbling window; rows later than ``lateness`` are dropped.

    State is one counter per open window and type, whatever the event rate.
    """
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return (
        timed.withWatermark(ts, lateness)
        .groupBy(F.window(ts, width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n_events")
    )


def counts_stream(
    stream: DataFrame, path: str, checkpoint: str, width: str = "1 hour", lateness: str = "10 minutes", trigger: dict | None = None
) -> StreamingQuery:
    """Write the counts of a batch's changed windows, open ones too, to a folder of the batch.

    A batch that is replayed overwrites its own folder.  ``latest_counts`` reads the state so far.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        audit_counts(stream, width=width, lateness=lateness)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


_COUNTS = "window_start timestamp, window_end timestamp, event_type string, n_events long"


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the complete folders ``name=n`` of a path."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    done = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{name}=") and done(n))


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """Each window's latest count from ``counts_stream``: the newest compacted folder and the batches behind it."""
    bases = _numbers(spark, path, "base")
    base = bases[-1] if bases else -1
    parts = [f"{path}/base={base}"] if bases else []
    parts += [f"{path}/batch={n}" for n in _numbers(spark, path, "batch") if n > base]
    if not parts:
        return spark.createDataFrame([], _COUNTS)
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/(?:base|batch)=(\d+)/[^/]*$", 1).cast("long")
    rows = spark.read.schema(_COUNTS).parquet(*parts).withColumn("batch", number)
    return rows.groupBy("window_start", "window_end", "event_type").agg(F.max_by("n_events", "batch").alias("n_events"))


def compact_counts(spark: SparkSession, path: str) -> int:
    """Write the state so far to one folder, so that reading it needs no batch up to that one; the number of that batch.

    Batches are left where they are, for readers at work and for a replay; a replayed one that is older than the
    folder is not read. Run it when no batch is being written.
    """
    batches = _numbers(spark, path, "batch")
    if batches:
        latest_counts(spark, path).write.mode("overwrite").parquet(f"{path}/base={batches[-1]}")
    return batches[-1] if batches else -1
