"""A stream's policy that learns: a column in which personal data is found is tokenised from that batch on.

State is a table of versions. Each batch is profiled with the columns that aren't hashed yet; what is
found makes the next version, which the batch itself is already written under, so a value that
makes a column known is never written raw. A version and its batch's rows are folders named by the
batch, so a replayed batch sees the version before it, decides alike and writes the same folders.
A column never goes back: tokens of a column that was raw before don't link to its raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cloakframe.functions.tokens import resolve_salt
from cloakframe.operators.fields import Scope
from cloakframe.operators.profile import profile_table
from cloakframe.operators.protect import hash_table
from cloakframe.rules import DEFAULT_RULES, Rules

VERSION_SCHEMA = "column string, pii_types array<string>, since long"


def version_before(spark: SparkSession, path: str, batch_id: int) -> list[tuple]:
    """The columns known before a batch: the newest version below it (at most one row a column)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(folder):
        return []
    numbers = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(folder) if s.getPath().getName().startswith("version=")]
    older = [n for n in numbers if n < batch_id]
    return [tuple(r) for r in spark.read.schema(VERSION_SCHEMA).parquet(f"{path}/version={max(older)}").collect()] if older else []


def next_version(known: list[tuple], batch: DataFrame, batch_id: int, rules: Rules = DEFAULT_RULES, scope: Scope = Scope()) -> list[tuple]:
    """What is known behind a batch; its columns that are still raw are scanned once."""
    names = {k[0] for k in known}
    raw = [c for c in batch.columns if c not in names]
    if not raw:
        return known
    found = profile_table(batch, rules, raw, scope).where("n_rows > 0").groupBy("column").agg(F.array_sort(F.collect_set("pii_type")).alias("t")).collect()
    return known + sorted((r["column"], r.t, batch_id) for r in found)


def learning_stream(
    stream: DataFrame, path: str, versions: str, checkpoint: str, salt: str | None = None, rules: Rules = DEFAULT_RULES, scope: Scope = Scope(), trigger: dict | None = None
) -> StreamingQuery:
    """Write a stream under a policy that learns: rows to ``path``/batch=n, what is known to ``versions``/version=n.

    A column that becomes tokens is text from then on, so all columns are written as text (``read_learned``).
    """
    key = resolve_salt(salt)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        try:
            known = next_version(version_before(spark, versions, batch_id), rows, batch_id, rules, scope)
            out = hash_table(rows, key, [k[0] for k in known]) if known else rows
            out.select([F.col(c).cast("string").alias(c) for c in out.columns]).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
            spark.createDataFrame(known, VERSION_SCHEMA).write.mode("overwrite").parquet(f"{versions}/version={batch_id}")
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_learned(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All rows as texts, with the batch that each came in."""
    rows = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("basePath", path).parquet(f"{path}/batch=*")
    return rows.withColumn("batch", F.col("batch").cast("long"))
