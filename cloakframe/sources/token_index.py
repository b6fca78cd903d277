"""Tokens of a table in a bucketed, sorted index: lookups read one bucket, and indexes link without a shuffle.

``build_token_index`` makes the tokens once and writes them with the chosen columns into a
bucketed table. A value is then found by its token in one bucket, instead of hashing every row;
two indexes with the same number of buckets join bucket by bucket. Writing deals each bucket
out to ``spread`` tasks by a hash of the row, so a token that holds a third of all rows isn't
written by one task.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.functions.sql import name as quoted
from cloakframe.functions.text import pii_text
from cloakframe.functions.tokens import NULL_TOKEN, token, token_of

TOKEN = "token"


def build_token_index(df: DataFrame, column: str, salt: str, table: str, path: str | None = None, buckets: int = 64, keep: list[str] | None = None, spread: int = 4) -> None:
    """Write the table ``table``: ``token`` of ``column`` and the columns of ``keep`` (default: all others), in ``buckets`` sorted buckets.

    With ``path`` the files lie there, else in the warehouse. Nulls have the null token, which no lookup or link returns.
    """
    kept = [c for c in df.columns if c != column] if keep is None else keep
    if TOKEN in kept:
        raise ValueError(f"a kept column is named '{TOKEN}'")
    made = df.select(F.expr(token(pii_text(quoted(column), df.schema[column].dataType), salt)).alias(TOKEN), *[F.col(quoted(c)) for c in kept])
    bucket = F.pmod(F.hash(TOKEN), F.lit(buckets))  # as Spark numbers buckets
    dealt = made.repartition(buckets * spread, bucket, F.pmod(F.xxhash64(TOKEN, *[F.col(quoted(c)).cast("string") for c in kept]), F.lit(spread)))
    writer = dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, TOKEN).sortBy(TOKEN)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def lookup(spark: SparkSession, table: str, value: Any, salt: str) -> DataFrame:
    """Rows whose column had ``value``: one bucket is read. A null value finds nothing."""
    rows = spark.table(table)
    return rows.where(F.lit(False)) if value is None else rows.where(F.col(TOKEN) == token_of(value, salt))


def link_indexes(spark: SparkSession, left: str, right: str) -> DataFrame:
    """Inner join of two indexes on their tokens: bucket by bucket, without an exchange, where both have as many buckets."""
    a, b = (spark.table(t).where(F.col(TOKEN) != NULL_TOKEN) for t in (left, right))
    clash = (set(a.columns) & set(b.columns)) - {TOKEN}
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    return a.join(b.hint("merge"), TOKEN)
