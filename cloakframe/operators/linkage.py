"""Joining tables on tokens, so that they link without their raw values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.sql import lit, name
from cloakframe.functions.tokens import NULL_TOKEN, is_token


def _real(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull() & (F.col(key) != NULL_TOKEN))


def link(left: DataFrame, right: DataFrame, on: str, right_on: str | None = None, how: str = "inner") -> DataFrame:
    """Equi-join of two tokenised tables; the null token never matches itself.

    Semi and anti joins only need the distinct tokens of the right side, which
    shrinks it map-side and leaves one row per token however hot a token is.
    Spark broadcasts the right side only below its size threshold; beyond, it
    sorts and merges, and adaptive execution splits hot partitions of the left.
    """
    other = right_on or on
    if how in ("left_semi", "left_anti"):
        keys = _real(right.select(F.col(other).alias("__token")), "__token").distinct()
        kept = _real(left, on).join(keys, F.col(on) == F.col("__token"), how)
        if how == "left_semi":
            return kept
        # rows without a real token match nothing, so they need no join
        return kept.unionByName(left.where(F.col(on).isNull() | (F.col(on) == NULL_TOKEN)))
    if how != "inner":
        raise ValueError("how must be inner, left_semi or left_anti")
    keyed = _real(right, other).withColumnRenamed(other, "__token")
    clash = set(left.columns) & set(keyed.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    return _real(left, on).join(keyed, F.col(on) == F.col("__token")).drop("__token")


def linkage_counts(left: DataFrame, right: DataFrame, on: str, right_on: str | None = None) -> DataFrame:
    """Per token: its rows on either side and the pairs an inner join would give.

    Both sides are counted before they meet, so a token that holds a third of
    both tables is one row on each side of the join.
    """

    def counted(df: DataFrame, key: str, name: str) -> DataFrame:
        return _real(df, key).groupBy(F.col(key).alias("token")).agg(F.count(F.lit(1)).alias(name))

    both = counted(left, on, "left_rows").join(counted(right, right_on or on, "right_rows"), "token")
    return both.withColumn("pairs", F.col("left_rows") * F.col("right_rows"))


def token_quality(df: DataFrame, column: str) -> DataFrame:
    """One row: how many values are tokens, null tokens, raw values or null."""
    x = name(column)
    return df.selectExpr(
        f"count_if({is_token(x)} AND {x} <> {lit(NULL_TOKEN)}) AS tokens",
        f"count_if(coalesce({x} = {lit(NULL_TOKEN)}, false)) AS null_tokens",
        f"count_if({x} IS NOT NULL AND NOT {is_token(x)}) AS raw_values",
        f"count_if({x} IS NULL) AS nulls",
    )
