"""The request algebra over one table: filter, aggregate, sort, limit."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.functions.sql import lit, name
from cloakframe.functions.text import STRINGS, pii_text
from cloakframe.functions.tokens import token
from cloakframe.plans.policy import reliable_copy
from cloakframe.plans.request import Aggregate, RequestError, SortKey, check_literal, parse_aggregate, parse_sort
from cloakframe.sources.profiles import Profile


def col(column: str) -> Column:
    return F.col(name(column))


def filter_equal(df: DataFrame, filters: dict[str, Any], profile: Profile | None = None) -> DataFrame:
    """Rows where every column equals its literal; the comparison reaches the scan."""
    if not filters:
        return df
    return df.where(reduce(Column.__and__, [_equals(df, k, v, profile) for k, v in filters.items()]))


def filter_token(df: DataFrame, column: str, token_value: str, salt: str) -> DataFrame:
    """Rows of a raw table whose value has the given token.

    The value itself is not in the plan; every row is hashed, so this scans.
    """
    dtype = df.schema[column].dataType
    return df.where(f"{token(pii_text(name(column), dtype), salt)} = {lit(token_value)}")


def _equals(df: DataFrame, column: str, value: Any, profile: Profile | None) -> Column:
    if column not in df.columns:
        raise RequestError(f"no column '{column}'")
    check_literal(value)
    dtype = df.schema[column].dataType
    if value is None:
        unknown = profile is not None and profile.null_filter == "unknown"
        return F.lit(None).cast("boolean") if unknown else col(column).isNull()
    text = isinstance(dtype, STRINGS)
    if isinstance(value, str):
        return col(column) == (F.lit(value) if text else F.lit(value).cast(dtype))
    if isinstance(value, bool) != isinstance(dtype, T.BooleanType):
        if isinstance(value, bool) or not text:
            raise RequestError(f"column '{column}' is {dtype.simpleString()}, the filter value is {type(value).__name__}")
    # a number is never narrowed to the column's type: 1.5 must not match 1
    return col(column) == (F.lit(str(value)) if text else F.lit(value))


def aggregate(
    df: DataFrame,
    aggregations: list[str] | list[Aggregate],
    group_by: list[str] | tuple[str, ...] = (),
    sort_arrays: bool = True,
) -> DataFrame:
    """Aggregates first, then group columns.  Partial sums are built map-side."""
    wanted = [parse_aggregate(a) if isinstance(a, str) else a for a in aggregations]
    missing = [c for c in [a.column for a in wanted] + list(group_by) if c != "*" and c not in df.columns]
    if missing:
        raise RequestError(f"no column {missing}")
    columns = [_aggregate(df, a, sort_arrays).alias(a.alias) for a in wanted]
    if not group_by:
        return df.agg(*columns)
    names = [a.alias for a in wanted] + list(group_by)
    if len(set(names)) < len(names):
        raise RequestError(f"result columns are not distinct: {names}")
    return df.groupBy(*[col(g) for g in group_by]).agg(*columns).select(*[col(n) for n in names])


def _aggregate(df: DataFrame, a: Aggregate, sort_arrays: bool) -> Column:
    if a.column == "*":
        return F.count(F.lit(1))
    c = col(a.column)
    if a.function == "ARRAY_AGG":
        # boxed, because nulls belong to the result and collect_list drops them
        boxed = F.collect_list(F.struct(c.alias("v")))
        values = F.transform(boxed, lambda b: b["v"])
        return F.array_sort(values) if sort_arrays else values
    if a.function in ("BOOL_AND", "BOOL_OR", "EVERY"):
        b = c if isinstance(df.schema[a.column].dataType, T.BooleanType) else c.cast("boolean")
        return {"BOOL_AND": F.bool_and, "BOOL_OR": F.bool_or, "EVERY": F.every}[a.function](b)
    if a.function == "APPROX_PERCENTILE":
        return F.percentile_approx(c, F.lit(a.percentile))
    if a.function == "ARBITRARY":
        return F.any_value(c, ignoreNulls=True)
    plain = {
        "COUNT": F.count,
        "SUM": F.sum,
        "AVG": F.avg,
        "MIN": F.min,
        "MAX": F.max,
        "STDDEV": F.stddev,
        "VARIANCE": F.variance,
        "APPROX_DISTINCT": F.approx_count_distinct,
    }
    return plain[a.function](c)


def array_rows(df: DataFrame, column: str, group_by: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """The arrays of ``ARRAY_AGG`` in long form: group columns, ``position`` (from 1, nulls last), ``column``; no group lies in one row or one task.

    Equal values of a group are counted map-side. Ranges of the order of groups and values are
    kept in the shared folder, and within a group positions follow from the sums of earlier ranges.
    """
    if "position" in (column, *group_by):
        raise RequestError("a column is named 'position'")
    groups = [col(g) for g in group_by]
    counted = df.groupBy(*groups, col(column)).agg(F.count(F.lit(1)).alias("__n"))
    order = [*[g.asc_nulls_first() for g in groups], col(column).asc_nulls_last()]
    ranged = reliable_copy(counted.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = before(Window.partitionBy("__part", *groups).orderBy(col(column).asc_nulls_last()))
    sums = ranged.groupBy("__part", *groups).agg(F.sum("__n").alias("__s"))
    earlier = F.sum("__s").over(before(Window.partitionBy(*groups).orderBy("__part")))  # a row for each range of a group
    sums = sums.select(F.col("__part").alias("__p"), *[col(g).alias(f"__g{i}") for i, g in enumerate(group_by)], F.coalesce(earlier, F.lit(0)).alias("__earlier"))
    same = reduce(Column.__and__, [F.col(f"__g{i}").eqNullSafe(g) for i, g in enumerate(groups)], F.col("__part") == F.col("__p"))
    placed = ranged.withColumn("__in", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(sums, same)
    blocks = placed.withColumn("__b", F.explode(F.expr("sequence(0L, (__n - 1) DIV 4096)")))
    each = blocks.withColumn("__r", F.explode(F.expr("sequence(1L, least(4096L, __n - __b * 4096))")))
    return each.select(*groups, (F.col("__earlier") + F.col("__in") + F.col("__b") * 4096 + F.col("__r")).cast("long").alias("position"), col(column))


def order_limit(
    df: DataFrame, order_by: list[str] | tuple[str, ...] | list[SortKey], limit: int | None, profile: Profile
) -> DataFrame:
    """Sort (nulls placed as the backend does) and cut; both together are one top-k."""
    keys = [parse_sort(o) if isinstance(o, str) else o for o in order_by]
    missing = [k.column for k in keys if k.column not in df.columns]
    if missing:
        raise RequestError(f"no column {missing} to order by")
    if keys:
        df = df.orderBy(*[profile.sort(k.column, k.descending, k.nulls) for k in keys])
    return df if limit is None else df.limit(limit)
