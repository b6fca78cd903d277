"""Linking tables in which a few tokens hold much of the rows.

1. A bounded sketch of each side names its frequent tokens. What it names changes only how rows
   are dealt, never the result.
2. Rows of all other tokens meet in a plain equi-join.
3. Equal rows of a frequent token are counted into one, and the counts split again over the lines
   of a grid. A left row lies in one line of it and all columns, a right row in one column and all
   lines, so each pair meets in exactly one cell and the token's work spreads over all of them.
   Lines and columns come from a hash of the row, so a task that is run again deals alike.
4. Who needs only numbers and sums of the pairs gets them without the pairs: each side is summed by
   token and group first, and the sums meet in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.functions.tokens import NULL_TOKEN

#: Counters of the sketch, and the largest number of tokens taken from it (their names are part of the plan).
TRACKED, MOST = 1 << 14, 256


def frequent_tokens(df: DataFrame, column: str, share: float, most: int = MOST) -> list[str]:
    """Tokens that hold about ``share`` of the rows or more, at most ``most``, by a sketch of bounded size (one pass, partial sketches a task)."""
    real = df.where(F.col(column).isNotNull() & (F.col(column) != NULL_TOKEN)).select(F.col(column).cast("string").alias("t"))
    row = real.agg(F.expr(f"approx_top_k(t, {most}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    return sorted(item["item"] for item in row["top"] or [] if item["count"] >= max(2.0, share * row["n"]))


def _grid(df: DataFrame, side: str, other: str, cells: int) -> DataFrame:
    """Equal rows counted, their number split over the places of their own side of the grid, with every place of the other."""
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__all"))
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if not _holds_map(f.dataType)]
    parts = counted.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("__all"), F.lit(cells)) - 1)))
    n = F.expr(f"__all DIV {cells} + IF(__k < __all % {cells}, 1, 0)")
    placed = parts.withColumn(f"__{side}_n", n).withColumn(f"__{side}", F.pmod(F.xxhash64(*plain) + F.col("__k"), F.lit(cells)))
    return placed.drop("__all", "__k").withColumn(f"__{other}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))


def _repeated(df: DataFrame, n: str) -> DataFrame:
    """Each row as often as ``n`` says, by short arrays whatever the number."""
    step = 4096
    blocks = df.withColumn("__b", F.explode(F.expr(f"sequence(0L, ({n} - 1) DIV {step})")))
    return blocks.withColumn("__r", F.explode(F.expr(f"sequence(1L, least({step}L, {n} - __b * {step}))"))).drop("__b", "__r", n)


def _holds_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_holds_map(f.dataType) for f in dtype.fields)
    return isinstance(dtype, T.MapType) or (isinstance(dtype, T.ArrayType) and _holds_map(dtype.elementType))


def link_heavy(
    left: DataFrame, right: DataFrame, on: str, right_on: str | None = None, share: float = 0.001, cells: int = 16,
    by: list[str] | None = None, sums: dict[str, str] | None = None,
) -> DataFrame:
    """The same rows as an inner ``link``, with tokens that hold ``share`` of either side dealt over ``cells`` x ``cells`` tasks.

    With ``by``, instead of the rows their number ``n`` and the ``sums`` (name: a column of whole numbers of either side)
    by columns of either side. No pair of rows is then made.
    """
    other = right_on or on
    real = lambda df, key: df.where(F.col(key).isNotNull() & (F.col(key) != NULL_TOKEN))
    keyed = real(right, other).withColumnRenamed(other, "__token")
    clash = set(left.columns) & set(keyed.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    left = real(left, on)
    heavy = sorted({*frequent_tokens(left, on, share), *frequent_tokens(keyed, "__token", share)})
    return _met(left, keyed, on, heavy, cells) if by is None else _totals(left, keyed, on, heavy, cells, by, sums or {})


def _met(left: DataFrame, keyed: DataFrame, on: str, heavy: list[str], cells: int) -> DataFrame:
    """The rows of both sides that meet: plainly, and for heavy tokens in the cells of a grid."""
    same = F.col(on) == F.col("__token")
    columns: list[Column] = [F.col(f"`{c}`") for c in (*left.columns, *(c for c in keyed.columns if c != "__token"))]
    if not heavy:
        return left.join(keyed, same).select(*columns)
    rest = left.where(~F.col(on).isin(heavy)).join(keyed.where(~F.col("__token").isin(heavy)), same)
    a = _grid(left.where(F.col(on).isin(heavy)), "line", "column", cells)
    b = _grid(keyed.where(F.col("__token").isin(heavy)).withColumnRenamed("__token", "__other"), "column", "line", cells)
    met = a.join(b.withColumnRenamed("__line", "__b_line").withColumnRenamed("__column", "__b_column"), (F.col(on) == F.col("__other")) & (F.col("__line") == F.col("__b_line")) & (F.col("__column") == F.col("__b_column")))
    met = met.select(*columns, "__line_n", "__column_n")
    return rest.select(*columns).unionByName(_repeated(_repeated(met, "__line_n"), "__column_n"))


def _totals(left: DataFrame, keyed: DataFrame, on: str, heavy: list[str], cells: int, by: list[str], sums: dict[str, str]) -> DataFrame:
    """Number and sums of the rows that meet. Each side is first summed by token and its own columns of ``by``: a row of one side counts as often as rows of the other meet it."""
    whole = {f.name for df in (left, keyed) for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)}
    wrong = (set(by) - {*left.columns, *keyed.columns}) | (set(sums.values()) - whole)
    if wrong:
        raise ValueError(f"not columns, or not of whole numbers: {sorted(wrong)}")
    sides = []
    for df, token, count in ((left, on, "__left_rows"), (keyed, "__token", "__right_rows")):
        parts = [F.sum(f"`{c}`").alias(f"__sum_{i}") for i, c in enumerate(sums.values()) if c in df.columns]
        sides.append(df.groupBy(token, *[f"`{c}`" for c in by if c in df.columns and c != token]).agg(F.count(F.lit(1)).alias(count), *parts))
    met = _met(sides[0], sides[1], on, heavy, cells)
    n = F.coalesce(F.sum(F.col("__left_rows") * F.col("__right_rows")), F.lit(0).cast("long")).alias("n")
    times = lambda c: F.col("__right_rows" if c in left.columns else "__left_rows")
    return met.groupBy(*[f"`{c}`" for c in by]).agg(n, *[F.sum(F.col(f"__sum_{i}") * times(c)).alias(name) for i, (name, c) in enumerate(sums.items())])
