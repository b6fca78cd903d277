"""Profiling tables for personal data: which columns hold what, in how many rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.functions.sql import lit, name
from cloakframe.operators.fields import Scope, fields
from cloakframe.rules import DEFAULT_RULES, Rules

#: Cells (place and type) whose hits are the bits of one number, and how many are counted row by row.
_BITS, _AT_ONCE = 60, 240


def profile_table(
    df: DataFrame,
    rules: Rules = DEFAULT_RULES,
    columns: list[str] | None = None,
    scope: Scope = Scope(),
) -> DataFrame:
    """Rows ``(path, column, pii_type, n_rows, rows_scanned)``, one per place and type.

    One scan of any number of columns. A row's hits are bits of a few numbers, so each guard
    and pattern is tested once, and the bits are counted in partial aggregates: map-side partial
    counts, one row per task to exchange, whatever the size or skew of the table. Columns that are not scanned give one row with a null type.
    """
    counters, cells = count_columns(df, rules, scope, columns)
    return unfold_counts(counters(df, []), cells)


def count_columns(
    df: DataFrame, rules: Rules = DEFAULT_RULES, scope: Scope = Scope(), columns: list[str] | None = None
) -> tuple[Callable[[DataFrame, list[str]], DataFrame], list[tuple[str, str, str, str]]]:
    """A function (rows, keys) to the counters of cells and ``rows_scanned`` for each value of the keys; and the cells for ``unfold_counts``."""
    places = fields(df.schema, scope, columns)
    rest = [c for c in columns or df.columns if c not in {p.column for p in places}]
    n_types = len(rules.detections)
    n_words = -(-len(places) * n_types // _BITS)
    words: list[list[str]] = [[] for _ in range(n_words)]
    for i, p in enumerate(places):
        for guard, tests in p.tests(rules, scope):
            for w, group in groupby(tests, key=lambda t: (i * n_types + t[0]) // _BITS):
                bits = " | ".join(f"IF({test}, {1 << (i * n_types + j) % _BITS}L, 0L)" for j, test in group)
                words[w].append(f"IF({guard}, {bits}, 0L)" if guard else f"({bits})")
    masks = [" | ".join(w) or "0L" for w in words]
    named = [f"__w{w}" for w in range(n_words)]
    tested = {i * n_types + j for i, p in enumerate(places) for _, tests in p.tests(rules, scope) for j, _ in tests}

    def counters(rows: DataFrame, keys: list[str]) -> DataFrame:
        by = [name(k) for k in keys]
        seen = rows.selectExpr(*by, *[f"{m} AS {w}" for m, w in zip(masks, named, strict=True)])
        wide = len(tested) > _AT_ONCE
        if wide:  # rows of equal bits are counted together first
            seen = seen.groupBy(*by, *named).agg(F.count(F.lit(1)).alias("__n"))
        bit = lambda c: f"({named[c // _BITS]} & {1 << c % _BITS}L) <> 0"
        count = (lambda test: F.expr(f"coalesce(sum(IF({test}, __n, 0L)), 0L)")) if wide else (lambda test: F.expr(f"count_if({test})"))
        return seen.groupBy(*by).agg(count("true").alias("rows_scanned"), *[count(bit(c)).alias(f"__c{c}") for c in sorted(tested)])

    cells = [
        (p.path, p.column, lit(d.name), f"__c{i * n_types + j}" if i * n_types + j in tested else "0L")
        for i, p in enumerate(places)
        for j, d in enumerate(rules.detections)
    ]
    return counters, cells + [(c, c, "CAST(NULL AS STRING)", "0L") for c in rest]


def unfold_counts(totals: DataFrame, cells: list[tuple[str, str, str, str]]) -> DataFrame:
    """One row of counters as profile rows; cells are (path, column, type, count)."""
    rows = [
        f"struct({lit(path)} AS path, {lit(column)} AS column, {kind} AS pii_type, {n} AS n_rows)"
        for path, column, kind, n in cells
    ]
    unfolded = totals.selectExpr("rows_scanned", f"inline(array({', '.join(rows)}))")
    return unfolded.select("path", "column", "pii_type", "n_rows", "rows_scanned")


def profile_tables(
    tables: dict[str, DataFrame], rules: Rules = DEFAULT_RULES, scope: Scope = Scope()
) -> DataFrame:
    """Profiles of several tables under one another, with the table name first."""
    parts = [profile_table(df, rules, scope=scope).select(F.lit(n).alias("table"), "*") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def table_findings(df: DataFrame, rules: Rules = DEFAULT_RULES, scope: Scope = Scope()) -> DataFrame:
    """One row: ``has_pii``, all ``pii_types`` and a map column → types."""
    hits = profile_table(df, rules, scope=scope).where("n_rows > 0")
    by_column = hits.groupBy("column").agg(F.array_sort(F.collect_set("pii_type")).alias("types"))
    return by_column.agg(
        (F.count(F.lit(1)) > 0).alias("has_pii"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))).alias("pii_types"),
        F.map_from_entries(F.collect_list(F.struct("column", "types"))).alias("column_types"),
    )


def find_spans(
    df: DataFrame,
    keys: list[str],
    columns: list[str] | None = None,
    rules: Rules = DEFAULT_RULES,
    scope: Scope = Scope(),
) -> DataFrame:
    """One row per found value: the keys, the path it was found at, and the span."""
    chosen = [f for f in fields(df.schema, scope, columns) if f.column not in keys]
    if not chosen:
        raise ValueError("no column to scan")
    per_path = [f"struct({lit(f.path)} AS path, {f.spans(rules, scope)} AS found)" for f in chosen]
    quoted = [name(k) for k in keys]
    return df.selectExpr(*quoted, f"inline(array({', '.join(per_path)}))").selectExpr(*quoted, "path", "inline(found)")


def supported_types(spark: SparkSession, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """The detections as a table: name, pattern, sensitivity, action, description."""
    rows = [(i, d.name, d.pattern, d.sensitivity, d.default_action, d.description) for i, d in enumerate(rules.detections)]
    return spark.createDataFrame(
        rows, "position int, pii_type string, pattern string, sensitivity string, default_action string, description string"
    )
