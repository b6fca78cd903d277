"""The column catalog: every column of every table with its name label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.functions.names import match_reason, name_category, name_sensitivity, sensitivity_rank
from cloakframe.functions.sql import lit
from cloakframe.functions.sql import name as quoted
from cloakframe.rules import DEFAULT_RULES, SENSITIVITY_RANK, Rules

COLUMNS_SCHEMA = (
    "database string, table string, description string, column_name string, data_type string, "
    "nullable boolean, is_partition boolean, comment string, position int"
)


def columns_of(spark: SparkSession, tables: dict[str, DataFrame], database: str = "default") -> DataFrame:
    """Unlabelled catalog rows of given DataFrames, from their schemas."""
    rows = [
        (database, name, "", f.name, f.dataType.simpleString(), f.nullable, False, f.metadata.get("comment", ""), i)
        for name, df in tables.items()
        for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, COLUMNS_SCHEMA)


def columns_of_database(spark: SparkSession, database: str, table: str | None = None) -> DataFrame:
    """Unlabelled catalog rows of a database of the session catalog.

    Partition columns are included.  The catalog API answers on the driver, so
    this reads metadata only; for very large catalogs read the catalog's own
    column table and use ``columns_of_information_schema``.
    """
    rows = []
    for t in spark.catalog.listTables(database):
        if table is not None and t.name.lower() != table.lower():
            continue
        full = f"{database}.{t.name}" if not t.isTemporary else t.name
        for i, c in enumerate(spark.catalog.listColumns(full)):
            rows.append(
                (database, t.name, t.description or "", c.name, c.dataType, c.nullable, c.isPartition, c.description or "", i)
            )
    return spark.createDataFrame(rows, COLUMNS_SCHEMA)


def columns_of_information_schema(
    df: DataFrame, database: str = "table_schema", nullable_word: str = "YES"
) -> DataFrame:
    """Unlabelled catalog rows from an ``information_schema.columns`` table of any backend."""
    have = {c.lower(): c for c in df.columns}

    def pick(name: str, default: Column) -> Column:
        return F.col(have[name]) if name in have else default

    return df.select(
        pick(database, F.lit("default")).alias("database"),
        F.col(have["table_name"]).alias("table"),
        F.lit("").alias("description"),
        F.col(have["column_name"]).alias("column_name"),
        F.col(have["data_type"]).alias("data_type"),
        (F.upper(pick("is_nullable", F.lit(nullable_word))) == nullable_word).alias("nullable"),
        (F.upper(pick("is_partitioning_column", F.lit("NO"))) == "YES").alias("is_partition"),
        F.coalesce(pick("comment", F.lit("")), F.lit("")).alias("comment"),
        pick("ordinal_position", F.lit(0)).cast("int").alias("position"),
    )


def label_columns(
    df: DataFrame, rules: Rules = DEFAULT_RULES, backend: str | None = None, name: str = "column_name"
) -> DataFrame:
    """Add ``is_pii, pii_sensitivity, pii_category, match_reason`` for a column of names.

    Row-local: the rules are part of the expression, so there is no join.
    """
    reason = match_reason(name, rules, None if backend is None else lit(backend))
    return df.selectExpr("*", f"{reason} AS match_reason").selectExpr(
        *df.columns,
        "match_reason IS NOT NULL AS is_pii",
        f"{name_sensitivity(name, 'match_reason')} AS pii_sensitivity",
        f"{name_category(name, 'match_reason')} AS pii_category",
        "match_reason",
    )


def column_catalog(
    columns: DataFrame, rules: Rules = DEFAULT_RULES, backend: str | None = None, table: str | None = None
) -> DataFrame:
    """The labelled catalog, optionally of one table."""
    chosen = columns if table is None else columns.where(F.lower("table") == table.lower())
    return label_columns(chosen, rules, backend)


def up_to_sensitivity(catalog: DataFrame, level: str) -> DataFrame:
    """Catalog rows whose sensitivity is at most the level."""
    return catalog.where(f"{sensitivity_rank('pii_sensitivity')} <= {SENSITIVITY_RANK[level]}")


def label_tables(catalog: DataFrame) -> DataFrame:
    """One row per table: does it hold personal data by name, and in which columns."""

    def names(keep: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(keep, F.col("column_name"))))

    level = F.col("pii_sensitivity")
    return catalog.groupBy("database", "table").agg(
        F.bool_or("is_pii").alias("has_pii"),
        names(F.col("is_pii")).alias("pii_columns"),
        names(level == "critical").alias("critical_columns"),
        names(level.isin("critical", "high")).alias("high_columns"),
    )


def list_tables(catalog: DataFrame, database: str | None = None) -> DataFrame:
    chosen = catalog if database is None else catalog.where(F.col("database") == database)
    return chosen.select(F.col("table").alias("table_name")).distinct().orderBy("table_name")


def list_databases(catalog: DataFrame) -> DataFrame:
    return catalog.select(F.col("database").alias("database_name")).distinct().orderBy("database_name")


def search_tables(
    catalog: DataFrame, text: str, database: str | None = None, limit: int | None = None
) -> DataFrame:
    """Tables whose name contains the text, sorted; with ``limit`` the first of them."""
    chosen = catalog.where(F.lower("table").contains(text.lower()))
    if database is not None:
        chosen = chosen.where(F.col("database") == database)
    hits = chosen.select("database", "table", "description").distinct().orderBy("database", "table")
    return hits if limit is None else hits.limit(limit)


def answer_intent(catalog: DataFrame, intent: str, entity: str | None = None, database: str | None = None) -> DataFrame:
    """Metadata question in words: databases, tables, or the columns of a table."""
    words = intent.lower()
    if "database" in words or "catalog" in words:
        return list_databases(catalog)
    if "table" in words:
        return list_tables(catalog, entity or database)
    if "column" in words or "schema" in words:
        if not entity:
            raise ValueError("a table name is needed to look up columns")
        chosen = catalog.where(F.col("table") == entity)
        if database is not None:
            chosen = chosen.where(F.col("database") == database)
        return chosen.orderBy("position").select("column_name", "data_type", "is_pii", "pii_sensitivity")
    raise ValueError("the intent must ask for databases, tables or columns")


def safe_columns(df: DataFrame, rules: Rules = DEFAULT_RULES, backend: str | None = None) -> DataFrame:
    """The table without the columns whose names mark personal data."""
    named = set(rules.named_pii(df.columns, backend))
    return df.select(*[quoted(c) for c in df.columns if c not in named])


def columns_up_to(
    df: DataFrame, level: str, rules: Rules = DEFAULT_RULES, backend: str | None = None
) -> DataFrame:
    """The table with only the columns of at most the given name sensitivity."""
    most = SENSITIVITY_RANK[level]
    keep = [c for c in df.columns if SENSITIVITY_RANK[rules.label(c, backend).sensitivity] <= most]
    return df.select(*[quoted(c) for c in keep])
