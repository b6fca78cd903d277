"""Backend profiles: where tables come from and the habits of each warehouse.

All data is read by Spark.  A profile only says how a table name becomes a
DataFrame and how that warehouse treats nulls, null order and result types.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Loader = Callable[[SparkSession, str], DataFrame]


# -- loaders ----------------------------------------------------------------
def catalog_tables(database: str | None = None) -> Loader:
    """Tables of the session catalog (any catalog plugged into Spark)."""
    return lambda spark, entity: spark.table(f"{database}.{entity}" if database else entity)


def file_tables(root: str, fmt: str = "parquet", names: dict[str, str] | None = None, suffix: str = ".parquet") -> Loader:
    """Files ``<root>/<name><suffix>``; ``names`` maps entity names to file names."""

    def load(spark: SparkSession, entity: str) -> DataFrame:
        return spark.read.format(fmt).load(f"{root}/{(names or {}).get(entity, entity)}{suffix}")

    return load


def connector_tables(fmt: str, table_option: str = "dbtable", **options: str) -> Loader:
    """Tables behind a Spark connector (``jdbc``, ``snowflake``, ``bigquery`` …).

    Filters, columns and limits are pushed down by the connector.
    """
    return lambda spark, entity: spark.read.format(fmt).options(**options).option(table_option, entity).load()


# -- profiles ---------------------------------------------------------------
@dataclass(frozen=True)
class Profile:
    """Habits of one backend.

    ``null_filter``: does a filter on null mean "is null" (``is_null``) or is it
    unknown and keeps no row (``unknown``)?  ``null_order``: nulls ``last`` always,
    as the ``largest`` or as the ``smallest`` value.  ``kind``: ``table`` backends
    answer queries, ``object`` and ``catalog`` ones only list.
    """

    name: str
    keywords: dict[str, str] = field(default_factory=dict)
    allowed_tables: frozenset[str] | None = None
    null_filter: str = "is_null"
    null_order: str = "smallest"
    text_results: bool = False
    kind: str = "table"
    loader: Loader = field(default_factory=catalog_tables)

    def with_tables(self, loader: Loader, allowed: set[str] | None = None) -> Profile:
        """The same habits over other tables; ``allowed`` replaces the allow-list."""
        return replace(self, loader=loader, allowed_tables=self.allowed_tables if allowed is None else frozenset(allowed))

    def scan(self, spark: SparkSession, entity: str) -> DataFrame:
        if self.allowed_tables is not None and entity.lower() not in self.allowed_tables:
            raise ValueError(f"table '{entity}' is not allowed for {self.name}: {sorted(self.allowed_tables)}")
        return self.loader(spark, entity)

    def infer_entity(self, intent: str) -> str:
        words = intent.lower()
        for keyword, table in self.keywords.items():
            if keyword in words:
                return table
        raise ValueError("no table can be inferred from the intent; name the entity")

    def sort(self, name: str, descending: bool, nulls: str | None) -> Column:
        if nulls is None:
            if self.null_order == "last":
                nulls = "last"
            elif self.null_order == "largest":
                nulls = "first" if descending else "last"
            else:
                nulls = "last" if descending else "first"
        c = F.col(f"`{name}`")
        if descending:
            return c.desc_nulls_first() if nulls == "first" else c.desc_nulls_last()
        return c.asc_nulls_first() if nulls == "first" else c.asc_nulls_last()

    def render(self, df: DataFrame) -> DataFrame:
        """Results as the backend returns them (some return text only)."""
        if not self.text_results:
            return df
        nested = ("array", "map", "struct")
        return df.select(
            *[
                (F.to_json(F.col(f"`{c}`")) if t.startswith(nested) else F.col(f"`{c}`").cast("string")).alias(c)
                for c, t in df.dtypes
            ]
        )


# Keyword → table per backend (the first keyword found decides) and
# the tables two backends allow.
_COMMON = {
    "customer": "customers",
    "user": "users",
    "order": "orders",
    "product": "products",
    "transaction": "transactions",
}
_KEYWORDS = {
    "snowflake": {**_COMMON, "sale": "sales", "inventory": "inventory"},
    "databricks": {**_COMMON, "sale": "sales", "event": "events", "log": "logs"},
    "trino": {**_COMMON, "sale": "sales", "metric": "metrics", "event": "events"},
    "bigquery": {**_COMMON, "event": "events", "analytics": "analytics", "log": "logs"},
    "athena": {**_COMMON, "log": "logs", "event": "events", "click": "clickstream"},
}
# Tables that may be asked for.
_TRINO_TABLES = frozenset(
    ("customers", "users", "orders", "products", "transactions", "sales", "metrics", "events", "inventory", "logs")
)
_ATHENA_TABLES = frozenset(
    ("customers", "users", "orders", "products", "transactions", "sales", "logs", "events", "clickstream", "inventory")
)

_PROFILES: dict[str, Profile] = {
    p.name: p
    for p in (
        Profile("snowflake", _KEYWORDS["snowflake"], null_filter="unknown", null_order="largest"),
        Profile("databricks", _KEYWORDS["databricks"], null_filter="unknown"),
        Profile("trino", _KEYWORDS["trino"], _TRINO_TABLES, null_order="last"),
        Profile("bigquery", _KEYWORDS["bigquery"]),
        Profile("gcs", kind="object"),
        Profile("athena", _KEYWORDS["athena"], _ATHENA_TABLES, null_order="last", text_results=True),
        Profile("s3", kind="object"),
        Profile("glue", kind="catalog"),
    )
}


def register_profile(profile: Profile) -> None:
    """Add or replace a backend."""
    _PROFILES[profile.name.lower()] = profile


def backends() -> list[str]:
    return list(_PROFILES)


def get_profile(name: str) -> Profile:
    profile = _PROFILES.get(name.lower())
    if profile is None:
        raise ValueError(f"unknown backend '{name}', choose one of {backends()}")
    return profile
