"""Registered queries and their SQL twins.

``queries()`` runs every operator over whole tables; ``oracle_sql()`` says the
same in plain SQL (see ``oracles.py``).
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import oracles as o  # noqa: E402
import table_queries  # noqa: E402
from cloakframe.functions.detect import has_pii, has_type  # noqa: E402
from cloakframe.functions.mask import mask  # noqa: E402
from cloakframe.functions.sqlnames import register_sql_functions  # noqa: E402
from cloakframe.functions.tokens import is_token, lookup_token  # noqa: E402
from cloakframe.operators import audit, linkage, screen  # noqa: E402
from cloakframe.operators.profile import find_spans, profile_table, profile_tables  # noqa: E402
from cloakframe.operators.protect import hash_table, hash_where, redact_table, redact_with_types  # noqa: E402
from cloakframe.operators.relational import aggregate, filter_equal, order_limit  # noqa: E402
from cloakframe.plans.policy import apply_policy, decisions, ensure_checkpoint_dir  # noqa: E402
from cloakframe.plans.request import DANGEROUS_VALUES, SQL_PATTERNS, Request  # noqa: E402
from cloakframe.plans.secure import Settings, secure_query  # noqa: E402
from cloakframe.rules import DEFAULT_RULES  # noqa: E402
from cloakframe.sources import catalog, inventory  # noqa: E402
from cloakframe.sources.files import read_table, stream_table  # noqa: E402
from cloakframe.sources.profiles import file_tables, get_profile  # noqa: E402
from cloakframe.streaming.protect import append_stream, protect_stream, quarantine_stream  # noqa: E402
from cloakframe.streaming.windows import counts_stream, latest_counts  # noqa: E402

try:  # the training-data operators are an optional part
    from cloakframe.llm import registry as llm
except ImportError:
    llm = None

TESTDATA = "/root/testdata"
SALT = "entry-salt-for-checks"
TABLES = list(o.SCHEMAS)
TEXT_TABLES = ["documents", "pages", "conversations", "events"]
ENTITIES = {"customers": "customer", "sales": "lineitem", "products": "part"}
Query = Callable[[SparkSession, str], DataFrame]

# A line with a value of every type, from the keys of an order (valid in both engines).
CONTACT = """concat_ws(' ',
  'mail', concat('user', CAST(o_custkey AS STRING), '@shop.example.com'),
  'tel', concat('(', CAST(o_custkey % 900 + 100 AS STRING), ') 555-', lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0')),
  'intl', concat('+49', CAST(o_custkey + 1000000 AS STRING)),
  'ssn', concat(lpad(CAST(o_custkey % 1000 AS STRING), 3, '0'), '-', lpad(CAST(o_orderkey % 100 AS STRING), 2, '0'), '-',
                lpad(CAST(o_custkey % 10000 AS STRING), 4, '0')),
  'iban', concat('DE', lpad(CAST(o_orderkey % 100 AS STRING), 2, '0'), '37040044', lpad(CAST(o_custkey AS STRING), 10, '0')),
  'card', concat('411111111', lpad(CAST(o_orderkey AS STRING), 7, '0')),
  'ip', concat('10.', CAST(o_custkey % 256 AS STRING), '.', CAST(o_orderkey % 256 AS STRING), '.1'),
  'born', concat('01/02/19', lpad(CAST(o_custkey % 100 AS STRING), 2, '0')))"""
VALUES = {  # one value per type, from a customer key
    "email": "concat('user', CAST(c_custkey AS STRING), '@example.com')",
    "phone": "concat('555-123-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'))",
    "phone_international": "concat('+49', CAST(c_custkey + 1000 AS STRING))",
    "ssn": "concat('123-45-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'))",
    "iban": "concat('DE8937040044', lpad(CAST(c_custkey AS STRING), 10, '0'))",
    "credit_card": "concat('411111111', lpad(CAST(c_custkey AS STRING), 7, '0'))",
    "ip_address": "concat('10.0.0.', CAST(c_custkey % 256 AS STRING))",
    "date_of_birth": "concat('01/02/19', lpad(CAST(c_custkey % 100 AS STRING), 2, '0'))",
}
# Texts of which some hold an injection pattern (valid in both engines).
_SCREENED = """concat(text, CASE doc_id % 11 WHEN 1 THEN '; --' WHEN 2 THEN '; drop' WHEN 3 THEN '/*' WHEN 4 THEN '*/' WHEN 5 THEN ' xp_cmd'
  WHEN 6 THEN ' EXEC x' WHEN 7 THEN ' execute y' WHEN 8 THEN ' executes' ELSE '' END)"""
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table whose rows are costly to scan; a session may name how many tasks to deal it out to."""
    partitions = spark.conf.get("spark.cloakframe.readPartitions", None)
    return read_table(spark, f"{sf}/{name}.parquet", partitions=None if partitions is None else int(partitions))


def all_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {n: texts(spark, sf, n) if n == "documents" else t(spark, sf, n) for n in TABLES}


def joined(c: str) -> F.Column:
    return F.array_join(c, ",")


def stamp(c: str) -> F.Column:
    return F.date_format(c, STAMP)


def cents(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 2) for n in names})


# -- masking and detection ------------------------------------------------------
def redact_documents(spark: SparkSession, sf: str) -> DataFrame:
    found = redact_with_types(texts(spark, sf, "documents"), "text")
    return found.select("doc_id", "text", joined("pii_types").alias("pii_types"))


def redact_pages(spark: SparkSession, sf: str) -> DataFrame:
    return apply_policy(texts(spark, sf, "pages"), "mask").df


def redact_contacts(spark: SparkSession, sf: str) -> DataFrame:
    lines = texts(spark, sf, "orders").select("o_orderkey", F.expr(CONTACT).alias("line"))
    return redact_with_types(lines, "line").select("o_orderkey", "line", joined("pii_types").alias("pii_types"))


def _nested(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf, "pages").select(
        "page_id", F.struct("url", F.array("html", "url").alias("parts"), F.create_map(F.lit("html"), "html").alias("m")).alias("page")
    )


def nested_spans(spark: SparkSession, sf: str) -> DataFrame:
    return _span_columns(find_spans(_nested(spark, sf), ["page_id"], ["page"]), "page_id")


def nested_profile(spark: SparkSession, sf: str) -> DataFrame:
    return profile_table(_nested(spark, sf), columns=["page"]).select("path", "pii_type", "n_rows", "rows_scanned")


def redact_nested(spark: SparkSession, sf: str) -> DataFrame:
    out = redact_table(_nested(spark, sf), ["page"])
    return out.select(
        "page_id",
        F.col("page.url").alias("url"),
        F.col("page.parts")[0].alias("part_0"),
        F.col("page.parts")[1].alias("part_1"),
        F.col("page.m")["html"].alias("m_html"),
    )


def redact_sql_function(spark: SparkSession, sf: str) -> DataFrame:
    register_sql_functions(spark, SALT)
    texts(spark, sf, "documents").createOrReplaceTempView("cloak_documents")
    return spark.sql(
        "SELECT doc_id, pii_redact(text) AS text, pii_has(text) AS has_pii, pii_token(source) AS source FROM cloak_documents"
    )


def mask_known_types(spark: SparkSession, sf: str) -> DataFrame:
    c = t(spark, sf, "customer")
    return c.select("c_custkey", *[F.expr(mask(f"({v})", k)).alias(k) for k, v in VALUES.items()])


def pii_spans(spark: SparkSession, sf: str) -> DataFrame:
    return _span_columns(find_spans(texts(spark, sf, "documents"), ["doc_id"], ["text"]), "doc_id")


def pii_spans_contacts(spark: SparkSession, sf: str) -> DataFrame:
    lines = texts(spark, sf, "orders").select("o_orderkey", F.expr(CONTACT).alias("line"))
    return _span_columns(find_spans(lines, ["o_orderkey"], ["line"]), "o_orderkey")


def _span_columns(df: DataFrame, key: str) -> DataFrame:
    return df.select(
        key, "path", "type", "value", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "sensitivity",
        "default_action",
    )


def pii_profile(spark: SparkSession, sf: str) -> DataFrame:
    found = profile_tables(all_tables(spark, sf))
    return found.select(F.col("table").alias("tbl"), "path", "pii_type", "n_rows", "rows_scanned")


def clean_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Row-level deny: the documents without personal data."""
    return texts(spark, sf, "documents").where(f"NOT {has_pii('text')}").select("doc_id", "lang", "n_chars")


def result_summary(spark: SparkSession, sf: str) -> DataFrame:
    parts = []
    for name in ("documents", "pages", "customer", "orders"):
        s = apply_policy(t(spark, sf, name), "mask").summary
        parts.append(s.withColumn("tbl", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(
        "tbl", "row_count", joined("columns").alias("column_names"), "policy_applied", "pii_detected",
        joined("columns_processed").alias("columns_processed"), joined("pii_types").alias("pii_types"),
    )


# -- tokens -----------------------------------------------------------------------
def hash_documents_policy(spark: SparkSession, sf: str) -> DataFrame:
    return apply_policy(texts(spark, sf, "documents"), "hash", salt=SALT).df


def hash_customer_policy(spark: SparkSession, sf: str) -> DataFrame:
    return apply_policy(t(spark, sf, "customer"), "hash", salt=SALT).df.drop("c_acctbal")


def token_customer(spark: SparkSession, sf: str) -> DataFrame:
    c = t(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", F.expr("nullif(c_mktsegment, 'BUILDING')").alias("seg"))
    return hash_table(c, SALT, ["c_name", "c_nationkey", "seg"])


def lookup_tokens(spark: SparkSession, sf: str) -> DataFrame:
    c = t(spark, sf, "customer")
    return c.selectExpr("c_custkey", f"{lookup_token('c_name', 'user_id', SALT)} AS user_token")


def token_check(spark: SparkSession, sf: str) -> DataFrame:
    c = hash_where(t(spark, sf, "customer"), "c_name", "c_mktsegment = 'BUILDING'", SALT)
    return c.selectExpr("c_custkey", "c_name", f"{is_token('c_name')} AS is_token")


def token_quality(spark: SparkSession, sf: str) -> DataFrame:
    c = hash_where(t(spark, sf, "customer"), "c_name", "c_mktsegment <> 'BUILDING'", SALT)
    return linkage.token_quality(c, "c_name")


def _tokenised(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    orders = hash_table(t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), SALT, ["o_custkey"])
    customers = hash_table(t(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), SALT, ["c_custkey"])
    return orders, customers


def _buyers(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of orders' customers, with numbers that only some customers have."""
    orders = t(spark, sf, "orders").selectExpr("o_custkey + o_custkey % 2 AS buyer")
    return hash_table(orders, SALT, ["buyer"])


def linkage_join(spark: SparkSession, sf: str) -> DataFrame:
    orders, customers = _tokenised(spark, sf)
    return linkage.link(orders, customers, "o_custkey", "c_custkey").select("o_orderkey", "o_orderstatus", "c_mktsegment", "c_nationkey")


def linkage_semi(spark: SparkSession, sf: str) -> DataFrame:
    _, customers = _tokenised(spark, sf)
    return linkage.link(customers, _buyers(spark, sf), "c_custkey", "buyer", "left_semi")


def linkage_anti(spark: SparkSession, sf: str) -> DataFrame:
    _, customers = _tokenised(spark, sf)
    some_null = customers.withColumn("c_custkey", F.expr("IF(c_nationkey = 7, 'HASH_NULL', c_custkey)"))
    return linkage.link(some_null, _buyers(spark, sf), "c_custkey", "buyer", "left_anti")


def linkage_counts(spark: SparkSession, sf: str) -> DataFrame:
    orders, _ = _tokenised(spark, sf)
    events = hash_table(t(spark, sf, "events").select("user_id"), SALT, ["user_id"])
    return linkage.linkage_counts(orders, events, "o_custkey", "user_id")


def _contacts(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "customer").select("c_custkey", F.expr(VALUES["email"]).alias("contact"), "c_mktsegment")


def tokenised_filter(spark: SparkSession, sf: str) -> DataFrame:
    stored = hash_table(_contacts(spark, sf), SALT, ["contact"])
    return _filter_by_contact(spark, stored, "token")


def tokenised_filter_raw(spark: SparkSession, sf: str) -> DataFrame:
    return _filter_by_contact(spark, _contacts(spark, sf), "raw").select("c_custkey", "c_mktsegment")


def _filter_by_contact(spark: SparkSession, df: DataFrame, match: str) -> DataFrame:
    profile = get_profile("databricks").with_tables(lambda _spark, _entity: df)
    request = Request("databricks", "one customer by mail", "customers", {"contact": "user42@example.com"})
    return secure_query(spark, request, Settings(salt=SALT, match=match), profile).df


# -- request algebra -----------------------------------------------------------------
def filter_eq(spark: SparkSession, sf: str) -> DataFrame:
    out = filter_equal(t(spark, sf, "orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})
    return out.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


def filter_null(spark: SparkSession, sf: str) -> DataFrame:
    holes = t(spark, sf, "orders").select("o_orderkey", F.expr("nullif(o_orderpriority, '5-LOW')").alias("priority"))
    parts = [
        filter_equal(holes, {"priority": None}, get_profile(b)).select("o_orderkey", F.lit(b).alias("backend"))
        for b in ("trino", "athena", "snowflake", "databricks", "bigquery")
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def filter_typed(spark: SparkSession, sf: str) -> DataFrame:
    wanted = {"l_linenumber": 1, "l_returnflag": "A", "l_tax": 0.02, "l_shipdate": "1999-04-14"}
    by_date = filter_equal(t(spark, sf, "lineitem"), {k: v for k, v in wanted.items() if k != "l_tax"})
    by_tax = filter_equal(t(spark, sf, "lineitem"), {k: v for k, v in wanted.items() if k != "l_shipdate"})
    return by_date.select("l_orderkey", "l_partkey", F.lit("date").alias("by")).unionByName(
        by_tax.select("l_orderkey", "l_partkey", F.lit("tax").alias("by"))
    )


def agg_group(spark: SparkSession, sf: str) -> DataFrame:
    out = aggregate(
        t(spark, sf, "lineitem"),
        ["COUNT(*) AS n", "COUNT(l_tax) AS n_tax", "SUM(l_quantity) AS qty", "AVG(l_extendedprice) AS price",
         "MIN(l_discount) AS low", "MAX(l_discount) AS high"],
        ["l_returnflag", "l_linestatus"],
    )
    return cents(out, "qty", "price")


def agg_global(spark: SparkSession, sf: str) -> DataFrame:
    wanted = ["COUNT(*)", "SUM(o_totalprice) AS total", "AVG(o_totalprice)", "MIN(o_orderkey)", "MAX(o_orderkey)"]
    return cents(aggregate(t(spark, sf, "orders"), wanted), "total", "avg_o_totalprice")


def agg_stats(spark: SparkSession, sf: str) -> DataFrame:
    wanted = ["STDDEV(o_totalprice) AS sd", "VARIANCE(o_totalprice) AS var"]
    return cents(aggregate(t(spark, sf, "orders"), wanted, ["o_orderpriority"]), "sd").withColumn("var", F.round("var", -2))


def agg_bool(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate(
        t(spark, sf, "labels"), ["BOOL_AND(toxic) AS all_toxic", "BOOL_OR(toxic) AS any_toxic", "EVERY(quality) AS every_good"],
        ["quality"],
    )


def agg_array(spark: SparkSession, sf: str) -> DataFrame:
    holes = t(spark, sf, "lineitem").select("l_orderkey", F.expr("nullif(l_linenumber, 3)").alias("line"))
    out = aggregate(holes, ["ARRAY_AGG(line) AS lines"], ["l_orderkey"])
    return out.select("l_orderkey", F.array_join("lines", ",", "null").alias("lines"), F.size("lines").alias("n_lines"))


def agg_any(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate(t(spark, sf, "customer"), ["ARBITRARY(c_nationkey) AS nation", "COUNT(*) AS n"], ["c_name"])


def agg_approx(spark: SparkSession, sf: str) -> DataFrame:
    wanted = ["APPROX_DISTINCT(l_partkey) AS parts", "APPROX_PERCENTILE(l_quantity) AS median", "APPROX_PERCENTILE(l_quantity, 0.9) AS p90"]
    lines = t(spark, sf, "lineitem")
    near = aggregate(lines, wanted, ["l_returnflag"])
    # the exact count, and between which shares of the rows the percentiles lie
    exact = lines.groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("exact_parts"), F.count(F.lit(1)).alias("n"))
    ranks = lines.join(near, "l_returnflag").groupBy("l_returnflag").agg(
        *[F.count_if(F.expr(f"l_quantity {op} {p}")).alias(f"{p}_{name}") for p in ("median", "p90") for op, name in (("<", "below"), ("<=", "upto"))]
    )
    both = near.join(exact, "l_returnflag").join(ranks, "l_returnflag")
    inside = lambda p, q: F.expr(f"{p}_below <= {q} * n + 0.01 * n AND {p}_upto >= {q} * n - 0.01 * n")
    return both.select(
        "l_returnflag", "exact_parts", F.expr("abs(parts - exact_parts) <= 0.15 * exact_parts").alias("parts_near"),
        inside("median", 0.5).alias("median_near"), inside("p90", 0.9).alias("p90_near"),
    )


def topk_nulls(spark: SparkSession, sf: str) -> DataFrame:
    holes = t(spark, sf, "orders").select("o_orderkey", F.expr("nullif(o_orderpriority, '5-LOW')").alias("priority"))
    keys = ["priority DESC NULLS LAST", "o_orderkey ASC"]
    return order_limit(holes, keys, 1000, get_profile("databricks"))


def topk_null_defaults(spark: SparkSession, sf: str) -> DataFrame:
    holes = t(spark, sf, "orders").select("o_orderkey", F.expr("nullif(o_orderpriority, '5-LOW')").alias("priority"))
    out = None
    for b in ("trino", "snowflake", "bigquery"):
        for way in ("ASC", "DESC"):
            top = order_limit(holes, [f"priority {way}", "o_orderkey"], 100, get_profile(b))
            part = top.select("o_orderkey", "priority", F.lit(b).alias("backend"), F.lit(way).alias("way"))
            out = part if out is None else out.unionByName(part)
    return out


def topk_alias(spark: SparkSession, sf: str) -> DataFrame:
    spent = aggregate(t(spark, sf, "orders"), ["SUM(o_totalprice) AS spent", "COUNT(*) AS n"], ["o_custkey"])
    return cents(order_limit(spent, ["n DESC", "o_custkey"], 100, get_profile("trino")), "spent")


def _ask(spark: SparkSession, sf: str, backend: str, **request) -> DataFrame:
    profile = get_profile(backend).with_tables(file_tables(sf, names=ENTITIES))
    return secure_query(spark, Request.from_dict({"backend": backend, **request}), Settings(salt=SALT), profile).df


def backend_snowflake(spark: SparkSession, sf: str) -> DataFrame:
    out = _ask(
        spark, sf, "snowflake", intent="Get total customer counts grouped by segment", entity="customers",
        aggregations=["COUNT(*) as total", "SUM(c_acctbal) AS balance"], group_by=["c_mktsegment"], order_by=["total DESC"],
    )
    return cents(out, "balance")


def backend_databricks(spark: SparkSession, sf: str) -> DataFrame:
    return _ask(
        spark, sf, "Databricks", intent="Find orders with total value over 1000", filters={"o_orderstatus": "F"},
        order_by=["o_orderkey"], limit=1000, pii_policy="hash",
    ).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


def backend_trino(spark: SparkSession, sf: str) -> DataFrame:
    return _ask(
        spark, sf, "trino", intent="count the events by kind", entity="events",
        aggregations=["COUNT(*) AS n", "MIN(value) AS low", "MAX(value) AS high"], group_by=["event_type"], pii_policy="deny",
    )


def backend_bigquery(spark: SparkSession, sf: str) -> DataFrame:
    return _ask(
        spark, sf, "bigquery", intent="list every customer of one segment", filters={"c_mktsegment": "BUILDING"},
        order_by=["c_acctbal DESC", "c_custkey"], limit=50, pii_policy="hash",
    ).select("c_custkey", "c_name", "c_acctbal")


def backend_athena(spark: SparkSession, sf: str) -> DataFrame:
    return _ask(
        spark, sf, "athena", intent="orders by status", aggregations=["COUNT(*) AS n", "MIN(o_orderkey) AS first", "MAX(o_custkey) AS last"],
        group_by=["o_orderstatus"], order_by=["o_orderstatus"],
    )


# -- names and catalog ----------------------------------------------------------------
def labelled_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Every column with its name label and how many rows hold personal data by value."""
    tables = all_tables(spark, sf)
    names = catalog.column_catalog(catalog.columns_of(spark, tables))
    found = (
        profile_tables(tables)
        .groupBy(F.col("table"), F.col("column").alias("column_name"))
        .agg(F.max("rows_scanned").alias("rows_scanned"), F.sum("n_rows").alias("n_hits"))
    )
    return names.join(found, ["table", "column_name"]).select(
        F.col("table").alias("tbl"), "column_name", "data_type", "is_pii", "pii_sensitivity", "pii_category", "match_reason",
        "rows_scanned", "n_hits",
    )


def _row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


# Names of every kind of rule, from a row's number (valid in both engines), and what the rules say about them.
_NAMES = {
    "email": ("exact_match", "high", "contact"), "Mobile": ("exact_match", "medium", "contact"), "ssn": ("exact_match", "critical", "identity"),
    "iban": ("exact_match", "critical", "financial"), "bank_account": ("exact_match", "medium", "financial"),
    "passwd": ("exact_match", "medium", "unknown"), "password": ("exact_match", "critical", "credentials"), "dob": ("exact_match", "high", "personal"),
    "user_email": ("contains_pattern:_email", "high", "contact"), "first_name": ("contains_pattern:first_name", "medium", "personal"),
    "ip_address": ("contains_pattern:address", "high", "location"), "capacity": ("contains_pattern:city", "medium", "location"),
    "n_tokens": ("contains_pattern:_token", "medium", "credentials"), "country_code": ("contains_pattern:country", "medium", "unknown"),
    "product_name": (None, "medium", "inferred"), "cell_tel": (None, "medium", "inferred"), "addr1": (None, "medium", "inferred"),
    "variant_data": ("backend_override:snowflake", "medium", "backend_specific"), "created_at": ("", "none", None), "quantity": ("", "none", None),
}
_NAME_OF = "concat(CASE event_id % 20 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END)"


def label_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names taken from rows, under every rule: by whole name, fragment, pattern, backend, or none."""
    names = t(spark, sf, "events").selectExpr("event_id", f"{_NAME_OF} AS column_name")
    found = catalog.label_columns(names, backend="snowflake")
    return found.select("event_id", "is_pii", "pii_sensitivity", "pii_category", F.expr("split(match_reason, ':')[0]").alias("rule"))


def label_event_tables(spark: SparkSession, sf: str) -> DataFrame:
    """One catalog table per user, with critical and high columns."""
    names = t(spark, sf, "events").selectExpr("'events' AS database", "CAST(user_id AS STRING) AS table", f"{_NAME_OF} AS column_name").distinct()
    out = catalog.label_tables(catalog.label_columns(names, backend="snowflake"))
    return out.select(
        F.col("table").alias("tbl"), "has_pii", joined("pii_columns").alias("pii_columns"),
        joined("critical_columns").alias("critical_columns"), joined("high_columns").alias("high_columns"),
    )


def table_labels(spark: SparkSession, sf: str) -> DataFrame:
    tables = all_tables(spark, sf)
    labels = catalog.label_tables(catalog.column_catalog(catalog.columns_of(spark, tables)))
    return labels.join(_row_counts(tables), "table").select(
        F.col("table").alias("tbl"), "has_pii", joined("pii_columns").alias("pii_columns"),
        joined("critical_columns").alias("critical_columns"), joined("high_columns").alias("high_columns"), "n_rows",
    )


def catalog_search(spark: SparkSession, sf: str) -> DataFrame:
    tables = all_tables(spark, sf)
    hits = catalog.search_tables(catalog.column_catalog(catalog.columns_of(spark, tables)), "er")
    return hits.join(_row_counts(tables), "table").select("database", F.col("table").alias("tbl"), "n_rows")


def safe_columns(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.safe_columns(t(spark, sf, "part"))


def sensitivity_cap(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.columns_up_to(t(spark, sf, "supplier"), "low")


def _decided(spark: SparkSession, sf: str, policy: str, levels: bool) -> DataFrame:
    out = None
    for name in TEXT_TABLES + ["customer", "supplier"]:
        df = texts(spark, sf, name) if name == "documents" else t(spark, sf, name)
        d = decisions(profile_table(df), policy, enforce_levels=levels)
        part = d.select(
            F.lit(name).alias("tbl"), F.col("column").alias("col"), "is_named", joined("pii_types").alias("types"),
            "sensitivity", "action",
        )
        out = part if out is None else out.unionByName(part)
    return out


def policy_auto(spark: SparkSession, sf: str) -> DataFrame:
    return _decided(spark, sf, "auto", False)


def policy_floor(spark: SparkSession, sf: str) -> DataFrame:
    return _decided(spark, sf, "mask", True)


def policy_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Per table and policy: is it refused, and for which columns."""
    out = None
    for policy, levels in (("auto", False), ("mask", True)):
        d = _decided(spark, sf, policy, levels)
        denied = F.array_sort(F.collect_list(F.when(F.col("action") == "deny", F.col("col"))))
        part = d.groupBy("tbl").agg(joined(denied).alias("denied_columns"), F.max((F.col("action") == "deny")).alias("denied"))
        part = part.select("tbl", F.lit(policy).alias("policy"), "denied", "denied_columns")
        out = part if out is None else out.unionByName(part)
    return out


def auto_documents(spark: SparkSession, sf: str) -> DataFrame:
    """``auto`` applied where nothing is to be refused: documents without payment cards."""
    card = next(d for d in DEFAULT_RULES.detections if d.name == "credit_card")
    docs = texts(spark, sf, "documents").where(f"NOT {has_type('text', card)}")
    return apply_policy(docs, "auto", salt=SALT).df


# -- requests and audit -----------------------------------------------------------------
def screen_requests(spark: SparkSession, sf: str) -> DataFrame:
    turns = texts(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("intent"))
    return screen.screen_intents(turns).drop("intent")


# Every kind of SQL that an intent may hold, among harmless ends.
_INTENT_ENDS = ["customer", "border", "region", "catalog", "from", "select", "where x", "join", "insert", "update", "delete", "drop",
                "create", "alter", "grant", "revoke", "kind;", "a -- b", "a /* b", "selection"]
_INTENT_ENDS_DUCK = "[" + ", ".join(f"'{e}'" for e in _INTENT_ENDS) + "]"
_INTENT_ENDS_SPARK = "array(" + _INTENT_ENDS_DUCK[1:-1] + ")"


def _event_requests(spark: SparkSession, sf: str) -> DataFrame:
    """A request per event: intents and fields that pass, and ones that fail each check."""
    return texts(spark, sf, "events").selectExpr(
        "event_id",
        "ts",
        "user_id",
        "element_at(array('snowflake', 'databricks', 'trino', 'bigquery', 'athena', 'oracle'), CAST(event_id % 6 AS INT) + 1) AS backend",
        f"concat('show ', event_type, ' totals by ', element_at({_INTENT_ENDS_SPARK}, CAST(user_id % 20 AS INT) + 1)) AS intent",
        "CASE WHEN event_id % 11 = 3 THEN 'payroll' WHEN event_id % 11 = 5 THEN 'a b' END AS entity",
        "map(CASE WHEN event_id % 13 = 0 THEN 'bad key' ELSE 'kind' END, "
        "CASE WHEN event_id % 7 = 0 THEN concat(event_type, '; --x') ELSE event_type END) AS filters",
        "array(CASE WHEN event_id % 17 = 0 THEN '1x' ELSE 'kind' END) AS group_by",
        "array(CASE event_id % 19 WHEN 0 THEN 'DROP(x)' WHEN 1 THEN 'SUM(*)' WHEN 2 THEN 'count( * ) as n' WHEN 3 THEN 'SUM(v, 0.5)' "
        "WHEN 4 THEN 'approx_percentile(v, .9) AS p' WHEN 5 THEN 'AVG(v) AS 1n' ELSE 'MAX(v)' END) AS aggregations",
        "array(CASE event_id % 23 WHEN 0 THEN '1; x' WHEN 1 THEN 'v desc nulls last' WHEN 2 THEN 'v DOWN' ELSE 'v' END) AS order_by",
        "CASE WHEN event_id % 100 = 1 THEN NULL ELSE CAST(event_id % 1100 AS INT) END AS limit",
        "element_at(array('mask', 'hash', 'deny', 'auto', 'mask', 'hash', 'nope'), CAST(event_id % 7 AS INT) + 1) AS pii_policy",
    )


def route_requests(spark: SparkSession, sf: str) -> DataFrame:
    checked = screen.screen_requests(_event_requests(spark, sf))
    return checked.select(
        "event_id", "backend", "routed_table", "sql_pattern", joined("dangerous_filters").alias("dangerous"), "reject_reason"
    )


def value_screen(spark: SparkSession, sf: str) -> DataFrame:
    values = texts(spark, sf, "documents").selectExpr("doc_id", f"{_SCREENED} AS value")
    return values.selectExpr("doc_id", f"{screen.dangerous_value('value')} AS dangerous")


def filter_scan(spark: SparkSession, sf: str) -> DataFrame:
    filters = F.create_map(F.lit("text"), "text", F.lit("lang"), "lang")
    docs = texts(spark, sf, "documents").select("doc_id", filters.alias("filters"))
    got = screen.scan_filters(docs, SALT)
    return got.select(
        "doc_id", joined("pii_filters").alias("pii_filters"), F.col("safe_filters")["text"].alias("text"),
        F.col("safe_filters")["lang"].alias("lang"), F.col("logged_filters")["text"].alias("logged"),
    )


def audit_events(spark: SparkSession, sf: str) -> DataFrame:
    checked = screen.screen_requests(_event_requests(spark, sf))
    ids = (F.col("ts"), F.concat(F.lit("inv_"), F.col("event_id")), F.concat(F.lit("sess_"), F.col("user_id")))
    both = audit.invocation_events(checked, *ids).unionByName(audit.denial_events(checked, *ids))
    return both.select(
        stamp("ts").alias("ts"), "event_type", "level", "session_id", "invocation_id", "backend", "intent", "reason",
        joined("filter_keys").alias("filter_keys"),
    )


def audit_findings(spark: SparkSession, sf: str) -> DataFrame:
    """What was found in the tables, and what ``auto`` does about it, as events."""
    out = None
    ids = (F.lit(None), F.lit("inv_1"), F.lit("sess_1"))
    for name in TEXT_TABLES + ["customer", "supplier"]:
        profile = profile_table(texts(spark, sf, name) if name == "documents" else t(spark, sf, name))
        both = audit.detection_events(profile, *ids).unionByName(audit.policy_events(decisions(profile, "auto"), "auto", *ids))
        part = both.withColumn("tbl", F.lit(name))
        out = part if out is None else out.unionByName(part)
    columns = F.coalesce(joined("affected_columns"), joined("columns_affected")).alias("columns")
    return out.select("tbl", "event_type", "level", columns, joined("detected_pii_types").alias("types"), "rows_scanned", "policy", "action_taken")


def audit_calls(spark: SparkSession, sf: str) -> DataFrame:
    events = t(spark, sf, "events")
    calls = audit.call_events(events, F.col("ts"), F.col("user_id"), F.col("event_type"), F.col("value"), F.col("event_type") != "error")
    by_user = events.withColumn("session_id", F.concat_ws("_", "user_id", F.date_format("ts", "yyyyMMdd")))
    sessions = audit.session_events(audit.session_report(by_user, invocation=F.col("event_type") == "click"))
    return calls.unionByName(sessions).select(
        stamp("ts").alias("ts"), "event_type", "level", "session_id", "operation", "duration_ms", "success", "total_invocations"
    )


def audit_by_user(spark: SparkSession, sf: str) -> DataFrame:
    out = audit.invocation_report(t(spark, sf, "events"), "user_id")
    return out.select(
        "user_id", stamp("first_ts").alias("first_ts"), stamp("last_ts").alias("last_ts"), "n_events",
        joined("event_types").alias("event_types"), "last_event_type",
    )


def audit_timing(spark: SparkSession, sf: str) -> DataFrame:
    out = audit.backend_report(
        t(spark, sf, "events"), ["event_type"], "value", success=F.col("event_type") != "error", rows=None
    )
    return cents(out, "avg_ms").drop("p95_ms")


def audit_sessions(spark: SparkSession, sf: str) -> DataFrame:
    events = t(spark, sf, "events").withColumn("session_id", F.concat_ws("_", "user_id", F.date_format("ts", "yyyyMMdd")))
    out = audit.session_report(events, invocation=F.col("event_type") == "click")
    return out.select(
        "session_id", stamp("started_at").alias("started_at"), stamp("ended_at").alias("ended_at"), "total_invocations", "n_events"
    )


def _windows(df: DataFrame) -> DataFrame:
    return df.select(stamp("window_start").alias("window_start"), stamp("window_end").alias("window_end"), "event_type", "n_events")


def audit_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _windows(audit.window_counts(t(spark, sf, "events")))


# -- streams and files -------------------------------------------------------------------
def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return stream_table(spark, f"{sf}/{name}.parquet")


def _scratch(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/streams-{uuid.uuid4()}"


def stream_redact_documents(spark: SparkSession, sf: str) -> DataFrame:
    out = _scratch(spark)
    stream = protect_stream(_stream(spark, sf, "documents"), ["text"], ["source"], SALT)
    append_stream(stream, f"{out}/data", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/data").select("doc_id", "text", "source")


def stream_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    out = _scratch(spark)
    stream = _stream(spark, sf, "pages")
    quarantine_stream(stream, f"{out}/clean", f"{out}/held", f"{out}/state", ["url", "html"]).awaitTermination()
    clean = spark.read.parquet(f"{out}/clean").select("page_id", F.lit(False).alias("held"))
    return clean.unionByName(spark.read.parquet(f"{out}/held").select("page_id", F.lit(True).alias("held")))


def stream_audit_windows(spark: SparkSession, sf: str) -> DataFrame:
    out = _scratch(spark)
    counts_stream(_stream(spark, sf, "events"), f"{out}/data", f"{out}/state").awaitTermination()
    return _windows(latest_counts(spark, f"{out}/data"))


def object_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.list_objects(spark, sf).select("key", "size_bytes", "content_type")


_QUERIES: list[Query] = [
    redact_documents, redact_pages, redact_contacts, redact_nested, redact_sql_function, mask_known_types, pii_spans,
    pii_spans_contacts, pii_profile, clean_documents, result_summary, hash_documents_policy, hash_customer_policy,
    token_customer, lookup_tokens, token_check, token_quality, linkage_join, linkage_semi, linkage_anti, linkage_counts,
    tokenised_filter, tokenised_filter_raw, filter_eq, filter_null, filter_typed, agg_group, agg_global, agg_stats, agg_bool,
    agg_array, agg_any, agg_approx, topk_nulls, topk_null_defaults, topk_alias, backend_snowflake, backend_databricks,
    backend_trino, backend_bigquery, backend_athena, labelled_catalog, table_labels, label_names, label_event_tables, catalog_search, safe_columns,
    sensitivity_cap, policy_auto, policy_floor, policy_outcomes, auto_documents, nested_spans, nested_profile, screen_requests, route_requests, value_screen, filter_scan, audit_events, audit_findings, audit_calls,
    audit_by_user, audit_timing, audit_sessions, audit_windows, stream_redact_documents, stream_quarantine,
    stream_audit_windows, object_inventory,
]


def entry(spark: SparkSession) -> DataFrame:
    """Documents with personal data masked, and the types that were found."""
    return redact_documents(spark, f"{TESTDATA}/sf0.001")


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in _QUERIES} | table_queries.queries() | (llm.queries() if llm else {})


def core_names() -> list[str]:
    """The queries of this library's own operators, without the optional part."""
    return [*(q.__name__ for q in _QUERIES), *table_queries.queries()]


def oracle_sql() -> dict[str, str]:
    return _oracles() | table_queries.oracle_sql() | (llm.oracle_sql() if llm else {})


# -- SQL twins -----------------------------------------------------------------------------
_TS = "%Y-%m-%d %H:%M:%S.%f"


def _word(keyword: str) -> str:
    """A keyword as a whole Unicode word."""
    return o.lit(rf"(?i)(^|[^\p{{L}}\p{{N}}_]){keyword}($|[^\p{{L}}\p{{N}}_])")


def _sql_pattern(x: str) -> str:
    whens = []
    for p in SQL_PATTERNS:
        keyword = p.replace(r"\b", "")
        test = _word(keyword) if keyword != p else o.lit("(?i)" + p)
        whens.append(f"WHEN regexp_matches({x}, {test}) THEN {o.lit(p)}")
    return f"CASE {' '.join(whens)} END"


def _dangerous(x: str) -> str:
    tests = [f"regexp_matches({x}, {o.lit('(?i)' + p.replace(chr(92) + 'w', '[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]'))})" for p in DANGEROUS_VALUES]
    return f"coalesce({' OR '.join(tests)}, false)"


def _oracles() -> dict[str, str]:
    tok = lambda x: o.token(x, SALT)
    lines = f"lines AS (SELECT o_orderkey, {CONTACT} AS line FROM orders), "
    span_cols = (
        "path, kind AS type, v AS value, st AS start_at, CAST(st + length(v) AS INTEGER) AS end_at, "
        "CASE kind {s} END AS sensitivity, CASE kind {a} END AS default_action"
    ).format(
        s=" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in o.SENSITIVITY.items()),
        a=" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in o.ACTION.items()),
    )
    pages_red = (
        f"WITH {o.redact_ctes('pages', 'page_id', 'html', 'h')}, {o.redact_ctes('pages', 'page_id', 'url', 'u')}, "
        "m AS (SELECT p.page_id, coalesce(u.clean, p.url) AS url, coalesce(h.clean, p.html) AS html FROM pages p "
        "LEFT JOIN h ON h.page_id = p.page_id LEFT JOIN u ON u.page_id = p.page_id) "
    )
    holes = "(SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS priority FROM orders)"
    contact = VALUES["email"]
    all_profile = o.profile_sql(TABLES)
    counts = " UNION ALL ".join(f"SELECT '{n}' AS tbl, count(*) AS n_rows FROM {n}" for n in TABLES)
    keywords = {
        b: "CASE " + " ".join(f"WHEN contains(lower(intent), '{k}') THEN '{v}'" for k, v in get_profile(b).keywords.items()) + " END"
        for b in ("snowflake", "databricks", "trino", "bigquery", "athena")
    }
    routed = "coalesce(entity, CASE backend " + " ".join(f"WHEN '{b}' THEN {k}" for b, k in keywords.items()) + " END)"
    allow = {b: ", ".join(f"'{n}'" for n in sorted(get_profile(b).allowed_tables)) for b in ("trino", "athena")}
    requests = f"""req AS (SELECT event_id, ts, user_id,
 ['snowflake', 'databricks', 'trino', 'bigquery', 'athena', 'oracle'][event_id % 6 + 1] AS backend,
 concat('show ', event_type, ' totals by ', {_INTENT_ENDS_DUCK}[user_id % 20 + 1]) AS intent,
 CASE WHEN event_id % 11 = 3 THEN 'payroll' WHEN event_id % 11 = 5 THEN 'a b' END AS entity,
 CASE WHEN event_id % 13 = 0 THEN 'bad key' ELSE 'kind' END AS fk,
 CASE WHEN event_id % 7 = 0 THEN concat(event_type, '; --x') ELSE event_type END AS fv,
 CASE WHEN event_id % 17 = 0 THEN '1x' ELSE 'kind' END AS gb, CASE WHEN event_id % 100 = 1 THEN NULL ELSE event_id % 1100 END AS lim FROM events),
chk AS (SELECT *, {_sql_pattern('intent')} AS sql_pattern, {routed} AS routed_table,
 CASE WHEN {_dangerous('fv')} THEN fk ELSE '' END AS dangerous FROM req),
res AS (SELECT *, CASE WHEN backend = 'oracle' THEN 'unknown backend'
 WHEN length(intent) NOT BETWEEN 5 AND 500 THEN 'intent length' WHEN sql_pattern IS NOT NULL THEN 'sql in intent'
 WHEN lim NOT BETWEEN 1 AND 1000 THEN 'limit out of range' WHEN event_id % 7 = 6 THEN 'policy' WHEN fk = 'bad key' THEN 'filter key'
 WHEN gb = '1x' THEN 'group by column' WHEN event_id % 19 IN (0, 1, 3, 5) THEN 'aggregation' WHEN event_id % 23 IN (0, 2) THEN 'order by' WHEN routed_table IS NULL THEN 'no table'
 WHEN routed_table = 'a b' THEN 'table name'
 WHEN backend = 'trino' AND routed_table NOT IN ({allow['trino']}) THEN 'table not allowed'
 WHEN backend = 'athena' AND routed_table NOT IN ({allow['athena']}) THEN 'table not allowed' END AS reject_reason FROM chk)"""
    summary = []
    for tbl in ("documents", "pages", "customer", "orders"):
        cols = ",".join(c for c, _ in o.COLUMNS[tbl])
        summary.append(
            f"SELECT '{tbl}' AS tbl, max(rows_scanned) AS row_count, '{cols}' AS column_names, 'mask' AS policy_applied, "
            f"count(DISTINCT path) FILTER (WHERE n_rows > 0 OR {o.name_reason('path')} IS NOT NULL) > 0 AS pii_detected, "
            f"coalesce(string_agg(DISTINCT path, ',' ORDER BY path) FILTER (WHERE n_rows > 0 OR {o.name_reason('path')} IS NOT NULL), '') AS columns_processed, "
            "coalesce(string_agg(DISTINCT pii_type, ',' ORDER BY pii_type) FILTER (WHERE n_rows > 0), '') AS pii_types "
            f"FROM ({o.profile_sql([tbl])})"
        )
    rule_of = lambda reason: "NULL" if reason == "" else "'regex_pattern'" if reason is None else f"'{reason.split(':')[0]}'"
    _name_values = ", ".join(
        f"({i}, '{n}', {rule_of(r)}, '{level}', {'NULL' if c is None else o.lit(c)})" for i, (n, (r, level, c)) in enumerate(_NAMES.items())
    )
    windows = (
        "SELECT strftime(w, '{f}') AS window_start, strftime(w + INTERVAL 1 HOUR, '{f}') AS window_end, event_type, "
        "count(*) AS n_events FROM (SELECT date_trunc('hour', ts) AS w, event_type FROM events) "
    ).format(f=_TS)
    return {
        "redact_documents": o.redact_query("documents", "doc_id", "text", f"b.doc_id, clean AS text, {o.types_text('b.text')} AS pii_types"),
        "redact_pages": pages_red + "SELECT page_id, url, html FROM m",
        "redact_contacts": o.redact_query("lines", "o_orderkey", "line", f"b.o_orderkey, clean AS line, {o.types_text('b.line')} AS pii_types", lines),
        "redact_nested": pages_red + "SELECT page_id, url, html AS part_0, url AS part_1, html AS m_html FROM m",
        "redact_sql_function": o.redact_query("documents", "doc_id", "text", f"b.doc_id, clean AS text, {o.any_hit('b.text')} AS has_pii, {tok('b.source')} AS source"),
        "mask_known_types": "SELECT c_custkey, " + ", ".join(f"{o.mask(f'({v})', k)} AS {k}" for k, v in VALUES.items()) + " FROM customer",
        "pii_spans": f"SELECT doc_id, 'text' AS {span_cols} FROM ({o.spans_sql('documents', 'doc_id', 'text')})",
        "pii_spans_contacts": f"WITH {lines.rstrip(', ')} SELECT o_orderkey, 'line' AS {span_cols} FROM ({o.spans_sql('lines', 'o_orderkey', 'line')})",
        "pii_profile": all_profile,
        "clean_documents": f"SELECT doc_id, lang, n_chars FROM documents WHERE NOT {o.any_hit('text')}",
        "result_summary": " UNION ALL ".join(summary),
        "hash_documents_policy": f"SELECT doc_id, CASE WHEN (SELECT bool_or({o.any_hit('text')}) FROM documents) THEN {tok('text')} ELSE text END AS text, lang, source, n_chars FROM documents",
        "hash_customer_policy": f"SELECT c_custkey, {tok('c_name')} AS c_name, c_nationkey, c_mktsegment FROM customer",
        "token_customer": f"SELECT c_custkey, {tok('c_name')} AS c_name, {tok('CAST(c_nationkey AS VARCHAR)')} AS c_nationkey, "
        + tok("nullif(c_mktsegment, 'BUILDING')") + " AS seg FROM customer",
        "lookup_tokens": f"SELECT c_custkey, {o.lookup('c_name', 'user_id', SALT)} AS user_token FROM customer",
        "token_check": f"SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN {tok('c_name')} ELSE c_name END AS c_name, c_mktsegment = 'BUILDING' AS is_token FROM customer",
        "token_quality": "SELECT count(*) FILTER (WHERE c_mktsegment <> 'BUILDING') AS tokens, CAST(0 AS BIGINT) AS null_tokens, "
        "count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS raw_values, CAST(0 AS BIGINT) AS nulls FROM customer",
        "linkage_join": "SELECT o_orderkey, o_orderstatus, c_mktsegment, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey",
        "linkage_semi": f"SELECT {tok('CAST(c_custkey AS VARCHAR)')} AS c_custkey, c_mktsegment, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey + o_custkey % 2 FROM orders)",
        "linkage_anti": f"SELECT CASE WHEN c_nationkey = 7 THEN 'HASH_NULL' ELSE {tok('CAST(c_custkey AS VARCHAR)')} END AS c_custkey, c_mktsegment, c_nationkey FROM customer "
        "WHERE c_nationkey = 7 OR c_custkey NOT IN (SELECT o_custkey + o_custkey % 2 FROM orders)",
        "linkage_counts": f"SELECT {tok('CAST(k AS VARCHAR)')} AS token, left_rows, right_rows, left_rows * right_rows AS pairs FROM "
        "(SELECT o_custkey AS k, count(*) AS left_rows FROM orders GROUP BY 1) JOIN (SELECT user_id AS k, count(*) AS right_rows FROM events GROUP BY 1) USING (k)",
        "tokenised_filter": f"SELECT c_custkey, {tok(contact)} AS contact, c_mktsegment FROM customer WHERE {contact} = 'user42@example.com'",
        "tokenised_filter_raw": f"SELECT c_custkey, c_mktsegment FROM customer WHERE {contact} = 'user42@example.com'",
        "filter_eq": "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'",
        "filter_null": f"SELECT o_orderkey, b AS backend FROM {holes}, (VALUES ('trino'), ('athena'), ('bigquery')) AS v(b) WHERE priority IS NULL",
        "filter_typed": "SELECT l_orderkey, l_partkey, 'date' AS by FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'A' AND l_shipdate = TIMESTAMP '1999-04-14' "
        "UNION ALL SELECT l_orderkey, l_partkey, 'tax' AS by FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'A' AND l_tax = 0.02::DOUBLE",
        "agg_group": "SELECT count(*) AS n, count(l_tax) AS n_tax, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 2) AS price, "
        "min(l_discount) AS low, max(l_discount) AS high, l_returnflag, l_linestatus FROM lineitem GROUP BY l_returnflag, l_linestatus",
        "agg_global": "SELECT count(*) AS count_all, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 2) AS avg_o_totalprice, "
        "min(o_orderkey) AS min_o_orderkey, max(o_orderkey) AS max_o_orderkey FROM orders",
        "agg_stats": "SELECT round(stddev_samp(o_totalprice), 2) AS sd, round(var_samp(o_totalprice), -2) AS var, o_orderpriority FROM orders GROUP BY o_orderpriority",
        "agg_bool": "SELECT bool_and(toxic <> 0) AS all_toxic, bool_or(toxic <> 0) AS any_toxic, bool_and(quality <> 0) AS every_good, quality FROM labels GROUP BY quality",
        "agg_array": "SELECT l_orderkey, string_agg(coalesce(CAST(line AS VARCHAR), 'null'), ',' ORDER BY line NULLS LAST) AS lines, CAST(count(*) AS INTEGER) AS n_lines "
        "FROM (SELECT l_orderkey, nullif(l_linenumber, 3) AS line FROM lineitem) GROUP BY l_orderkey",
        "agg_any": "SELECT any_value(c_nationkey) AS nation, count(*) AS n, c_name FROM customer GROUP BY c_name",
        "agg_approx": "SELECT l_returnflag, count(DISTINCT l_partkey) AS exact_parts, true AS parts_near, true AS median_near, true AS p90_near "
        "FROM lineitem GROUP BY l_returnflag",
        "topk_nulls": f"SELECT * FROM {holes} ORDER BY priority DESC NULLS LAST, o_orderkey LIMIT 1000",
        "topk_null_defaults": " UNION ALL ".join(
            f"SELECT * FROM (SELECT o_orderkey, priority, '{b}' AS backend, '{way}' AS way FROM {holes} ORDER BY priority {way} NULLS {nulls}, o_orderkey LIMIT 100)"
            for b, way, nulls in (
                ("trino", "ASC", "LAST"), ("trino", "DESC", "LAST"), ("snowflake", "ASC", "LAST"),
                ("snowflake", "DESC", "FIRST"), ("bigquery", "ASC", "FIRST"), ("bigquery", "DESC", "LAST"),
            )
        ),
        "topk_alias": "SELECT round(sum(o_totalprice), 2) AS spent, count(*) AS n, o_custkey FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 100",
        "backend_snowflake": "SELECT count(*) AS total, round(sum(c_acctbal), 2) AS balance, c_mktsegment FROM customer GROUP BY c_mktsegment",
        "backend_databricks": "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 1000",
        "backend_trino": "SELECT count(*) AS n, min(value) AS low, max(value) AS high, event_type FROM events GROUP BY event_type",
        "backend_bigquery": f"SELECT c_custkey, {tok('c_name')} AS c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 50",
        "backend_athena": "SELECT CAST(count(*) AS VARCHAR) AS n, CAST(min(o_orderkey) AS VARCHAR) AS first, CAST(max(o_custkey) AS VARCHAR) AS last, o_orderstatus FROM orders GROUP BY o_orderstatus",
        "labelled_catalog": f"""WITH prof AS (SELECT tbl, path, max(rows_scanned) AS rows_scanned, CAST(sum(n_rows) AS BIGINT) AS n_hits FROM ({all_profile}) GROUP BY tbl, path),
lab AS (SELECT *, {o.name_reason('column_name')} AS match_reason FROM {o.catalog_values()})
SELECT lab.tbl, column_name, data_type, match_reason IS NOT NULL AS is_pii, CASE WHEN match_reason IS NULL THEN 'none' ELSE 'medium' END AS pii_sensitivity,
 CASE WHEN match_reason IS NOT NULL THEN 'inferred' END AS pii_category, match_reason, rows_scanned, n_hits
FROM lab JOIN prof ON prof.tbl = lab.tbl AND prof.path = lab.column_name""",
        "table_labels": f"""WITH lab AS (SELECT tbl, column_name, {o.name_reason('column_name')} IS NOT NULL AS p FROM {o.catalog_values()}),
cnt AS ({counts})
SELECT lab.tbl, bool_or(p) AS has_pii, coalesce(string_agg(column_name, ',' ORDER BY column_name) FILTER (WHERE p), '') AS pii_columns,
 '' AS critical_columns, '' AS high_columns, max(n_rows) AS n_rows FROM lab JOIN cnt ON cnt.tbl = lab.tbl GROUP BY lab.tbl""",
        "label_names": f"SELECT event_id, rule IS NOT NULL AS is_pii, level AS pii_sensitivity, category AS pii_category, rule FROM events "
        f"JOIN (VALUES {_name_values}) AS n(k, name, rule, level, category) ON event_id % 20 = k",
        "label_event_tables": f"""SELECT CAST(user_id AS VARCHAR) AS tbl, bool_or(rule IS NOT NULL) AS has_pii,
 coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (WHERE rule IS NOT NULL), '') AS pii_columns,
 coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (WHERE level = 'critical'), '') AS critical_columns,
 coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (WHERE level IN ('critical', 'high')), '') AS high_columns
 FROM events JOIN (VALUES {_name_values}) AS n(k, name, rule, level, category) ON event_id % 20 = k GROUP BY user_id""",
        "catalog_search": f"SELECT 'default' AS database, tbl, n_rows FROM ({counts}) WHERE contains(tbl, 'er')",
        "safe_columns": "SELECT p_partkey, p_brand, p_type, p_size, p_retailprice FROM part",
        "sensitivity_cap": "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier",
        "nested_spans": " UNION ALL ".join(
            f"SELECT page_id, '{p}' AS {span_cols} FROM ({o.spans_sql('pages', 'page_id', x)})"
            for p, x in (("page.url", "url"), ("page.parts", "html"), ("page.parts", "url"), ("page.m", "html"))
        ),
        "nested_profile": " UNION ALL ".join(
            f"SELECT '{p}' AS path, '{k}' AS pii_type, count(*) FILTER (WHERE {test(k)}) AS n_rows, count(*) AS rows_scanned FROM pages"
            for p, test in (
                ("page.url", lambda k: o.hit("url", k)), ("page.parts", lambda k: f"{o.hit('html', k)} OR {o.hit('url', k)}"),
                ("page.m", lambda k: o.hit("html", k)),
            )
            for k in o.TYPES
        ),
        "policy_outcomes": " UNION ALL ".join(
            f"SELECT tbl, '{p}' AS policy, bool_or(action = 'deny') AS denied, "
            f"coalesce(string_agg(col, ',' ORDER BY col) FILTER (WHERE action = 'deny'), '') AS denied_columns "
            f"FROM ({o.decisions_sql(TEXT_TABLES + ['customer', 'supplier'], p, levels)}) GROUP BY tbl"
            for p, levels in (("auto", False), ("mask", True))
        ),
        "auto_documents": f"""WITH d AS (SELECT * FROM documents WHERE NOT {o.hit('text', 'credit_card')})
SELECT doc_id, CASE WHEN (SELECT bool_or({o.hit('text', 'ip_address')} OR {o.hit('text', 'iban')}) FROM d) THEN {tok('text')} ELSE text END AS text, lang, source, n_chars FROM d""",
        "policy_auto": o.decisions_sql(TEXT_TABLES + ["customer", "supplier"], "auto", False),
        "policy_floor": o.decisions_sql(TEXT_TABLES + ["customer", "supplier"], "mask", True),
        "screen_requests": f"SELECT conv_id, turn, sql_pattern, length_ok, sql_pattern IS NULL AND length_ok AS accepted FROM "
        f"(SELECT conv_id, turn, {_sql_pattern('text')} AS sql_pattern, length(text) BETWEEN 5 AND 500 AS length_ok FROM conversations)",
        "route_requests": f"WITH {requests} SELECT event_id, backend, routed_table, sql_pattern, dangerous, reject_reason FROM res",
        "value_screen": f"SELECT doc_id, {_dangerous('value')} AS dangerous FROM (SELECT doc_id, {_SCREENED} AS value FROM documents)",
        "filter_scan": o.redact_query(
            "documents", "doc_id", "text",
            f"b.doc_id, concat_ws(',', CASE WHEN {o.any_hit('b.lang')} THEN 'lang' END, CASE WHEN {o.any_hit('b.text')} THEN 'text' END) AS pii_filters, "
            f"CASE WHEN {o.any_hit('b.text')} THEN {tok('b.text')} ELSE b.text END AS text, b.lang AS lang, clean AS logged",
        ),
        "audit_events": f"""WITH {requests} SELECT strftime(ts, '{_TS}') AS ts, 'tool_invocation' AS event_type, 'info' AS level,
 concat('sess_', user_id) AS session_id, concat('inv_', event_id) AS invocation_id, backend, intent, CAST(NULL AS VARCHAR) AS reason, fk AS filter_keys FROM res
UNION ALL SELECT strftime(ts, '{_TS}'), 'access_denied', 'warning', concat('sess_', user_id), concat('inv_', event_id), backend, NULL, reject_reason, NULL
FROM res WHERE reject_reason IS NOT NULL""",
        "audit_findings": f"""SELECT tbl, 'pii_detected' AS event_type, 'info' AS level, path AS columns, pii_type AS types, rows_scanned, NULL AS policy, NULL AS action_taken
 FROM ({o.profile_sql(TEXT_TABLES + ['customer', 'supplier'])}) WHERE n_rows > 0
UNION ALL SELECT tbl, 'policy_applied', 'info', col, NULL, NULL, 'auto', concat('applied ', action) FROM ({o.decisions_sql(TEXT_TABLES + ['customer', 'supplier'], 'auto', False)})""",
        "audit_calls": f"""WITH s AS (SELECT concat(user_id, '_', strftime(ts, '%Y%m%d')) AS sid, min(ts) AS a, max(ts) AS b, count(*) FILTER (WHERE event_type = 'click') AS n FROM events GROUP BY 1)
SELECT strftime(ts, '{_TS}') AS ts, 'backend_call' AS event_type, 'info' AS level, CAST(user_id AS VARCHAR) AS session_id, event_type AS operation,
 value AS duration_ms, event_type <> 'error' AS success, CAST(NULL AS BIGINT) AS total_invocations FROM events
UNION ALL SELECT strftime(ts, '{_TS}'), 'error', 'error', CAST(user_id AS VARCHAR), event_type, NULL, false, NULL FROM events WHERE event_type = 'error'
UNION ALL SELECT strftime(a, '{_TS}'), 'session_start', 'info', sid, NULL, NULL, NULL, NULL FROM s
UNION ALL SELECT strftime(b, '{_TS}'), 'session_end', 'info', sid, NULL, NULL, NULL, n FROM s""",
        "audit_by_user": f"SELECT user_id, strftime(min(ts), '{_TS}') AS first_ts, strftime(max(ts), '{_TS}') AS last_ts, count(*) AS n_events, "
        "string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS event_types, arg_max(event_type, (ts, event_type)) AS last_event_type FROM events GROUP BY user_id",
        "audit_timing": "SELECT event_type, count(*) AS n_calls, count(*) FILTER (WHERE event_type <> 'error') AS n_success, round(avg(value), 2) AS avg_ms, "
        "min(value) AS min_ms, max(value) AS max_ms FROM events GROUP BY event_type",
        "audit_sessions": f"SELECT concat(user_id, '_', strftime(ts, '%Y%m%d')) AS session_id, strftime(min(ts), '{_TS}') AS started_at, strftime(max(ts), '{_TS}') AS ended_at, "
        "count(*) FILTER (WHERE event_type = 'click') AS total_invocations, count(*) AS n_events FROM events GROUP BY 1",
        "audit_windows": windows + "GROUP BY w, event_type",
        "stream_redact_documents": o.redact_query("documents", "doc_id", "text", f"b.doc_id, clean AS text, {tok('b.source')} AS source"),
        "stream_quarantine": f"SELECT page_id, {o.any_hit('url')} OR {o.any_hit('html')} AS held FROM pages",
        "stream_audit_windows": windows + "GROUP BY w, event_type",
    }
