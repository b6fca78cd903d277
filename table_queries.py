"""Registered queries of the jobs over rule tables, logs, indexes and streams, and their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import oracles as o
from cloakframe.operators import heavy, incremental, rule_table, sketches, trail
from cloakframe.operators.audit import backend_report
from cloakframe.operators.profile import profile_table, supported_types
from cloakframe.operators.protect import hash_table
from cloakframe.operators.relational import array_rows
from cloakframe.plans.policy import apply_policy, ensure_checkpoint_dir
from cloakframe.plans.request import Request
from cloakframe.plans.secure import Settings, deliver, secure_query
from cloakframe.rules import Rules
from cloakframe.sources import inventory, token_index
from cloakframe.sources.audit_log import AUDIT_SCHEMA
from cloakframe.sources.files import read_table, stream_table
from cloakframe.sources.profiles import get_profile
from cloakframe.streaming import audit_sink, learning, sessions

SALT = "entry-salt-for-checks"
STAMP, _TS = "yyyy-MM-dd HH:mm:ss.SSSSSS", "%Y-%m-%d %H:%M:%S.%f"
Query = Callable[[SparkSession, str], DataFrame]


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A folder of its own for a query's files, in the shared folder."""
    return f"{ensure_checkpoint_dir(spark)}/jobs-{uuid.uuid4().hex}"


def stamp(c: str) -> F.Column:
    return F.date_format(c, STAMP)


def stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return stream_table(spark, f"{sf}/{name}.parquet")


# -- names and rules ------------------------------------------------------------------------
# Names and rules out of the words of the tables (valid in both engines).
_WORDS = "lower(replace(p_name, ' ', '_'))"
_NAMES = (
    "SELECT concat(event_type, '_', " + _WORDS + ", '_', CAST(user_id AS STRING)) AS column_name, "
    "CASE WHEN event_id % 2 = 0 THEN 'snowflake' ELSE 'trino' END AS backend FROM {events} JOIN {part} ON event_id % 200 = p_partkey"
)
_RULES = """SELECT 'contains' AS kind, p_partkey * 10 + i AS position, concat(words, '_', CAST((p_partkey * 10 + i) * 7 % 5000 AS STRING)) AS text, CAST(NULL AS STRING) AS backend
 FROM (SELECT p_partkey, WORDS AS words, SERIES AS i FROM {part})
UNION ALL SELECT 'contains', 1000000000 + c_custkey, concat('_', substring(c_name, 1, 4), '_', CAST(c_custkey AS STRING)), NULL FROM {customer}
UNION ALL SELECT 'contains', 2000000000, 'ut_', NULL
UNION ALL SELECT 'exact', p_partkey, concat('click_', WORDS, '_', CAST(p_partkey % 150 AS STRING)), NULL FROM {part} WHERE p_partkey % 5 = 0
UNION ALL SELECT 'backend', p_partkey, concat('view_', WORDS, '_', CAST(p_partkey % 150 AS STRING)), 'snowflake' FROM {part} WHERE p_partkey % 3 = 0""".replace("WORDS", _WORDS)


def label_by_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Names out of ``events`` and ``part`` under ten rules a part and one a customer (21,500 at sf0.01 and 215,000 at sf0.1)."""
    events, part, customer = (t(spark, sf, n) for n in ("events", "part", "customer"))
    rules = spark.sql(_RULES.replace("SERIES", "explode(sequence(0, 9))"), part=part, customer=customer)
    names = spark.sql(_NAMES, events=events, part=part)
    index = rule_table.rule_index(rules)
    out = rule_table.label_by_rules(names, index, backend="backend", patterns=(r"purchase_.*_1\d$",))
    return out.select("column_name", "backend", "n_rows", "is_pii", "match_reason")


# -- profile of changing files ------------------------------------------------------------------
def profile_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in four folders; then one is added, one replaced and one deleted. Only changed files are scanned again."""
    docs, out = t(spark, sf, "documents"), scratch(spark)
    part = lambda i: docs.where(f"doc_id % 4 = {i}")
    put = lambda df, i: df.write.mode("overwrite").parquet(f"{out}/data/p{i}")
    for i in (0, 1, 2):
        put(part(i), i)
    incremental.refresh_profile(spark, f"{out}/data", f"{out}/log", docs.schema)
    put(part(3), 3)
    put(part(1).withColumn("text", F.expr("IF(lang = 'en', concat('mail me@example.org ', source), text)")), 1)
    put(part(2).limit(0), 2)
    incremental.refresh_profile(spark, f"{out}/data", f"{out}/log", docs.schema)
    return incremental.stored_profile(spark, f"{out}/log", docs.schema).select("path", "pii_type", "n_rows", "rows_scanned")


# -- tokens ---------------------------------------------------------------------------------------
def linkage_heavy(spark: SparkSession, sf: str) -> DataFrame:
    """Orders and customers by token, where one token holds a third of the orders and a thirtieth of the customers."""
    orders = t(spark, sf, "orders").selectExpr("IF(o_orderkey % 3 = 0, -1, o_custkey) AS buyer", "o_orderstatus", "o_orderkey")
    customers = t(spark, sf, "customer").selectExpr("IF(c_custkey % 30 = 0, -1, c_custkey) AS c_custkey", "c_mktsegment", "c_nationkey")
    return heavy.link_heavy(
        hash_table(orders, SALT, ["buyer"]), hash_table(customers, SALT, ["c_custkey"]), "buyer", "c_custkey",
        by=["o_orderstatus", "c_mktsegment"], sums={"orders": "o_orderkey", "nations": "c_nationkey"},
    )


def _contacts(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "customer").selectExpr("c_custkey", "concat('user', CAST(c_custkey AS STRING), '@example.com') AS contact", "c_mktsegment")


def token_index_lookup(spark: SparkSession, sf: str) -> DataFrame:
    table = f"contacts_{uuid.uuid4().hex}"
    token_index.build_token_index(_contacts(spark, sf), "contact", SALT, table, f"{scratch(spark)}/{table}", buckets=16)
    return token_index.lookup(spark, table, "user42@example.com", SALT)


def token_index_link(spark: SparkSession, sf: str) -> DataFrame:
    a, b = (f"{n}_{uuid.uuid4().hex}" for n in ("orders", "customer"))
    orders = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    token_index.build_token_index(orders, "o_custkey", SALT, a, f"{scratch(spark)}/{a}", buckets=16)
    token_index.build_token_index(t(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", SALT, b, f"{scratch(spark)}/{b}", buckets=16)
    return token_index.link_indexes(spark, a, b)


def agg_array_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The quantities of each return flag in order, as rows: three groups hold the whole table."""
    lines = t(spark, sf, "lineitem").select("l_returnflag", F.expr("nullif(l_quantity, 7)").alias("quantity"))
    return array_rows(lines, "quantity", ["l_returnflag"])


# -- the audit log ---------------------------------------------------------------------------------
def _lines(events: DataFrame) -> DataFrame:
    """Events as JSON lines: every third comes twice, some are broken, not known or without a time."""
    event = F.struct(
        F.when(F.col("event_id") % 53 != 7, stamp("ts")).alias("ts"),
        F.when(F.col("event_id") % 41 == 5, F.lit("no_such_event")).otherwise("backend_call").alias("event_type"),
        F.concat(F.lit("inv_"), "event_id").alias("invocation_id"), F.col("event_type").alias("operation"), F.col("value").alias("duration_ms"),
        (F.col("event_type") != "error").alias("success"),
    )
    json = F.to_json(event)
    line = F.when(F.col("event_id") % 47 == 11, F.substring(json, 1, 25)).otherwise(json)
    copies = F.when(F.col("event_id") % 3 == 0, F.array(line, line)).otherwise(F.array(line))
    return events.select(F.explode(copies).alias("value"))


def stream_audit_sink(spark: SparkSession, sf: str) -> DataFrame:
    out = scratch(spark)
    for q in audit_sink.audit_sink(_lines(stream(spark, sf, "events")), f"{out}/events", f"{out}/bad", f"{out}/state"):
        q.awaitTermination()
    good = audit_sink.read_sink(spark, f"{out}/events").select("invocation_id", "event_type", "operation", "duration_ms", "success", F.lit(1).cast("long").alias("n_lines"))
    bad = spark.read.schema("line string").parquet(f"{out}/bad/batch=*").groupBy("line").agg(F.count(F.lit(1)).alias("n_lines"))
    bad = bad.select(F.col("line").alias("invocation_id"), *[F.lit(None).cast(k).alias(c) for c, k in (("event_type", "string"), ("operation", "string"), ("duration_ms", "double"), ("success", "boolean"))], "n_lines")
    return good.unionByName(bad)


_GAP = "20 minutes"


def gap_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """A user's events that follow each other by 20 minutes at most."""
    return _session_rows(sessions.gap_sessions(t(spark, sf, "events"), "user_id", gap=_GAP, invocation=F.col("event_type") == "click"))


def _session_rows(df: DataFrame) -> DataFrame:
    return df.select("user_id", stamp("started_at").alias("started_at"), stamp("ended_at").alias("ended_at"), "n_events", "total_invocations")


def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """The same out of a stream of two batches, of which the second holds late events that join sessions; a last event lets all of them close."""
    out = scratch(spark)
    events = t(spark, sf, "events")
    last = events.orderBy(F.desc("ts")).limit(1).withColumns({"event_id": F.lit(-1).cast("long"), "user_id": F.lit(-1).cast("long"), "ts": F.expr("ts + INTERVAL 90 DAYS")})
    for batch, rows in enumerate((events.where("event_id % 5 <> 0"), events.where("event_id % 5 = 0"), last)):
        rows.write.mode("append").parquet(f"{out}/source/b{batch}")
        source = spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(f"{out}/source")
        sessions.sessions_stream(source, "user_id", f"{out}/data", f"{out}/state", gap=_GAP, invocation=F.col("event_type") == "click", lateness="60 days").awaitTermination()
    schema = "user_id long, started_at timestamp, ended_at timestamp, n_events long, total_invocations long"
    return _session_rows(spark.read.schema(schema).parquet(f"{out}/data/batch=*").where("user_id >= 0"))


def stream_learning(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in three batches: the text is found to hold personal data in the first, the source not before the second."""
    out, docs = scratch(spark), t(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    parts = [docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 = 1").withColumn("source", F.expr("IF(doc_id % 2 = 0, concat('by ', source, '@example.org'), source)")), docs.where("doc_id % 3 = 2")]
    for i, rows in enumerate(parts):
        rows.write.mode("append").parquet(f"{out}/source/b{i}")
        source = spark.readStream.schema(docs.schema).option("recursiveFileLookup", "true").parquet(f"{out}/source")
        learning.learning_stream(source, f"{out}/data", f"{out}/versions", f"{out}/state", SALT).awaitTermination()
    return learning.read_learned(spark, f"{out}/data", docs.columns)


def audit_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """p95 and distinct users of 1, 6 and 24 hours out of one stored hourly table, beside the exact numbers."""
    events, out = t(spark, sf, "events"), scratch(spark)
    sketches.hourly_sketches(events, ["event_type"], "value", "user_id").write.parquet(f"{out}/hourly")
    hourly = spark.read.parquet(f"{out}/hourly")
    parts = []
    for hours in (1, 6, 24):
        near = sketches.span_report(hourly, ["event_type"], hours).withColumnRenamed("event_type", "kind")
        start = F.window("ts", f"{hours} hours")["start"].cast("timestamp_ntz")
        met = events.select(start.alias("s"), "event_type", "user_id", "value").join(near, (F.col("s") == F.col("span_start")) & (F.col("event_type") == F.col("kind")))
        exact = met.groupBy("span_start", "event_type").agg(
            F.countDistinct("user_id").alias("exact_users"), F.first("users").alias("users"), F.first("n_events").alias("n_events"), F.round(F.first("avg_value"), 6).alias("avg_value"),
            F.count_if(F.col("value") < F.col("p")).alias("below"), F.count_if(F.col("value") <= F.col("p")).alias("upto"),
        )
        close = "abs(users - exact_users) <= 0.03 * exact_users AND below <= 0.95 * n_events + 0.02 * n_events + 1 AND upto >= 0.95 * n_events - 0.02 * n_events - 1"
        parts.append(exact.select(F.lit(hours).cast("long").alias("hours"), stamp("span_start").alias("span_start"), "event_type", "n_events", "exact_users", "avg_value", F.expr(close).alias("close")))
    return reduce(DataFrame.unionByName, parts)


def audit_p95(spark: SparkSession, sf: str) -> DataFrame:
    """The report's p95, and between which shares of the calls it lies."""
    events = t(spark, sf, "events")
    report = backend_report(events, ["event_type"], "value", success=F.lit(True), rows=None).select("event_type", "p95_ms", "n_calls")
    ranks = events.join(report, "event_type").groupBy("event_type").agg(
        F.first("n_calls").alias("n_calls"), F.count_if(F.expr("value < p95_ms")).alias("below"), F.count_if(F.expr("value <= p95_ms")).alias("upto")
    )
    return ranks.select("event_type", "n_calls", F.expr("below <= 0.951 * n_calls AND upto >= 0.949 * n_calls").alias("p95_near"))


# The events of an invocation, ten minutes apart or less; some trails have a fault (valid in both engines).
_STEPS = ("tool_invocation", "pii_detected", "policy_applied", "backend_call", "session_end")


def _trail_events(events: DataFrame) -> DataFrame:
    kinds = F.array(*[F.struct(F.lit(k).alias("event_type"), F.lit(i + 1).alias("i")) for i, k in enumerate(_STEPS)])
    fault = F.col("event_id") % 12
    steps = (
        F.when(fault <= 4, F.filter(kinds, lambda k: k["i"] != fault + 1))  # one step is missing
        .when(fault == 5, F.concat(kinds, F.slice(kinds, 1, 1)))  # invoked again at the end
        .when(fault == 6, F.concat(kinds, F.slice(kinds, 5, 1)))  # ends twice
        .when(fault == 7, F.concat(F.slice(kinds, 1, 2), F.slice(kinds, 4, 1), F.slice(kinds, 3, 1), F.slice(kinds, 5, 1)))  # the policy comes after the call
        .when(fault == 8, F.concat(F.slice(kinds, 1, 1), F.array(F.struct(F.lit("access_denied").alias("event_type"), F.lit(9).alias("i")))))  # refused: complete
        .when(fault == 9, F.concat(F.slice(kinds, 1, 2), F.slice(kinds, 2, 4)))  # two detections: complete
        .otherwise(kinds)
    )
    rows = events.select(F.concat(F.lit("inv_"), "event_id").alias("invocation_id"), "ts", F.posexplode(steps).alias("pos", "s"))
    return rows.select("invocation_id", F.expr("ts + make_interval(0, 0, 0, 0, 0, pos)").alias("ts"), F.col("s.event_type").alias("event_type"))


def audit_trail(spark: SparkSession, sf: str) -> DataFrame:
    out = trail.trail_faults(_trail_events(t(spark, sf, "events")))
    return out.select("invocation_id", "n_events", F.array_join("faults", ",").alias("faults"), "complete")


# -- listings, policies, rules of one's own -----------------------------------------------------------
_PREFIXES = """SELECT DISTINCT prefix FROM (
 SELECT concat(split_part(url, '/', 1), '//', split_part(url, '/', 3), '/') AS prefix FROM {pages} WHERE page_id % 7 = 0
 UNION ALL SELECT concat(split_part(url, '/', 1), '//', split_part(url, '/', 3), '/', split_part(url, '/', 4), '/') FROM {pages} WHERE page_id % 3 = 0
 UNION ALL SELECT substring(url, 1, 9 + CAST(page_id % 5 AS INT)) FROM {pages} WHERE page_id % 11 = 0
 UNION ALL SELECT url FROM {pages} WHERE page_id % 5 = 0) AS p"""


def prefix_match(spark: SparkSession, sf: str) -> DataFrame:
    """Page addresses under a list of prefixes of any lengths, with the longest that allows each."""
    pages = t(spark, sf, "pages").select("page_id", F.col("url").alias("key"))
    prefixes = spark.sql(_PREFIXES, pages=t(spark, sf, "pages"))
    return inventory.longest_prefix(inventory.allowed_by_prefixes(pages, prefixes), prefixes)


def object_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as objects in a folder for each language: the objects found, their kinds, and the rows that each folder holds."""
    out = scratch(spark)
    t(spark, sf, "documents").write.partitionBy("lang").json(f"{out}/store")  # each task writes what it reads
    found = inventory.list_objects(spark, f"{out}/store", prefix="lang=", allowed_prefixes=["lang=", "x/"])
    found = found.groupBy(F.substring_index("key", "/", 1).alias("folder"), "content_type").agg(F.bool_and(F.col("size_bytes") > 0).alias("filled"))
    rows = spark.read.json(f"{out}/store").groupBy(F.concat(F.lit("lang="), "lang").alias("folder")).agg(F.count(F.lit(1)).alias("n_rows"))
    return found.join(rows, "folder")


def prefix_listing(spark: SparkSession, sf: str) -> DataFrame:
    """The sites of the pages as common prefixes one level below the scheme, as folders of an object store are listed."""
    listing = t(spark, sf, "pages").select(F.col("url").alias("key"))
    return inventory.list_prefixes(listing, "https://")


def types_in_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The supported types, with the number of documents that hold each."""
    held = profile_table(t(spark, sf, "documents"), columns=["text"]).select(F.col("pii_type").alias("kind"), "n_rows")
    types = supported_types(spark).select("pii_type", "sensitivity", "default_action")
    return types.join(held, F.col("pii_type") == F.col("kind")).select("pii_type", "sensitivity", "default_action", "n_rows")


def partition_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written by status and priority: the partitions found in the listing, with their rows."""
    out = scratch(spark)
    orders = t(spark, sf, "orders")
    orders.write.partitionBy("o_orderstatus", "o_orderpriority").parquet(f"{out}/orders")
    found = inventory.list_partitions(inventory.objects(spark, f"{out}/orders"))
    rows = spark.read.parquet(f"{out}/orders").groupBy(F.col("o_orderstatus").cast("string").alias("status"), F.col("o_orderpriority").cast("string").alias("priority")).agg(F.count(F.lit(1)).alias("n_rows"))
    met = found.select(F.col("values")[0].alias("status"), F.col("values")[1].alias("priority"), F.element_at(F.split("location", "/"), -2).alias("folder"))
    return met.join(rows, ["status", "priority"])


def result_envelope(spark: SparkSession, sf: str) -> DataFrame:
    """Results of a deployment that returns 150 rows at most: what comes, and whether rows are missing, out of one pass over 151."""
    out = None
    for name, key in (("documents", "doc_id"), ("pages", "page_id"), ("customer", "c_custkey"), ("nation", "n_nationkey")):
        profile = get_profile("databricks").with_tables(lambda _spark, _entity, df=t(spark, sf, name): df)
        request = Request("databricks", "the first rows", "customers", order_by=(key,), pii_policy="mask")
        result = secure_query(spark, request, Settings(salt=SALT, max_rows=150), profile)
        s = result.summary.select(F.lit(name).alias("tbl"), "row_count", F.array_join("pii_types", ",").alias("pii_types"), F.lit(result.metadata["truncated"]).alias("truncated"))
        keys = result.df.agg(F.min(key).cast("long").alias("low"), F.max(key).cast("long").alias("high")).withColumn("tbl", F.lit(name))
        columns = ("row_count", "pii_types", "truncated", "low", "high")
        part = s.unionByName(keys, allowMissingColumns=True).groupBy("tbl").agg(*[F.max(c).alias(c) for c in columns])
        out = part if out is None else out.unionByName(part)
    return out


def delivered_envelope(spark: SparkSession, sf: str) -> DataFrame:
    """Whole tables, and the first 150 rows of one, masked and written in one pass: what was observed on the way, and the rows that were written."""
    parts = []
    for name, key, most in (("documents", "doc_id", None), ("pages", "page_id", 150), ("conversations", "conv_id", None)):
        profile = get_profile("databricks").with_tables(lambda _spark, _entity, df=t(spark, sf, name): df)
        request = Request("databricks", "all the rows", "customers", order_by=(key,) if most else (), pii_policy="mask")
        result = deliver(spark, request, f"{scratch(spark)}/{name}", Settings(salt=SALT, max_rows=most), profile)
        s = result.summary.select("row_count", F.array_join("pii_types", ",").alias("pii_types"), F.lit(result.metadata.get("truncated", False)).alias("truncated"))
        rows = result.df.agg(F.count(F.lit(1)).alias("written"), F.max(key).cast("long").alias("high"))
        columns = ("row_count", "pii_types", "truncated", "written", "high")
        parts.append(s.unionByName(rows, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in columns]).withColumn("tbl", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def policy_empty(spark: SparkSession, sf: str) -> DataFrame:
    """No rows pass every policy, and say that nothing was found."""
    out = None
    for name, none in (("customer", "c_custkey < 0"), ("documents", "doc_id < 0"), ("pages", "page_id < 0")):
        for policy in ("mask", "hash", "deny", "auto"):
            result = apply_policy(t(spark, sf, name).where(none), policy, salt=SALT)
            s = result.summary.select(F.lit(name).alias("tbl"), "policy_applied", "row_count", "pii_detected", F.array_join("columns_processed", ",").alias("columns_processed"))
            out = s if out is None else out.unionByName(s)
    return out


_OWN = {
    "detection_patterns": {"order_no": {"pattern": r"Customer#\d{9}", "sensitivity": "high", "default_action": "mask", "description": "customer numbers"}},
    "column_classifications": {"exact": ["c_name"], "contains": ["mktseg"], "patterns": [r"_acct"]},
    "sensitivity_levels": {"high": {"allowed_policies": ["mask", "hash", "deny"]}},
    "backend_overrides": {"trino": {"additional_pii_columns": ["c_nationkey"]}},
}


def custom_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rules of a policy file with masks of one's own: names masked but for their start, and all columns labelled."""
    from cloakframe.rules import Mask

    rules = Rules.from_dict(_OWN).with_masks(order_no=Mask(keep_start=9, char="x"))
    customers = t(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    out = apply_policy(customers, "mask", rules, backend="trino").df
    labels = F.lit(",".join(rules.named_pii(t(spark, sf, "customer").columns, "trino")))
    return out.select("c_custkey", "c_name", "c_mktsegment", labels.alias("labelled"))


def mask_generic(spark: SparkSession, sf: str) -> DataFrame:
    """Values of a type that has no mask rule: all stars, whatever their length."""
    from cloakframe.functions.mask import mask, mask_by_type

    c = t(spark, sf, "customer")
    return c.selectExpr("c_custkey", f"{mask('c_mktsegment', 'no_such_type')} AS segment", f"{mask_by_type('c_name', 'c_mktsegment')} AS c_name")


_QUERIES: list[Query] = [
    label_by_rules, profile_incremental, linkage_heavy, token_index_lookup, token_index_link, agg_array_rows, stream_audit_sink, gap_sessions, stream_sessions, stream_learning,
    result_envelope, delivered_envelope, audit_sketches, audit_p95, audit_trail, prefix_match, object_listing, prefix_listing, types_in_documents, partition_listing, policy_empty, custom_rules, mask_generic,
]


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in _QUERIES}


# -- SQL twins --------------------------------------------------------------------------------------------
def oracle_sql() -> dict[str, str]:
    tok = lambda x: o.token(x, SALT)
    changed = "CASE WHEN lang = 'en' AND doc_id % 4 = 1 THEN concat('mail me@example.org ', source) ELSE text END"
    docs = f"d AS (SELECT doc_id, {changed} AS text, lang, source, n_chars FROM documents WHERE doc_id % 4 <> 2)"
    sessions_sql = f"""WITH e AS (SELECT *, coalesce(date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts), ts) > 20 * 60 * 1000000, true) AS new FROM events),
s AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT user_id, strftime(min(ts), '{_TS}') AS started_at, strftime(max(ts), '{_TS}') AS ended_at, count(*) AS n_events, count(*) FILTER (WHERE event_type = 'click') AS total_invocations FROM s GROUP BY user_id, n"""
    first = lambda n, k: f"(SELECT * FROM {n} ORDER BY {k} LIMIT 150)"
    good = "event_id % 53 <> 7 AND event_id % 41 <> 5 AND event_id % 47 <> 11"
    event_json = (
        "concat('{{', CASE WHEN event_id % 53 <> 7 THEN concat('\"ts\":\"', strftime(ts, '{f}'), '\",') ELSE '' END, '\"event_type\":\"', "
        "CASE WHEN event_id % 41 = 5 THEN 'no_such_event' ELSE 'backend_call' END, '\",\"invocation_id\":\"inv_', event_id, '\",\"operation\":\"', event_type, "
        "'\",\"duration_ms\":', value, ',\"success\":', event_type <> 'error', '}}')"
    ).format(f=_TS)
    return {
        "label_by_rules": f"""WITH n AS (SELECT column_name, backend, lower(column_name) AS low, count(*) AS n_rows FROM ({_NAMES.format(events="events", part="part")}) GROUP BY ALL),
r AS ({_RULES.replace("SERIES", "unnest(range(0, 10))").format(part="part", customer="customer")}),
c AS (SELECT low, arg_min(lower(text), position) AS text FROM (SELECT DISTINCT low FROM n) JOIN (SELECT * FROM r WHERE kind = 'contains') ON contains(low, lower(text)) GROUP BY low),
l AS (SELECT n.*, CASE WHEN n.low IN (SELECT lower(text) FROM r WHERE kind = 'exact') THEN 'exact_match' WHEN c.text IS NOT NULL THEN concat('contains_pattern:', c.text)
  WHEN regexp_matches(n.low, 'purchase_.*_1[0-9]$') THEN 'regex_pattern:purchase_.*_1\\d$'
  WHEN n.backend = 'snowflake' AND n.low IN (SELECT lower(text) FROM r WHERE kind = 'backend') THEN 'backend_override:snowflake' END AS match_reason
 FROM n LEFT JOIN c ON c.low = n.low)
SELECT column_name, backend, n_rows, match_reason IS NOT NULL AS is_pii, match_reason FROM l""",
        "profile_incremental": f"WITH {docs} SELECT path, pii_type, n_rows, rows_scanned FROM ({o.profile_sql(['documents']).replace('FROM documents', 'FROM d')})",
        "linkage_heavy": """SELECT o_orderstatus, c_mktsegment, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS orders, CAST(sum(c_nationkey) AS BIGINT) AS nations
FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_custkey END AS k, * FROM orders) JOIN (SELECT CASE WHEN c_custkey % 30 = 0 THEN -1 ELSE c_custkey END AS k, * FROM customer) USING (k) GROUP BY ALL""",
        "token_index_lookup": f"SELECT {tok('contact')} AS token, c_custkey, c_mktsegment FROM (SELECT c_custkey, c_mktsegment, concat('user', c_custkey, '@example.com') AS contact FROM customer) WHERE contact = 'user42@example.com'",
        "token_index_link": f"SELECT {tok('CAST(o_custkey AS VARCHAR)')} AS token, o_orderkey, o_orderstatus, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
        "agg_array_rows": "SELECT l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY quantity NULLS LAST) AS position, quantity FROM (SELECT l_returnflag, nullif(l_quantity, 7) AS quantity FROM lineitem)",
        "stream_audit_sink": f"""SELECT concat('inv_', event_id) AS invocation_id, 'backend_call' AS event_type, event_type AS operation, value AS duration_ms, event_type <> 'error' AS success, CAST(1 AS BIGINT) AS n_lines
 FROM events WHERE {good}
UNION ALL SELECT line, NULL, NULL, NULL, NULL, CAST(sum(n) AS BIGINT) FROM (SELECT CASE WHEN event_id % 47 = 11 THEN substring({event_json}, 1, 25) ELSE {event_json} END AS line, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS n
 FROM events WHERE NOT ({good})) GROUP BY line""",
        "gap_sessions": sessions_sql,
        "stream_sessions": sessions_sql,
        "stream_learning": f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, CASE WHEN doc_id % 3 = 1 AND doc_id % 2 = 0 THEN concat('by ', source, '@example.org') ELSE source END AS source, doc_id % 3 AS batch FROM documents),
k AS (SELECT (SELECT min(batch) FROM d WHERE {o.any_hit('text')}) AS text_since, (SELECT min(batch) FROM d WHERE {o.any_hit('source')}) AS source_since)
SELECT doc_id, CASE WHEN batch >= text_since THEN {tok('text')} ELSE text END AS text, lang, CASE WHEN batch >= source_since THEN {tok('source')} ELSE source END AS source, batch FROM d, k""",
        "audit_sketches": " UNION ALL ".join(
            f"SELECT CAST({h} AS BIGINT) AS hours, strftime(time_bucket(INTERVAL {h} HOURS, ts, TIMESTAMP '1970-01-01'), '{_TS}') AS span_start, event_type, count(*) AS n_events, "
            "count(DISTINCT user_id) AS exact_users, round(avg(value), 6) AS avg_value, true AS close FROM events GROUP BY ALL"
            for h in (1, 6, 24)
        ),
        "audit_p95": "SELECT event_type, count(*) AS n_calls, true AS p95_near FROM events GROUP BY event_type",
        "audit_trail": """WITH f AS (SELECT event_id, event_id % 12 AS f FROM events)
SELECT concat('inv_', event_id) AS invocation_id, CAST(CASE WHEN f <= 4 THEN 4 WHEN f IN (5, 6, 9) THEN 6 WHEN f = 8 THEN 2 ELSE 5 END AS BIGINT) AS n_events,
 CASE f WHEN 0 THEN 'missing:invocation' WHEN 2 THEN 'missing:policy' WHEN 3 THEN 'missing:call' WHEN 4 THEN 'missing:end'
  WHEN 5 THEN 'repeated:invocation,misplaced:invocation' WHEN 6 THEN 'repeated:end' WHEN 7 THEN 'misplaced:policy' ELSE '' END AS faults,
 f NOT IN (0, 2, 3, 4, 5, 6, 7) AS complete FROM f""",
        "prefix_match": f"""WITH p AS ({_PREFIXES.format(pages="pages")}), m AS (SELECT page_id, url, prefix FROM pages JOIN p ON starts_with(url, prefix))
SELECT page_id, url AS key, arg_max(prefix, length(prefix)) AS matched_prefix FROM m GROUP BY page_id, url""",
        "object_listing": "SELECT concat('lang=', lang) AS folder, 'application/json' AS content_type, true AS filled, count(*) AS n_rows FROM documents GROUP BY lang",
        "prefix_listing": "SELECT DISTINCT concat('https://', split_part(substring(url, 9), '/', 1), '/') AS prefix FROM pages WHERE starts_with(url, 'https://') AND contains(substring(url, 9), '/')",
        "types_in_documents": " UNION ALL ".join(
            f"SELECT '{k}' AS pii_type, '{o.SENSITIVITY[k]}' AS sensitivity, '{o.ACTION[k]}' AS default_action, count(*) FILTER (WHERE {o.hit('text', k)}) AS n_rows FROM documents" for k in o.TYPES
        ),
        "partition_listing": "SELECT o_orderstatus AS status, o_orderpriority AS priority, concat('o_orderstatus=', o_orderstatus) AS folder, count(*) AS n_rows FROM orders GROUP BY ALL",
        "result_envelope": " UNION ALL ".join(
            f"SELECT '{n}' AS tbl, max(rows_scanned) AS row_count, coalesce(string_agg(DISTINCT pii_type, ',' ORDER BY pii_type) FILTER (WHERE n_rows > 0), '') AS pii_types, "
            f"(SELECT count(*) > 150 FROM {n}) AS truncated, (SELECT CAST(min({k}) AS BIGINT) FROM {first(n, k)}) AS low, (SELECT CAST(max({k}) AS BIGINT) FROM {first(n, k)}) AS high "
            f"FROM ({o.profile_sql([n]).replace(f'FROM {n}', f'FROM {first(n, k)}')})"
            for n, k in (("documents", "doc_id"), ("pages", "page_id"), ("customer", "c_custkey"), ("nation", "n_nationkey"))
        ),
        "delivered_envelope": " UNION ALL ".join(
            f"SELECT '{n}' AS tbl, max(rows_scanned) AS row_count, max(rows_scanned) AS written, coalesce(string_agg(DISTINCT pii_type, ',' ORDER BY pii_type) FILTER (WHERE n_rows > 0), '') AS pii_types, "
            f"(SELECT count(*) > 150 FROM {n}) AND {bool(most)} AS truncated, (SELECT CAST(max({k}) AS BIGINT) FROM {first(n, k) if most else n}) AS high "
            f"FROM ({o.profile_sql([n]).replace(f'FROM {n}', f'FROM {first(n, k) if most else n}')})"
            for n, k, most in (("documents", "doc_id", None), ("pages", "page_id", 150), ("conversations", "conv_id", None))
        ),
        "policy_empty": "SELECT tbl, policy_applied, (SELECT count(*) FROM customer WHERE c_custkey < 0) AS row_count, false AS pii_detected, '' AS columns_processed "
        "FROM (VALUES ('customer'), ('documents'), ('pages')) AS a(tbl), (VALUES ('mask'), ('hash'), ('deny'), ('auto')) AS b(policy_applied)",
        "custom_rules": "SELECT c_custkey, concat('Customer#', repeat('x', length(c_name) - 9)) AS c_name, c_mktsegment, 'c_name,c_nationkey,c_acctbal,c_mktsegment' AS labelled FROM customer",
        "mask_generic": "SELECT c_custkey, repeat('*', length(c_mktsegment)) AS segment, repeat('*', length(c_name)) AS c_name FROM customer",
    }
