"""Screening, audit, inventory and streaming jobs."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from cloakframe.functions.tokens import token_of
from cloakframe.operators import audit, screen
from cloakframe.operators.protect import redact_table
from cloakframe.operators.profile import profile_table
from cloakframe.plans.policy import decisions
from cloakframe.sources import inventory
from cloakframe.sources.audit_log import AUDIT_SCHEMA, append_audit, append_audit_stream, read_audit
from cloakframe.sources.files import read_table
from cloakframe.streaming.protect import append_stream, protect_stream, quarantine_stream
from cloakframe.streaming.windows import audit_counts

SALT = "test-salt-123"
REQUEST = (
    "backend string, intent string, entity string, filters map<string,string>, aggregations array<string>, "
    "group_by array<string>, order_by array<string>, limit int, pii_policy string"
)


def request(backend="trino", intent="show all orders", entity=None, filters=None, group_by=None, limit=100):
    return (backend, intent, entity, filters or {}, [], group_by or [], [], limit, "mask")


# -- screening -----------------------------------------------------------------
INTENTS = {
    "SELECT * FROM users": r"\bSELECT\b", "select name": r"\bSELECT\b", "data from sales": r"\bFROM\b",
    "x WHERE y": r"\bWHERE\b", "JOIN us": r"\bJOIN\b", "INSERT it": r"\bINSERT\b", "update it": r"\bUPDATE\b",
    "Delete it": r"\bDELETE\b", "DROP TABLE users": r"\bDROP\b", "create it": r"\bCREATE\b", "alter it": r"\bALTER\b",
    "grant it": r"\bGRANT\b", "revoke it": r"\bREVOKE\b", "get it; ": r";\s*$", "get -- it": "--", "get /* it": r"/\*",
    "selected fromage": None, "get; it": None, "éfrom": None, "from²": None, "ſelect it": r"\bSELECT\b", None: None,
    "Get total sales by region": None, "": None,
}


def test_sql_patterns(spark):
    df = spark.createDataFrame([(i,) for i in INTENTS], "intent string")
    for r in screen.screen_intents(df).collect():
        assert r.sql_pattern == INTENTS[r.intent], r.intent
        ok = r.intent is not None and 5 <= len(r.intent) <= 500
        assert r.length_ok == ok and r.accepted == (ok and r.sql_pattern is None)


def test_value_screen(spark):
    cases = {"a; --b": True, "a;drop": True, "a ; ": False, "/*": True, "*/": True, "xp_cmd": True, "exec x": True,
             "EXECUTE\tx": True, "executive": False, "plain": False, None: False, "a;é": True}
    df = spark.createDataFrame([(c,) for c in cases], "v string")
    assert {r.v: r.d for r in df.selectExpr("v", screen.dangerous_value("v") + " AS d").collect()} == cases


def test_screen_requests(spark):
    cases = [
        (request(), None, "orders"), (request("ATHENA", "daily clicks"), None, "clickstream"),
        (request("oracle"), "unknown backend", None), (request("s3", "list orders"), "unknown backend", None),
        (request(intent="abc"), "intent length", None), (request(intent="drop orders"), "sql in intent", "orders"),
        (request(limit=0), "limit out of range", "orders"), (request(filters={"a b": "x"}), "filter key", "orders"),
        (request(filters={"a\n": "x"}), "filter key", "orders"),
        (request(group_by=["x-y"]), "group by column", "orders"), (request(intent="show it all"), "no table", None),
        (request(entity="a;b"), "table name", "a;b"), (request(entity="payroll"), "table not allowed", "payroll"),
        (request("snowflake", entity="payroll"), None, "payroll"), (request(entity="EVENTS"), None, "EVENTS"),
        (request("snowflake", "read the logs"), "no table", None), (request("bigquery", "read the logs"), None, "logs"),
    ]
    df = spark.createDataFrame([c[0] for c in cases], REQUEST).coalesce(1)
    got = screen.screen_requests(df).select("reject_reason", "routed_table").collect()
    assert [(r.reject_reason, r.routed_table) for r in got] == [(why, table) for _, why, table in cases]


def test_scan_filters(spark):
    df = spark.createDataFrame([({"m": "a@b.cd", "x": "ok", "n": None},), ({},), (None,)], "filters map<string,string>")
    a, b, c = screen.scan_filters(df, SALT).collect()
    assert a.pii_filters == ["m"] and a.safe_filters == {"m": token_of("a@b.cd", SALT), "x": "ok", "n": None}
    assert a.logged_filters == {"m": "a@***@***.***", "x": "ok", "n": None}
    assert b.pii_filters == [] and c.pii_filters is None


# -- audit ---------------------------------------------------------------------
def test_audit_events_and_log(spark, tmp_path):
    log = str(tmp_path / "log")
    reqs = spark.createDataFrame([request(intent="mail a@b.cd about orders", filters={"k": "v"}), request(intent="drop orders")], REQUEST)
    checked = screen.screen_requests(reqs).withColumn("n", F.monotonically_increasing_id())
    ids = (F.lit(dt.datetime(2024, 1, 1)).cast("timestamp"), F.concat(F.lit("inv_"), "n"), F.lit("sess_1"))
    people = spark.createDataFrame([("a@b.cd", "x")], "email string, first_name string")
    profile = profile_table(people)
    for events in (
        audit.invocation_events(checked, *ids), audit.denial_events(checked, *ids),
        audit.detection_events(profile, ids[0], F.lit("inv_9"), ids[2]),
        audit.policy_events(decisions(profile, "hash"), "hash", ids[0], F.lit("inv_9"), ids[2]),
        audit.event(spark, "session_start", session_id="sess_1"),
        audit.event(spark, "backend_call", backend="trino", operation="query", duration_ms=2.5, success=True, row_count=7),
        audit.event(spark, "error", error_type="X", error_message="y"),
    ):
        append_audit(events, log)
    back = read_audit(spark, log).cache()
    assert back.schema.simpleString() == spark.createDataFrame([], AUDIT_SCHEMA).schema.simpleString()
    kinds = {r.event_type: r.n for r in back.groupBy("event_type").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"tool_invocation": 2, "access_denied": 1, "pii_detected": 1, "policy_applied": 2, "session_start": 1,
                     "backend_call": 1, "error": 1}
    first = back.where("event_type = 'tool_invocation' AND array_contains(filter_keys, 'k')").first()
    assert first.intent == "mail a@***@***.*** about orders" and first.ts == dt.datetime(2024, 1, 1) and first.level == "info"
    assert back.where("event_type = 'access_denied'").first().level == "warning"
    assert back.where("event_type = 'pii_detected'").first().affected_columns == ["email"]
    report = {r.invocation_id: r for r in audit.invocation_report(back.where("invocation_id IS NOT NULL")).collect()}
    assert report["inv_9"].event_types == ["pii_detected", "policy_applied"] and report["inv_9"].n_events == 3
    (call,) = audit.backend_report(back.where("event_type = 'backend_call'")).collect()
    assert (call.n_calls, call.n_success, call.avg_ms, call.rows_returned) == (1, 1, 2.5, 7)
    sess = audit.session_report(back).where("session_id = 'sess_1'").first()
    assert sess.total_invocations == 2
    assert "a@b.cd" not in "".join(p.read_text() for p in tmp_path.rglob("part-*.json"))
    with pytest.raises(ValueError):
        audit.event(spark, "nope")
    with pytest.raises(ValueError):
        audit.event(spark, "error", colour="red")


# -- files ---------------------------------------------------------------------
@pytest.fixture()
def bucket(tmp_path):
    root = tmp_path / "bucket"
    for key in ("a/x.csv", "a/b/y.json", "c/z.parquet", "top.bin"):
        path = root / key
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("12345")
    return str(root)


def test_inventory(spark, bucket):
    rows = inventory.list_objects(spark, bucket).orderBy("key").collect()
    assert [(r.key, r.size_bytes, r.content_type) for r in rows] == [
        ("a/b/y.json", 5, "application/json"), ("a/x.csv", 5, "text/csv"),
        ("c/z.parquet", 5, "application/vnd.apache.parquet"), ("top.bin", 5, "application/octet-stream")]
    assert all(r.last_modified for r in rows)
    assert [r.key for r in inventory.list_objects(spark, bucket, "a/", limit=1).collect()] == ["a/b/y.json"]
    listing = inventory.objects(spark, bucket)
    assert [r.prefix for r in inventory.list_prefixes(listing).collect()] == ["a/", "c/"]
    assert [r.prefix for r in inventory.list_prefixes(listing, "a/").collect()] == ["a/b/"]
    assert inventory.allowed(listing, ["c/", "a/b/"]).count() == 2 and inventory.allowed(listing, []).count() == 4
    wanted = spark.createDataFrame([("c/",), ("a/",), ("a/",)], "p string")
    assert inventory.allowed_by_table(listing, wanted).count() == 3
    plan = listing._jdf.queryExecution().executedPlan().toString()
    assert "content#" not in plan.split("ReadSchema")[-1]
    with pytest.raises(PermissionError):
        inventory.list_objects(spark, bucket, allowed_buckets=["other"])
    for prefix in ("", "b/"):
        with pytest.raises(PermissionError):
            inventory.list_objects(spark, bucket, prefix, allowed_prefixes=["a/"])
    assert inventory.list_objects(spark, bucket, "a/b/", allowed_prefixes=["a/"]).count() == 1


def test_partitions(spark, tmp_path):
    root = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "2024", "x y"), (2, "2024", "z+"), (3, "2025", "z+")], "id int, year string, k string")
    df.write.partitionBy("year", "k").parquet(root)
    got = inventory.list_partitions(inventory.objects(spark, root)).collect()
    assert sorted(r["values"] for r in got) == [["2024", "x y"], ["2024", "z+"], ["2025", "z+"]]
    assert all(r.creation_time and r.location.startswith("file:") for r in got)
    assert inventory.list_partitions(inventory.objects(spark, root), 2).count() == 2


def test_reading_shuffles_only_when_asked(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(100).coalesce(1).write.parquet(path)
    assert "Exchange" not in read_table(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert read_table(spark, path, partitions=5).rdd.getNumPartitions() == 5


def test_screening_equals_checking(spark):
    """A table of requests and single requests get the same verdict."""
    from itertools import product

    from cloakframe.plans.request import Request, RequestError

    aggregations = [[], ["COUNT(*)"], ["count( x ) as n", "Sum(v)"], ["SUM(*)"], ["DROP(x)"], ["approx_percentile(v, .5)"],
                    ["APPROX_PERCENTILE(v, 2)"], ["AVG(v) AS 1n"], ["MAX(v) x"]]
    orders = [[], ["v"], ["v desc", "w NULLS first"], ["1; x"], ["v DOWN"], ["v\n"]]
    rows = [
        ("trino", "show all orders", None, {}, a, g, o, n, p)
        for a, g, o, (n, p) in product(aggregations, [[], ["k"], ["a b"]], orders, [(5, "mask"), (None, "auto"), (5, "nope"), (1001, "mask")])
    ]
    schema = ("backend string, intent string, entity string, filters map<string,string>, aggregations array<string>, "
              "group_by array<string>, order_by array<string>, limit int, pii_policy string")  # fmt: skip
    got = screen.screen_requests(spark.createDataFrame(rows, schema).coalesce(1)).select("reject_reason").collect()
    for r, row in zip(got, rows, strict=True):
        try:
            Request(row[0], row[1], None, {}, tuple(row[4]), tuple(row[5]), tuple(row[6]), row[7], row[8]).checked()
            fine = True
        except RequestError:
            fine = False
        assert fine == (r[0] is None), (row, r[0])


def test_searches_return_all_matches(spark):
    from cloakframe.sources import catalog as cat

    columns = spark.range(150).selectExpr("'d' AS database", "concat('tab', id) AS table", "'' AS description")
    assert cat.search_tables(columns, "tab").count() == 150 and cat.search_tables(columns, "tab", limit=7).count() == 7


# -- streams -------------------------------------------------------------------
def test_stream_equals_batch(spark, sf001, tmp_path):
    src = str(tmp_path / "in")
    spark.read.parquet(f"{sf001}/documents.parquet").repartition(4).write.parquet(src)
    batch = spark.read.parquet(src)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = str(tmp_path / "out")
    append_stream(protect_stream(stream, ["text"], ["source"], SALT), out, str(tmp_path / "cp")).awaitTermination()
    want = redact_table(batch, ["text"]).withColumn("source", F.lit(None).cast("string")).drop("source")
    got = spark.read.parquet(out)
    assert got.drop("source").exceptAll(want).count() == 0 and got.count() == batch.count()
    assert got.where("source NOT LIKE 'HASH_%'").count() == 0


def test_quarantine_is_idempotent(spark, tmp_path):
    src, clean, held = (str(tmp_path / n) for n in ("in", "clean", "held"))
    df = spark.createDataFrame([(1, "a@b.cd"), (2, "ok"), (3, None), (4, "10.0.0.1")], "id int, t string")
    df.write.parquet(src)
    for attempt in ("cp1", "cp2"):  # a fresh checkpoint replays batch 0
        stream = spark.readStream.schema(df.schema).parquet(src)
        quarantine_stream(stream, clean, held, str(tmp_path / attempt)).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(clean).collect()) == [2, 3]
    assert sorted(r.id for r in spark.read.parquet(held).collect()) == [1, 4]


def test_streamed_quarantine_of_a_table_in_many_files(spark, tmp_path):
    pages = spark.createDataFrame([(1, "https://a.org/1", "call 555-123-4567"), (2, "https://a.org/2", "ok"), (3, None, None)], "page_id long, url string, html string")
    pages.repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = registry.stream_quarantine(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, True), (2, False), (3, False)]


def test_streamed_documents_of_a_table_in_many_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, "ok" if i else "write to me@example.org", "en", "web", 2) for i in range(4)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in registry.stream_redact_documents(spark, str(tmp_path)).collect()}
    assert sorted(got) == [0, 1, 2, 3] and got[1].text == "ok" and "me@example.org" not in got[0].text
    assert {r.source for r in got.values()} == {token_of("web", registry.SALT)}


def test_streamed_documents_of_a_table_in_folders_by_a_columns_values(spark, tmp_path):
    docs = spark.createDataFrame([(i, "ok" if i else "write to me@example.org", f"l{i % 2}", f"s{i}", 2) for i in range(4)], "doc_id long, text string, lang string, source string, n_chars long")
    for column in ("lang", "source"):
        docs.repartition(2).write.partitionBy(column).parquet(str(tmp_path / column / "documents.parquet"))
        got = {r.doc_id: r for r in registry.stream_redact_documents(spark, str(tmp_path / column)).collect()}
        assert sorted(got) == [0, 1, 2, 3] and got[1].text == "ok" and "me@example.org" not in got[0].text
        assert all(r.source == token_of(f"s{i}", registry.SALT) for i, r in got.items())


def test_late_events_are_dropped(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()

    def put(name, *events):
        lines = [json.dumps({"ts": ts, "event_type": e}) for ts, e in events]
        (src / name).write_text("\n".join(lines))

    def run():
        stream = spark.readStream.schema("ts timestamp, event_type string").json(str(src))
        append_stream(audit_counts(stream), out, str(tmp_path / "cp")).awaitTermination()

    put("1.json", ("2024-01-01T00:05:00", "error"), ("2024-01-01T00:06:00", "error"), ("2024-01-01T03:00:00", "error"))
    run()
    put("2.json", ("2024-01-01T00:30:00", "error"), ("2024-01-01T05:00:00", "error"))  # the first one is too late
    run()
    rows = spark.read.parquet(out).orderBy("window_start").collect()
    assert [(r.window_start.hour, r.event_type, r.n_events) for r in rows] == [(0, "error", 2), (3, "error", 1)]


def test_audit_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    audit.event(spark, "session_start", session_id="s").write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    append_audit_stream(stream, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    assert read_audit(spark, str(tmp_path / "log")).first().session_id == "s"
