"""Requests: validation, the query algebra, backends, policies on results."""

import datetime as dt

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from cloakframe.functions.tokens import token_of
from cloakframe.operators.relational import aggregate, filter_equal, order_limit
from cloakframe.plans.request import PolicyDenied, Request, RequestError, parse_aggregate, parse_sort
from cloakframe.plans.secure import Settings, observed, plan_request, query_data, secure_query
from cloakframe.sources.profiles import (
    Profile, backends, catalog_tables, connector_tables, file_tables, get_profile, register_profile,
)

SALT = "test-salt-123"
PEOPLE = "id int, email string, city string, age int, ok boolean, score double, born date"
ROWS = [
    (1, "a@b.cd", "Rome", 30, True, 1.5, dt.date(1990, 1, 2)),
    (2, "c@d.ef", "Rome", None, False, 2.5, dt.date(1991, 1, 2)),
    (3, "none", None, 40, True, None, None),
    (4, "none", "Oslo", 40, None, 4.0, dt.date(1990, 1, 2)),
]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(ROWS, PEOPLE)


def over(backend, df):
    return get_profile(backend).with_tables(lambda _spark, _entity: df)


def ask(spark, df, backend="databricks", settings=Settings(salt=SALT), **request):
    spec = {"backend": backend, "intent": "list some people", "entity": "customers", **request}
    return secure_query(spark, Request.from_dict(spec), settings, over(backend, df))


BAD = [
    {"intent": "abc"}, {"intent": "x" * 501}, {"intent": "SELECT everything"}, {"intent": "rows from here"},
    {"intent": "drop it all"}, {"intent": "all of it;"}, {"intent": "all -- of it"}, {"intent": "all /* of it"},
    {"limit": 0}, {"limit": 1001}, {"limit": True}, {"pii_policy": "none"}, {"filters": {"a b": 1}}, {"filters": {"a\n": 1}},
    {"filters": {"x": float("nan")}}, {"filters": {"x": float("inf")}}, {"filters": {"x": [1]}}, {"group_by": ["city"]},
    {"aggregations": ["SUM(a, b)"]}, {"aggregations": ["COUNT(DISTINCT a)"]}, {"aggregations": ["DROP(x)"]},
    {"aggregations": ["SUM(*)"]}, {"aggregations": ["AVG(x, 0.5)"]}, {"order_by": ["a; b"]}, {"order_by": ["a DESC LAST"]},
    {"group_by": ["1x"], "aggregations": ["COUNT(*)"]}, {"unheard": 1},
]


@pytest.mark.parametrize("bad", BAD, ids=lambda b: str(b)[:40])
def test_bad_requests(bad):
    with pytest.raises(RequestError):
        Request.from_dict({"backend": "trino", "intent": "list some people", **bad}).checked()


@pytest.mark.parametrize("intent", [
    "Get total sales by region for Q4 2024", "Show customer counts by region", "Find high-value orders this month",
    "List active users in EMEA", "creates joined selections", "x" * 500])
def test_good_intents(intent):
    assert Request("trino", intent).checked().limit is None


def test_parsing():
    a = parse_aggregate(" sum ( amount ) as Total ")
    assert (a.function, a.column, a.alias) == ("SUM", "amount", "Total")
    assert parse_aggregate("COUNT(*)").alias == "count_all" and parse_aggregate("avg(x)").alias == "avg_x"
    assert parse_aggregate("APPROX_PERCENTILE(x)").percentile == 0.5
    assert parse_aggregate("APPROX_PERCENTILE(x, 0.9)").percentile == 0.9
    s = parse_sort("a desc nulls first")
    assert (s.column, s.descending, s.nulls) == ("a", True, "first") and parse_sort("a").nulls is None


def test_filters(people):
    def ids(f, backend="trino"):
        return sorted(r.id for r in filter_equal(people, f, get_profile(backend)).collect())

    assert ids({"city": "Rome"}) == [1, 2] and ids({"city": "Rome", "age": 30}) == [1] and ids({}) == [1, 2, 3, 4]
    assert ids({"age": None}) == [2] and ids({"age": None}, "snowflake") == [] and ids({"age": None}, "bigquery") == [2]
    assert ids({"ok": True}) == [1, 3] and ids({"score": 2.5}) == [2] and ids({"age": 40.0}) == [3, 4]
    assert ids({"age": 40.5}) == [] and ids({"age": "40"}) == [3, 4] and ids({"born": "1990-01-02"}) == [1, 4]
    assert ids({"city": 5}) == []
    for bad in ({"nope": 1}, {"age": True}, {"ok": 1}, {"city": True}):
        with pytest.raises(RequestError):
            ids(bad)


def test_aggregates(people):
    out = aggregate(people, ["COUNT(*)", "COUNT(age) AS n", "ARRAY_AGG(age) AS ages", "BOOL_AND(ok) AS b", "MAX(score)"], ["city"])
    assert out.columns == ["count_all", "n", "ages", "b", "max_score", "city"]
    rows = {r.city: r for r in out.collect()}
    assert rows["Rome"].ages == [30, None] and rows["Rome"].n == 1 and rows["Rome"].b is False and rows[None].b is True
    one = aggregate(people, ["SUM(age) AS s", "ARBITRARY(city) AS c", "EVERY(ok) AS e", "APPROX_DISTINCT(city) AS d"]).first()
    assert one.s == 110 and one.c in ("Rome", "Oslo") and one.e is False and one.d == 2
    assert aggregate(people, ["APPROX_PERCENTILE(age, 0.5) AS p"]).first().p == 40
    for bad in (["SUM(nope)"], ["COUNT(*) AS city"]):
        with pytest.raises(RequestError):
            aggregate(people, bad, ["city"])


def test_null_order(people):
    def ages(order, backend):
        return [r.age for r in order_limit(people, [order, "id"], 4, get_profile(backend)).collect()]

    assert ages("age", "trino") == [30, 40, 40, None] == ages("age", "snowflake") == ages("age NULLS LAST", "bigquery")
    assert ages("age DESC", "trino") == [40, 40, 30, None] == ages("age DESC", "bigquery") == ages("age DESC", "databricks")
    assert ages("age DESC", "snowflake") == [None, 40, 40, 30] and ages("age", "bigquery") == [None, 30, 40, 40]
    with pytest.raises(RequestError):
        ages("nope", "trino")


def test_profiles(spark, sf001, monkeypatch):
    assert backends() == ["snowflake", "databricks", "trino", "bigquery", "gcs", "athena", "s3", "glue"]
    assert get_profile("TRINO").name == "trino"
    with pytest.raises(ValueError, match="snowflake"):
        get_profile("oracle")
    with pytest.raises(ValueError):
        get_profile("trino").scan(spark, "payroll")
    cases = {"show every customer": "customers", "border crossings": "orders"}
    for intent, table in cases.items():
        assert all(get_profile(b).infer_entity(intent) == table for b in ("snowflake", "athena", "bigquery"))
    assert get_profile("athena").infer_entity("daily clicks") == "clickstream"
    with pytest.raises(ValueError):
        get_profile("snowflake").infer_entity("the catalog")
    register_profile(Profile("lake", {"page": "pages"}, loader=file_tables(sf001)))
    try:
        res = secure_query(spark, Request("lake", "show some pages", limit=3))
        assert res.df.count() == 3 and res.metadata["invocation_id"].startswith("inv_")
    finally:
        from cloakframe.sources import profiles

        profiles._PROFILES.pop("lake")
    assert callable(connector_tables("jdbc", url="jdbc:x")) and callable(catalog_tables("db"))


def test_policies_on_results(spark, people):
    df = people.select("id", "email", "city")
    r = ask(spark, df, order_by=["id"], limit=2)
    assert [x.email for x in r.df.collect()] == ["a@***@***.***", "c@***@***.***"]
    s = r.summary.first()
    assert s.row_count == 2 and s.columns == ["id", "email", "city"] and s.columns_processed == ["city", "email"]
    r = ask(spark, df, order_by=["id DESC"], limit=2, pii_policy="hash")
    assert [(x.id, x.email) for x in r.df.collect()] == [(4, token_of("none", SALT)), (3, token_of("none", SALT))]
    with pytest.raises(PolicyDenied):
        ask(spark, df, pii_policy="deny")
    assert ask(spark, df.select("id"), pii_policy="deny").df.count() == 4
    assert ask(spark, df, pii_policy="deny", filters={"id": 99}).df.count() == 0
    # only what is returned is judged: the second column set has no personal data in its rows
    ok = ask(spark, people.select("id", F.col("email").alias("m")), pii_policy="deny", filters={"id": 3}).df.collect()
    assert [tuple(x) for x in ok] == [(3, "none")]
    c = ask(spark, df, settings=Settings(salt=SALT, consistent=True), limit=1)
    assert c.summary.first().row_count == c.df.count() == 1


def test_aggregated_result_and_text_backend(spark, people):
    r = ask(spark, people, "athena", aggregations=["COUNT(*) AS total"], group_by=["city"], order_by=["total DESC", "city"])
    assert [tuple(x) for x in r.df.collect()] == [("2", "Rome"), ("1", "Oslo"), ("1", None)]
    assert r.columns == ["total", "city"]


def test_filter_holding_personal_data(spark, people):
    from cloakframe.operators.protect import hash_table

    raw = people.select("id", "email")
    stored = hash_table(raw, SALT, ["email"])
    assert [x.id for x in ask(spark, stored, filters={"email": "a@b.cd"}).df.collect()] == [1]
    assert ask(spark, raw, filters={"email": "a@b.cd"}).df.count() == 0
    found = ask(spark, raw, settings=Settings(salt=SALT, match="raw"), filters={"email": "a@b.cd"})
    assert [x.id for x in found.df.collect()] == [1] and "a@b.cd" not in found.df._jdf.queryExecution().toString()


def test_replies_hide_values(spark, people, monkeypatch):
    monkeypatch.delenv("PII_HASH_SALT", raising=False)
    base = {"backend": "databricks", "intent": "list some people", "entity": "customers"}
    assert query_data(spark, base, profile=over("databricks", people)).success
    bad = query_data(spark, {**base, "filters": {"age": "call 555-123-4567"}}, Settings(salt=SALT), over("databricks", people))
    assert not bad.success or bad.result.df is not None
    reply = query_data(spark, {**base, "order_by": ["x 555-123-4567"]}, profile=over("databricks", people))
    assert not reply.success and "555-123" not in reply.error and reply.error_type == "RequestError"
    reply = query_data(spark, {**base, "pii_policy": "deny"}, profile=over("databricks", people))
    assert not reply.success and reply.error_type == "PolicyDenied"
    assert not query_data(spark, {"intent": "no backend here"}).success
    assert not query_data(spark, {"backend": "nope", "intent": "list some people"}).success


def test_object_and_catalog_backends(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("x")
    (tmp_path / "b.json").write_text("{}")
    request = Request("s3", "list the objects", filters={"prefix": "in/"})
    with pytest.raises(RequestError):
        plan_request(spark, request)
    found = query_data(spark, {"backend": "gcs", "intent": "list the objects", "entity": str(tmp_path)})
    assert [r.key for r in found.result.df.collect()] == ["b.json", "in/a.csv"]
    found = query_data(spark, {"backend": "s3", "intent": "list the objects", "entity": str(tmp_path), "filters": {"prefix": "in/"},
                               "limit": 5})
    assert [(r.key, r.size_bytes, r.content_type) for r in found.result.df.collect()] == [("in/a.csv", 1, "text/csv")]
    refused = query_data(spark, {"backend": "s3", "intent": "list the objects", "entity": str(tmp_path)},
                         Settings(allowed_buckets=("other",)))
    assert refused.error_type == "PermissionError"
    with pytest.raises(RequestError):
        plan_request(spark, Request("databricks", "list some people", "a.b"))
    from cloakframe.sources import catalog as cat

    columns = cat.columns_of(spark, {"users": spark.createDataFrame([], "id int, email string")})
    res = secure_query(spark, Request("glue", "show the columns", "users"), Settings(catalog=columns))
    assert [tuple(r) for r in res.df.collect()] == [("id", "int", False, "none"), ("email", "string", True, "high")]


def test_observed_metrics(spark, people):
    watch = Observation("finds")
    observed(people, watch).write.format("noop").mode("overwrite").save()
    assert watch.get["row_count"] == 4 and watch.get["email:email"] == 2 and watch.get["city:phone"] == 0


@pytest.mark.parametrize("policy", ["mask", "hash", "deny", "auto"])
@pytest.mark.parametrize("levels", [False, True])
def test_staged_files_hold_no_raw_value(spark, policy, levels):
    """Neither found values nor columns whose names forbid passing them on; and the files go."""
    from pathlib import Path

    from cloakframe.plans.policy import apply_policy

    df = spark.createDataFrame([(1, "hunter2secret", "joe.public@example.com", "plain")], "id long, password string, note string, city string")
    root = Path(spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    root = Path(str(root).removeprefix("file:"))
    before = {p for p in root.rglob("*") if p.is_file()}
    try:
        result = apply_policy(df, policy, salt=SALT, enforce_levels=levels, repeatable=False)
    except PolicyDenied:
        result = None
    new = [p for p in root.rglob("*") if p.is_file() and p not in before]
    blob = b"".join(p.read_bytes() for p in new)
    assert b"joe.public" not in blob
    if policy in ("hash", "deny") or levels:
        assert b"hunter2secret" not in blob
    if result is None:
        assert not new  # nothing is left behind after a denial
    else:
        assert result.df.count() == 1
        result.release()
        assert not [p for p in root.rglob("part-*") if p.is_file() and p not in before and not p.name.endswith(".crc")]


def test_numbers_and_what_masking_leaves(spark):
    from cloakframe.plans.policy import apply_policy

    df = spark.createDataFrame([(5551234567, {"a@b.cd": "x"}, "call 555-123-4567")], "n long, m map<string,string>, t string")
    s = apply_policy(df, "mask").summary.first()
    assert s.columns_processed == ["m", "n", "t"] and s.columns_left == ["m", "n"]
    r = apply_policy(df, "mask", numbers=True)
    assert r.df.first().n == "******4567" and r.summary.first().columns_left == ["m"]


def test_rows_without_a_limit(spark):
    """Nothing is cut unless the caller or the deployment says so, and then it shows."""
    df = spark.range(2500).selectExpr("id", "concat('c', id) AS city")
    r = ask(spark, df, aggregations=["COUNT(*) AS n"], group_by=["city"])
    assert r.df.count() == 2500 and "truncated" not in r.metadata
    r = ask(spark, df, settings=Settings(salt=SALT, max_rows=1500), aggregations=["COUNT(*) AS n"], group_by=["city"])
    assert r.df.count() == 1500 and r.metadata["truncated"]
    assert not ask(spark, df, settings=Settings(salt=SALT, max_rows=3000)).metadata["truncated"]
    assert ask(spark, df, settings=Settings(salt=SALT, max_rows=3000), limit=2000).df.count() == 2000
