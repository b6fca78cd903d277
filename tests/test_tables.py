"""Tokens, names, profiles, nested values, policies and the SQL functions."""

import contextlib
import datetime as dt
import decimal
import io
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.functions import literals
from cloakframe.functions.sqlnames import register_sql_functions
from cloakframe.functions.text import pii_text
from cloakframe.functions.tokens import hide_salt, is_token, lookup_token, pads, resolve_salt, token, token_of
from cloakframe.operators.fields import Scope
from cloakframe.operators.linkage import link, linkage_counts, token_quality
from cloakframe.operators.profile import find_spans, profile_table, supported_types, table_findings
from cloakframe.operators.protect import hash_table, hash_where, redact_table, redact_with_types
from cloakframe.plans.policy import apply_policy, decisions, deny_in_plan
from cloakframe.plans.request import PolicyDenied
from cloakframe.rules import DEFAULT_RULES, Mask, Rules
from cloakframe.sources import catalog as cat

SALT = "test-salt-123"


def py_hmac(key, value, n):
    return hmac.new(key.encode(), value.encode(), hashlib.sha256).digest()[:n].hex().upper()


# -- tokens ------------------------------------------------------------------
def test_token(spark):
    long_salt = "s" * 100
    values = ["john@example.com", "", "héé ☃", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.selectExpr(
        token("v", SALT) + " AS t", token("v", long_salt) + " AS l", lookup_token("v", "user_id", SALT) + " AS u"
    ).collect()
    assert got[0].t == "HASH_0951377DA580AE05773F532D2D2B91ED"
    for v, r in zip(values, got, strict=True):
        assert r.t == ("HASH_NULL" if v is None else "HASH_" + py_hmac(SALT, v, 16)) == token_of(v, SALT)
        assert r.l == ("HASH_NULL" if v is None else "HASH_" + py_hmac(long_salt, v, 16))
        assert r.u == "USER_ID_HASH_" + py_hmac("user_id:" + SALT, str(v), 12)


def test_is_token(spark):
    h32, h24 = "0951377DA580AE05773F532D2D2B91ED", "0951377DA580AE05773F532D"
    cases = {
        "HASH_NULL": True, "HASH_" + h32: True, "HASH_" + h32 + "0": False, "HASH_" + h32.lower(): False,
        "HASH_" + h32 + "\n": False, "USER_HASH_" + h24: True, "_HASH_" + h24: True, "A_HASH_B_HASH_" + h24: False,
        "A_HASH_HASH_" + h24: False, "USER_HASH_" + h24 + "\n": False, "HASH_X_HASH_" + h24: False, "plain": False,
        "": False, None: False, "USER_HASH_NULL": False,
    }
    register_sql_functions(spark, SALT)
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    for r in df.selectExpr("v", is_token("v") + " AS c", "pii_is_token(v) AS s").collect():
        assert r.c == r.s == cases[r.v], r.v


def test_salt_rules(spark, monkeypatch):
    monkeypatch.delenv("PII_HASH_SALT", raising=False)
    for bad in (None, "", "change-me-in-production"):
        with pytest.raises(ValueError):
            resolve_salt(bad)
    monkeypatch.setenv("PII_HASH_SALT", "from-env")
    assert resolve_salt() == "from-env"
    spark.conf.unset("spark.sql.redaction.string.regex")
    df = spark.range(1).selectExpr(token("CAST(id AS STRING)", SALT) + " AS t")
    df.createOrReplaceTempView("tokens_of_ids")
    for mode in ("simple", "extended", "formatted", "codegen", "cost"):
        with contextlib.redirect_stdout(io.StringIO()) as shown:
            df.explain(mode)
        assert not any(p.hex().upper() in shown.getvalue().upper() for p in pads(SALT)), mode
    hide_salt(spark)  # once more changes nothing
    assert spark.conf.get("spark.sql.redaction.string.regex").count("0x") == 1
    for body in (lambda: token("x", ""), lambda: lookup_token("x", "c", "change-me-in-production"), lambda: token_of("x", "")):
        with pytest.raises(ValueError):
            body()


def test_text_forms(spark):
    values = {
        "b": (True, T.BooleanType()), "i": (-42, T.LongType()), "d": (decimal.Decimal("1.50"), T.DecimalType(10, 2)),
        "dt": (dt.date(2024, 1, 2), T.DateType()), "ts": (dt.datetime(2024, 1, 2, 3, 4, 5), T.TimestampNTZType()),
        "us": (dt.datetime(2024, 1, 2, 3, 4, 5, 120), T.TimestampNTZType()),
    }
    schema = T.StructType([T.StructField(k, t) for k, (_, t) in values.items()])
    df = spark.createDataFrame([tuple(v for v, _ in values.values())], schema)
    row = df.selectExpr(*[f"{pii_text(f.name, f.dataType)} AS {f.name}" for f in schema]).first()
    for k, (v, _) in values.items():
        assert row[k] == str(v)
    doubles = [0.0, 1.0, -1.5, 0.1 + 0.2, 1e10, 12345678.9, 1e15, 1e16, 1.5e16, 1e-4, 1.25e-4, 1e-5, 1.5e-7, 1e100,
               -3e22, 100.0, 0.001, 9999999.5, 1e7, 123456789012.25, float("inf"), float("-inf"), float("nan")]
    got = spark.createDataFrame([(i, d) for i, d in enumerate(doubles)], "i int, d double")
    for r in got.selectExpr("i", pii_text("d", T.DoubleType()) + " AS t").collect():
        assert r.t == str(doubles[r.i])


# -- names -------------------------------------------------------------------
LABELS = {
    "email": ("high", "contact", "exact_match"), "Phone_Number": ("high", "contact", "exact_match"),
    "mobile": ("medium", "contact", "exact_match"), "ssn": ("critical", "identity", "exact_match"),
    "iban": ("critical", "financial", "exact_match"), "bank_account": ("medium", "financial", "exact_match"),
    "passwd": ("medium", "unknown", "exact_match"), "password": ("critical", "credentials", "exact_match"),
    "api_key": ("medium", "credentials", "exact_match"), "dob": ("high", "personal", "exact_match"),
    "birth_date": ("medium", "personal", "exact_match"), "user_email": ("high", "contact", "contains_pattern:_email"),
    "home_phone": ("high", "contact", "contains_pattern:_phone"),
    "first_name": ("medium", "personal", "contains_pattern:first_name"),
    "ip_address": ("high", "location", "contains_pattern:address"),
    "capacity": ("medium", "location", "contains_pattern:city"),
    "n_tokens": ("medium", "credentials", "contains_pattern:_token"),
    "country_code": ("medium", "unknown", "contains_pattern:country"),
    "product_name": ("medium", "inferred", "regex_pattern:name_?(?:first|last|full)?"),
    "cell_tel": ("medium", "inferred", "regex_pattern:(?:home|work|cell|mobile)_?(?:phone|tel)"),
    "addr1": ("medium", "inferred", r"regex_pattern:addr(?:ess)?_?(?:line)?_?\d?"),
    "iban_code": ("none", None, None), "created_at": ("none", None, None), "id": ("none", None, None),
    "status": ("none", None, None), "quantity": ("none", None, None), "price": ("none", None, None),
}


def test_name_labels(spark):
    df = spark.createDataFrame([(n,) for n in LABELS], "column_name string")
    for r in cat.label_columns(df).collect():
        got = (r.pii_sensitivity, r.pii_category, r.match_reason)
        assert got == LABELS[r.column_name] and r.is_pii == (r.match_reason is not None)
        d = DEFAULT_RULES.label(r.column_name)
        assert (d.sensitivity, d.category, d.match_reason, d.is_pii) == (*got, r.is_pii)
    df = spark.createDataFrame([("variant_data",)], "column_name string")
    assert not cat.label_columns(df).first().is_pii
    assert not cat.label_columns(df, backend="trino").first().is_pii
    r = cat.label_columns(df, backend="snowflake").first()
    assert (r.pii_sensitivity, r.pii_category, r.match_reason) == ("medium", "backend_specific", "backend_override:snowflake")


def test_catalog(spark):
    users = spark.createDataFrame([], "id int, email string, ssn string, first_name string, created_at timestamp")
    goods = spark.createDataFrame([], "id int, product_name string, price double")
    plain = spark.createDataFrame([], "id int, price double")
    columns = cat.columns_of(spark, {"users": users, "goods": goods, "plain": plain}, "shop")
    full = cat.column_catalog(columns)
    tables = {r.table: r for r in cat.label_tables(full).collect()}
    assert tables["users"].pii_columns == ["email", "first_name", "ssn"] and tables["users"].has_pii
    assert tables["users"].critical_columns == ["ssn"] and tables["users"].high_columns == ["email", "ssn"]
    assert tables["plain"].pii_columns == [] and not tables["plain"].has_pii
    assert [r.table_name for r in cat.list_tables(full).collect()] == ["goods", "plain", "users"]
    assert [r.database_name for r in cat.list_databases(full).collect()] == ["shop"]
    assert [r.table for r in cat.search_tables(full, "OO").collect()] == ["goods"]
    assert cat.search_tables(full, "oo", "elsewhere").count() == 0
    assert cat.column_catalog(columns, table="GOODS").count() == 3
    assert cat.up_to_sensitivity(full, "medium").where("pii_sensitivity IN ('high','critical')").count() == 0
    assert [r.column_name for r in cat.answer_intent(full, "show the schema", "goods").collect()] == ["id", "product_name", "price"]
    assert cat.answer_intent(full, "which tables", "shop").count() == 3
    assert cat.answer_intent(full, "list databases").count() == 1
    with pytest.raises(ValueError):
        cat.answer_intent(full, "show the schema")
    with pytest.raises(ValueError):
        cat.answer_intent(full, "something else")
    assert cat.safe_columns(users).columns == ["id", "created_at"]
    assert cat.columns_up_to(users, "medium").columns == ["id", "first_name", "created_at"]
    assert cat.columns_up_to(users, "none").columns == ["id", "created_at"]


def test_catalog_of_session_tables(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS shop_db COMMENT 'x'")
    spark.sql("CREATE TABLE shop_db.people (id INT COMMENT 'key', email STRING, country STRING) USING parquet "
              "PARTITIONED BY (country) COMMENT 'all people'")
    try:
        rows = {r.column_name: r for r in cat.column_catalog(cat.columns_of_database(spark, "shop_db")).collect()}
        assert rows["country"].is_partition and rows["country"].is_pii and rows["email"].pii_sensitivity == "high"
        assert rows["id"].comment == "key" and rows["id"].description == "all people"
    finally:
        spark.sql("DROP TABLE shop_db.people")
        spark.sql("DROP DATABASE shop_db")
    info = spark.createDataFrame(
        [("s", "t", "email", "varchar", "YES"), ("s", "t", "id", "int", "NO")],
        "table_schema string, TABLE_NAME string, column_name string, data_type string, is_nullable string",
    )
    got = cat.column_catalog(cat.columns_of_information_schema(info)).orderBy("column_name").collect()
    assert [(r.database, r.table, r.column_name, r.nullable, r.is_pii) for r in got] == [
        ("s", "t", "email", True, True), ("s", "t", "id", False, False)]


# -- rules -------------------------------------------------------------------
def test_rules_from_yaml(spark, tmp_path):
    path = tmp_path / "policy.yaml"
    path.write_text(
        "detection_patterns:\n"
        "  employee: {pattern: '\\bE\\d{4}\\b', sensitivity: low, default_action: hash}\n"
        "  email: {pattern: '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}', sensitivity: medium}\n"
        "column_classifications: {exact: [Badge], contains: [_emp], patterns: ['^x\\d']}\n"
        "backend_overrides: {trino: {additional_pii_columns: [Blob]}}\n"
        "sensitivity_levels: {low: {allowed_policies: [hash]}}\n"
    )
    rules = Rules.from_yaml(str(path))
    assert rules.types == ["employee", "email"] and rules.detection("email").java
    assert rules.label("BADGE").match_reason == "exact_match" and rules.label("a_emp").is_pii and rules.label("x1").is_pii
    assert rules.label("blob", "trino").is_pii and not rules.label("blob").is_pii
    df = spark.createDataFrame([("e1234 and E12345 a@b.cd",)], "t string")
    assert redact_table(df, rules=rules).first().t == "***** and E12345 a@***@***.***"
    for bad in ({"detection_patterns": {"x": {"pattern": "a*"}}}, {"detection_patterns": {"x": {"pattern": "a", "sensitivity": "?"}}},
                {"detection_patterns": {"x": {"pattern": "a", "default_action": "?"}}}, {"sensitivity_levels": {"low": {}}}):
        with pytest.raises(ValueError):
            Rules.from_dict(bad)
    got = {r.pii_type: r.default_action for r in supported_types(spark).collect()}
    assert got["ssn"] == "deny" and len(got) == 8


# -- tables ------------------------------------------------------------------
NESTED = (
    "id bigint, note string, who struct<name:string,contact:struct<mail:string,n:int>>, tags array<string>, "
    "props map<string,string>, items array<struct<t:string,k:bigint>>, big bigint, amount decimal(20,0), x double"
)
ROWS = [
    (1, "call 555-123-4567", ("Bo", ("a@b.cd", 1)), ["10.0.0.1", "ok"], {"k": "12/31/1999", "10.0.0.9": "v"},
     [("123-45-6789", 1)], 5551234567, decimal.Decimal(4111111111111111), 0.30000000000000004),
    (2, "fine", ("Al", ("none", 2)), ["ok"], {"k": "v"}, [("t", 5551234567)], 7, decimal.Decimal(1), 1.0),
    (3, None, None, None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def nested(spark):
    return spark.createDataFrame(ROWS, NESTED)


def test_profile_nested(nested):
    hits = {(r.path, r.pii_type): r.n_rows for r in profile_table(nested).where("n_rows > 0").collect()}
    assert hits == {
        ("note", "phone"): 1, ("who.contact.mail", "email"): 1, ("tags", "ip_address"): 1, ("props", "date_of_birth"): 1,
        ("props", "ip_address"): 1, ("items", "ssn"): 1, ("items", "phone"): 1, ("big", "phone"): 1,
        ("amount", "phone"): 1, ("amount", "credit_card"): 1,
    }
    rows = profile_table(nested).collect()
    assert {r.rows_scanned for r in rows} == {3} and [r.column for r in rows if r.pii_type is None] == ["x"]
    more = profile_table(nested, scope=Scope(doubles=True)).where("n_rows > 0 AND path = 'x'").collect()
    assert [r.pii_type for r in more] == ["phone"]
    only = profile_table(nested, columns=["note"], scope=Scope(numbers=False)).where("n_rows > 0").collect()
    assert [(r.path, r.pii_type) for r in only] == [("note", "phone")]
    found = table_findings(nested).first()
    assert found.has_pii and found.column_types["props"] == ["date_of_birth", "ip_address"]


def test_profile_of_wide_table(spark):
    wide = spark.createDataFrame([("a@b.cd",)], "t string").select(*[F.col("t").alias(f"c{i}") for i in range(60)])
    assert profile_table(wide).where("n_rows = 1").count() == 60


def test_spans_of_nested(nested):
    got = {(r.path, r.value) for r in find_spans(nested, ["id"]).where("id = 1").collect()}
    assert got == {
        ("note", "555-123-4567"), ("who.contact.mail", "a@b.cd"), ("tags", "10.0.0.1"), ("props", "12/31/1999"),
        ("props", "10.0.0.9"), ("items", "123-45-6789"), ("big", "5551234567"), ("amount", "4111111111111111"),
        ("amount", "4111111111"),
    }


def test_redact_nested(nested):
    out = redact_table(nested)
    assert out.schema.simpleString() == nested.schema.simpleString()
    a, b, c = out.orderBy("id").collect()
    assert a.note == "call ********4567" and a.who.contact.mail == "a@***@***.***" and a.who.name == "Bo"
    assert a.tags == ["***.***.***.***", "ok"] and a["items"][0].t == "***-**-****" and a.big == 5551234567
    assert a.props == {"k": "**/**/****", "10.0.0.9": "v"}
    assert c.who is None and c.tags is None and c.note is None and b.note == "fine"
    n = redact_table(nested, ["big", "id"], numbers=True).orderBy("id").collect()
    assert [r.big for r in n] == ["******4567", "7", None] and n[0].note == "call 555-123-4567"
    with pytest.raises(ValueError):
        redact_table(nested, ["nope"])


def test_hash_columns(nested):
    out = hash_table(nested, SALT, ["note", "big"]).orderBy("id").collect()
    assert [r.note for r in out] == [token_of(ROWS[0][1], SALT), token_of("fine", SALT), "HASH_NULL"]
    assert out[0].big == token_of(5551234567, SALT) and out[0].tags == ["10.0.0.1", "ok"]
    assert all(f.dataType == T.StringType() for f in hash_table(nested, SALT).schema)
    assert [r.note for r in hash_where(nested, "note", "id = 1", SALT).orderBy("id").collect()] == [
        token_of(ROWS[0][1], SALT), "fine", None]


def test_linkage(spark):
    left = hash_table(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "l int, k string"), SALT, ["k"])
    right = hash_table(spark.createDataFrame([("a", 10), ("a", 11), ("c", 12), (None, 13)], "q string, r int"), SALT, ["q"])
    assert sorted((x.l, x.r) for x in link(left, right, "k", "q").collect()) == [(1, 10), (1, 11), (2, 10), (2, 11)]
    assert sorted(x.l for x in link(left, right, "k", "q", "left_semi").collect()) == [1, 2]
    assert sorted(x.l for x in link(left, right, "k", "q", "left_anti").collect()) == [3, 4]
    (c,) = linkage_counts(left, right, "k", "q").collect()
    assert (c.left_rows, c.right_rows, c.pairs) == (2, 2, 4) and c.token == token_of("a", SALT)
    q = token_quality(left.unionByName(spark.createDataFrame([(5, "raw"), (6, None)], "l int, k string")), "k").first()
    assert (q.tokens, q.null_tokens, q.raw_values, q.nulls) == (3, 1, 1, 1)
    with pytest.raises(ValueError):
        link(left, right, "k", "q", "full")


def test_sql_functions_equal_columns(spark, sf01):
    register_sql_functions(spark, SALT)
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    docs.createOrReplaceTempView("docs_sql")
    a = spark.sql("SELECT doc_id, pii_redact(text) AS text, pii_types(text) AS pii_types, pii_has(text) AS p FROM docs_sql")
    b = redact_with_types(docs, "text").select("doc_id", "text", "pii_types", (F.size("pii_types") > 0).alias("p"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    row = spark.sql("SELECT pii_token('john@example.com') t, pii_mask('john@test.com', 'email') m, pii_mask('abc', 'x') d, "
                    "pii_redact(NULL) n, pii_token(NULL) z, size(pii_spans('a@b.cd 10.0.0.1')) f").first()
    assert tuple(row) == ("HASH_0951377DA580AE05773F532D2D2B91ED", "jo***@***.***", "***", None, "HASH_NULL", 2)
    assert "PythonUDF" not in a._jdf.queryExecution().toString()


# -- policies ----------------------------------------------------------------
PEOPLE = [(1, "a@b.cd", "x 10.0.0.1", "Bo"), (2, "plain", "y", "Al")]
PEOPLE_SCHEMA = "id int, email string, data string, first_name string"


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, PEOPLE_SCHEMA)


@pytest.mark.parametrize("repeatable", [True, False])
def test_policies(people, repeatable):
    def run(policy, df=people, **kw):
        res = apply_policy(df, policy, salt=SALT, repeatable=repeatable, **kw)
        return [tuple(r) for r in res.df.orderBy("id").collect()], res.summary.first()

    rows, s = run("mask")
    assert rows == [(1, "a@***@***.***", "x ***.***.***.***", "Bo"), (2, "plain", "y", "Al")]
    assert s.row_count == 2 and s.policy_applied == "mask" and s.pii_detected
    assert s.columns_processed == ["data", "email", "first_name"] and s.pii_types == ["email", "ip_address"]
    rows, _ = run("mask", mask_classified=True)
    assert rows == [(1, "******", "x ***.***.***.***", "**"), (2, "*****", "y", "**")]
    rows, _ = run("hash")
    assert rows == [tuple([p[0]] + [token_of(v, SALT) for v in p[1:]]) for p in PEOPLE]
    with pytest.raises(PolicyDenied) as denied:
        run("deny")
    assert "email" in str(denied.value) and "a@b.cd" not in str(denied.value)
    rows, _ = run("auto")
    assert rows == [(1, "a@***@***.***", token_of("x 10.0.0.1", SALT), "Bo"), (2, "plain", token_of("y", SALT), "Al")]
    rows, _ = run("mask", enforce_levels=True)
    assert rows[0] == (1, token_of("a@b.cd", SALT), "x ***.***.***.***", "Bo")
    clean, s = run("deny", people.select("id", F.lit("ok").alias("status")))
    assert clean == [(1, "ok"), (2, "ok")] and not s.pii_detected and s.columns_processed == []
    empty, s = run("deny", people.where("id > 9"))
    assert empty == [] and s.row_count == 0 and s.columns_processed == []
    empty, _ = run("hash", people.where("id > 9"))
    assert empty == []
    with pytest.raises(ValueError):
        run("shrug")


def test_staged_copy_holds_no_found_value(people, spark):
    from cloakframe.plans import policy

    seen = []
    original = policy.reliable_copy
    policy.reliable_copy = lambda df: seen.append(original(df)) or seen[-1]
    try:
        apply_policy(people, "hash", salt=SALT, repeatable=False)
    finally:
        policy.reliable_copy = original
    text = str(seen[0].collect())
    assert "a@b.cd" not in text and "10.0.0.1" not in text and "Bo" not in text and "plain" not in text


def test_decisions(people):
    rows = {r.column: r for r in decisions(profile_table(people), "auto").collect()}
    assert (rows["data"].action, rows["data"].sensitivity, rows["data"].is_named) == ("hash", "medium", False)
    assert (rows["email"].action, rows["email"].sensitivity, rows["email"].is_named) == ("mask", "high", True)
    assert (rows["first_name"].action, rows["first_name"].pii_types) == ("mask", [])
    floor = {r.column: r.action for r in decisions(profile_table(people), "mask", enforce_levels=True).collect()}
    assert floor == {"data": "mask", "email": "hash", "first_name": "mask"}


def test_deny_in_plan(people):
    with pytest.raises(Exception, match="personal data in column"):
        deny_in_plan(people).collect()
    assert deny_in_plan(people.where("id = 2")).count() == 1


def test_reference_scenarios(spark):
    """The documented behaviour on the small example rows."""
    rows = spark.createDataFrame(
        [(1, "john@example.com", "555-123-4567", "active"), (2, "jane@example.com", "555-987-6543", "inactive")],
        "id int, email string, phone string, status string",
    )
    out = redact_table(rows).collect()
    assert out[0].email.startswith("jo***") and out[0].status == "active" and out[1].phone.endswith("6543")
    h = apply_policy(rows, "hash", salt=SALT).df.collect()
    assert h[0].email.startswith("HASH_") and len(h[0].email) == 37 and h[0].status == "active"
    assert hash_table(rows, "other", ["email"]).first().email != h[0].email


def test_literals():
    assert literals.scrub("mail john@example.com now") == "mail jo***@***.*** now"
    assert literals.scrub_map({"a": "a@b.cd", "n": 5, "in": {"p": "10.0.0.1"}}) == {
        "a": "a@***@***.***", "n": 5, "in": {"p": "***.***.***.***"}}
    assert literals.find(None) == [] and literals.find(5551234567) == [(0, 10, "phone")]
    assert literals.mask_literal("ab", Mask(1, 1)) == "**"
