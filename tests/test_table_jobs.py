"""Rule tables, incremental profiles, heavy tokens, token indexes, audit streams, sketches, trails and prefixes."""

import json
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
import table_queries as q
from cloakframe.functions.tokens import NULL_TOKEN, token_of
from cloakframe.operators import heavy, incremental, rule_table, sketches, trail
from cloakframe.operators.linkage import link
from cloakframe.operators.profile import profile_table
from cloakframe.operators.relational import aggregate, array_rows
from cloakframe.plans.request import Request
from cloakframe.plans.secure import Settings, deliver, secure_query
from cloakframe.rules import DEFAULT_RULES, Rules
from cloakframe.sources import inventory, token_index
from cloakframe.sources.profiles import get_profile
from cloakframe.streaming import audit_sink, learning, sessions, windows

SALT = "a-salt-for-tests"


def plan(df):
    return df._jdf.queryExecution().toString()


# -- rules as a table -----------------------------------------------------------------------
def test_rule_table_equals_the_expression(spark):
    names = ["email", "EMAIL", "user_email", "x_ssn_token", "Cell", "capacity", "zipper", "name_first", "addr1", "variant_data", "id", "", None, "city", "a_name"]
    rows = spark.createDataFrame([(n, b) for n in names for b in ("snowflake", "trino", None)] * 2, "column_name string, backend string")
    index = rule_table.rule_index(rule_table.rule_rows(spark, DEFAULT_RULES))
    got = rule_table.label_by_rules(rows, index, backend="backend", patterns=DEFAULT_RULES.names.patterns).collect()
    assert len(got) == len(names) * 3 and {r.n_rows for r in got} == {2}
    for r in got:
        want = DEFAULT_RULES.label(r.column_name, r.backend) if r.column_name is not None else DEFAULT_RULES.label("none")
        assert (r.is_pii, r.sensitivity, r.category, r.match_reason) == (want.is_pii, want.sensitivity, want.category, want.match_reason), r


def test_random_fragments_against_a_loop(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choices("abc_", k=n))
    rules = [("contains", rng.randint(0, 99), text(rng.randint(1, 7)), None) for _ in range(60)] + [("exact", 0, text(3), None) for _ in range(5)] + [("contains", 5, None, None)]
    names = [text(rng.randint(0, 12)) for _ in range(300)]
    index = rule_table.rule_index(spark.createDataFrame(rules, rule_table.RULE_SCHEMA))
    got = {r.column_name: r.match_reason for r in rule_table.label_by_rules(spark.createDataFrame([(n,) for n in names], "column_name string"), index).collect()}
    for n in set(names):
        fits = sorted((p, x) for k, p, x, _ in rules if k == "contains" and x and x in n)
        want = "exact_match" if n in {x for k, _, x, _ in rules if k == "exact"} else f"contains_pattern:{fits[0][1]}" if fits else None
        if fits and want != "exact_match":  # positions may tie
            assert got[n].split(":")[1] in {x for p, x in fits if min(p2 for k, p2, x2, _ in rules if x2 == x and k == "contains") == fits[0][0]}
        else:
            assert got[n] == want


def test_plan_does_not_grow_with_rules(spark, sf001):
    few, many = (spark.range(n).selectExpr("'contains' AS kind", "id AS position", "concat('f', id) AS text", "CAST(NULL AS STRING) AS backend") for n in (10, 30000))
    names = spark.range(50).selectExpr("concat('n_f', id) AS column_name")
    sizes = []
    for rules in (few, many):
        df = rule_table.label_by_rules(names, rule_table.rule_index(rules))
        text = plan(df)
        assert "NestedLoop" not in text and "CartesianProduct" not in text and "Python" not in text
        sizes.append(df._jdf.queryExecution().optimizedPlan().toString().count("\n"))
    assert sizes[0] == sizes[1]
    got = {r.column_name: r.match_reason for r in rule_table.label_by_rules(names, rule_table.rule_index(many)).collect()}
    assert got["n_f7"] == "contains_pattern:f7" and got["n_f42"] == "contains_pattern:f4"
    with pytest.raises(Exception, match="empty fragment"):
        rule_table.rule_index(spark.createDataFrame([("contains", 0, "", None)], rule_table.RULE_SCHEMA)).collect()


def test_only_keys_that_rules_have_are_shuffled(spark, monkeypatch):
    rules = spark.range(40).selectExpr("'contains' AS kind", "id AS position", "concat('ab_', id * 37 % 400) AS text", "CAST(NULL AS STRING) AS backend")
    names = spark.range(400).selectExpr("concat('x_Ab_', id) AS column_name")
    labels = lambda: {r.column_name: r.match_reason for r in rule_table.label_by_rules(names, rule_table.rule_index(rules)).collect()}
    want = labels()
    assert {n for n, x in want.items() if x} == {f"x_Ab_{n}" for n in range(400) if any(str(n).startswith(str(i * 37 % 400)) for i in range(40))}
    monkeypatch.setattr(rule_table, "SLOTS", 1)  # every key shares its hash value with all others
    assert labels() == want
    monkeypatch.undo()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = rule_table.rule_index(rules)
        text = rule_table.label_by_rules(names, index)._jdf.queryExecution().executedPlan().toString()
        assert "LeftSemi" in text and "hashpartitioning(key" in text and "hashpartitioning(gram" not in text
        assert "SortMergeJoin" not in index._jdf.queryExecution().executedPlan().toString()
        assert labels() == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_positions_follow_the_order_and_labels_join_rows(spark):
    texts = spark.range(100).selectExpr("concat('t', id) AS text", "id")
    rows = rule_table.positions(texts, "contains", "id").orderBy("position").collect()
    assert [r.text for r in rows] == [f"t{i}" for i in range(100)] and len({r.position for r in rows}) == 100
    names = spark.createDataFrame([("email", 1), ("email", 2), (None, 3), ("id", 4)], "column_name string, k int")
    labels = rule_table.label_by_rules(names, rule_table.rule_index(rule_table.rule_rows(spark, DEFAULT_RULES)))
    assert {r.k: r.is_pii for r in rule_table.label_rows(names, labels).collect()} == {1: True, 2: True, 3: False, 4: False}


# -- incremental profile ---------------------------------------------------------------------
def test_incremental_profile_equals_a_full_scan(spark, tmp_path):
    data, log = str(tmp_path / "data"), str(tmp_path / "log")
    put = lambda rows, name: spark.createDataFrame(rows, "id long, note string, d double").coalesce(1).write.mode("overwrite").parquet(f"{data}/{name}")
    schema = spark.createDataFrame([], "id long, note string, d double").schema

    def same():
        scanned = incremental.refresh_profile(spark, data, log, schema)
        got = Counter(map(tuple, incremental.stored_profile(spark, log, schema).collect()))
        assert got == Counter(map(tuple, profile_table(spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(data)).collect()))
        return scanned

    put([(1, "a@b.co", 1.0), (2, None, None)], "one")
    put([(3, "555-123-4567", 1.0)], "two")
    assert len(same()) == 2
    assert same() == []  # nothing has changed
    put([(4, "x@y.org and 10.0.0.1", 2.0)] * 3, "three+ a%20b{x}")  # a new file
    assert [f.split("/")[-2] for f in same()] == ["three+ a%20b{x}"]
    put([(5, "clean", 0.0)], "one")  # a replaced one
    scanned = same()
    assert [f.split("/")[-2] for f in scanned] == ["one"]
    assert [f.split("/")[-1] for f in incremental.scan_files(spark, scanned, schema).inputFiles()] == [f.split("/")[-1] for f in scanned]  # the scan names only what has changed
    put([], "two")  # emptied
    same()
    for f in (tmp_path / "data" / "three+ a%20b{x}").glob("*.parquet"):
        f.unlink()  # deleted
    assert same() == []
    assert {r.rows_scanned for r in incremental.stored_profile(spark, log, schema).collect()} == {1}
    runs = incremental._runs(spark, log)
    (tmp_path / "log" / f"run={runs[-1]}" / "_SUCCESS").unlink()  # a run that was stopped is written again
    same()
    assert incremental._runs(spark, log) == runs


# -- heavy tokens ------------------------------------------------------------------------------
@pytest.fixture
def sides(spark):
    left = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 100 = 1 THEN NULL WHEN id % 100 = 2 THEN 'HASH_NULL' ELSE concat('k', id % 40) END AS token", "id % 7 AS a", "map('x', id % 2) AS m")
    right = spark.range(90).selectExpr("IF(id % 3 = 0, 'hot', concat('k', id % 50)) AS other", "id AS b")
    return left, right


def test_heavy_link_equals_the_plain_one(spark, sides):
    left, right = sides
    rows = lambda df: Counter((r.token, r.a, str(r.m), r.b) for r in df.collect())
    want = rows(link(left, right, "token", "other"))
    for share, cells in ((0.01, 4), (0.2, 16), (1.1, 4)):
        assert rows(heavy.link_heavy(left, right, "token", "other", share, cells)) == want
    assert heavy.link_heavy(left, right, "token", "other").columns == link(left, right, "token", "other").columns
    none = left.limit(0)
    assert heavy.link_heavy(none, right, "token", "other").count() == 0
    with pytest.raises(ValueError, match="both sides"):
        heavy.link_heavy(left, right.withColumnRenamed("b", "a"), "token", "other")


def test_heavy_totals_equal_those_of_the_pairs(spark, sides):
    left, right = sides[0].withColumns({"c": F.expr("IF(a = 3, NULL, a)")}), sides[1].withColumns({"d": F.expr("IF(b % 4 = 0, NULL, b % 4)")})
    sums = {"x": "a", "y": "b"}
    rows = lambda df: Counter(map(tuple, df.collect()))
    pairs = link(left, right, "token", "other")
    for by in (["c", "d"], ["token"], ["d"], []):
        want = rows(pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("x"), F.sum("b").alias("y")))
        for share in (0.01, 1.1):
            assert rows(heavy.link_heavy(left, right, "token", "other", share, 4, by, sums)) == want
    assert heavy.link_heavy(left.limit(0), right, "token", "other", by=["d"]).count() == 0
    with pytest.raises(ValueError, match="whole numbers"):
        heavy.link_heavy(left, right, "token", "other", by=["c"], sums={"x": "token"})
    n = 10**6  # 10^12 pairs of one token
    hot = lambda token, k: spark.range(n).selectExpr(f"'hot' AS {token}", f"id AS {k}")
    assert heavy.link_heavy(hot("token", "a"), hot("other", "b"), "token", "other", by=[], sums={"x": "a"}).first() == (n * n, n * (n * (n - 1) // 2))


def test_a_hot_token_lies_in_every_cell(spark, sides):
    left, right = sides
    assert heavy.frequent_tokens(left, "token", 0.1) == ["hot"]
    placed = heavy._grid(left.where("token = 'hot'"), "line", "column", 4)
    per = {(r["__line"], r["__column"]): r.n for r in placed.groupBy("__line", "__column").agg(F.sum("__line_n").alias("n")).collect()}
    assert len(per) == 16 and max(per.values()) < 2 * min(per.values()) and sum(per.values()) == 4 * 1000
    many = spark.createDataFrame([("x", 10001)], "v string, n long")
    assert heavy._repeated(many, "n").count() == 10001


def test_arrays_as_rows(spark):
    rows = [("a", v % 7 if v % 5 else None) for v in range(200)] + [(None, 3), (None, 1), ("b", None), ("hot", 1)] + [("hot", 1)] * 9000
    df = spark.createDataFrame(rows, "g string, v int").repartition(5)
    got = {}
    for r in array_rows(df, "v", ["g"]).collect():
        assert got.setdefault(r.g, {}).setdefault(r.position, r.v) == r.v
    arrays = {r.g: r.v for r in aggregate(df, ["ARRAY_AGG(v) AS v"], ["g"]).collect()}
    assert {g: [x[i + 1] for i in range(len(x))] for g, x in got.items()} == arrays
    whole = array_rows(df, "v").orderBy("position").collect()
    assert [r.position for r in whole] == list(range(1, len(rows) + 1)) and [r.v for r in whole] == aggregate(df, ["ARRAY_AGG(v) AS v"]).first().v
    assert array_rows(df.limit(0), "v", ["g"]).count() == 0


# -- token index -----------------------------------------------------------------------------------
def test_token_index(spark, tmp_path):
    people = spark.createDataFrame([(i, f"u{i % 50}@x.org" if i % 10 else None, "hot") for i in range(500)], "id long, mail string, kind string")
    token_index.build_token_index(people, "mail", SALT, "people_index", str(tmp_path / "a"), buckets=8)
    token_index.build_token_index(people.selectExpr("id AS other", "mail").where("other < 100"), "mail", SALT, "other_index", str(tmp_path / "b"), buckets=8)
    found = token_index.lookup(spark, "people_index", "u7@x.org", SALT)
    assert {r.id for r in found.collect()} == {i for i in range(500) if i % 50 == 7}
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # plans then name the buckets
    try:
        assert "SelectedBucketsCount: 1 out of 8" in plan(token_index.lookup(spark, "people_index", "u7@x.org", SALT))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert token_index.lookup(spark, "people_index", None, SALT).count() == 0
    both = token_index.link_indexes(spark, "people_index", "other_index")
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    want = sum(1 for i in range(500) for j in range(100) if i % 10 and j % 10 and i % 50 == j % 50)
    assert both.count() == want and both.where(F.col("token") == NULL_TOKEN).count() == 0
    assert token_of("u7@x.org", SALT) in {r.token for r in both.collect()}
    with pytest.raises(ValueError, match="both sides"):
        token_index.link_indexes(spark, "people_index", "people_index")
    with pytest.raises(ValueError, match="named"):
        token_index.build_token_index(people.withColumn("token", F.lit(1)), "mail", SALT, "bad_index", str(tmp_path / "c"))


# -- audit streams -----------------------------------------------------------------------------------
def line(i, minute=0, **more):
    return json.dumps({"ts": f"2024-01-01T00:{minute:02d}:00.000Z", "event_type": "backend_call", "invocation_id": f"i{i}", **more})


def lines_of(spark, folder):
    return spark.readStream.schema("value string").text(folder)


def test_audit_sink_writes_each_event_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    out, bad, state = (str(tmp_path / n) for n in ("out", "bad", "state"))

    def run(name, *lines):
        if name:
            (source / name).write_text("\n".join(lines) + "\n")
        for stream in audit_sink.audit_sink(lines_of(spark, str(source)), out, bad, state):
            stream.awaitTermination()
        return Counter(r.invocation_id for r in audit_sink.read_sink(spark, out).collect())

    assert run("a.txt", line(1), line(1), line(2, 5), "no json", "{\"ts\": 7", line(3, event_type="odd")) == {"i1": 1, "i2": 1}
    assert run("b.txt", line(2, 5), line(4, 6), "", "no json") == {"i1": 1, "i2": 1, "i4": 1}  # sent again in a later batch
    kept = Counter(r.line for r in spark.read.parquet(f"{bad}/batch=*").collect())
    assert kept["no json"] == 2 and kept["{\"ts\": 7"] == 1 and sum(kept.values()) == 5
    # the last batch is replayed: its commits are lost
    for side in ("events", "bad"):
        commits = [p for p in (tmp_path / "state" / side / "commits").iterdir() if not p.name.startswith(".")]
        newest = max(commits, key=lambda p: int(p.name))
        newest.unlink()
        crc = newest.with_name(f".{newest.name}.crc")
        if crc.exists():
            crc.unlink()
    assert run(None) == {"i1": 1, "i2": 1, "i4": 1}
    assert Counter(r.line for r in spark.read.parquet(f"{bad}/batch=*").collect()) == kept


def test_sessions_of_ties_nulls_and_late_events(spark):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    rows = [("a", at(0)), ("a", at(10)), ("a", at(30)), ("a", at(30)), ("a", at(51)), (None, at(5)), ("b", None), ("c", at(0))]
    df = spark.createDataFrame([(k, t, "click") for k, t in rows], "k string, ts timestamp, event_type string")
    got = {(r.k, r.started_at, r.n_events) for r in sessions.gap_sessions(df, "k", gap="20 minutes").collect()}
    assert got == {("a", at(0), 4), ("a", at(51), 1), (None, at(5), 1), ("c", at(0), 1)}


def test_a_late_event_joins_two_sessions(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    schema = "k string, ts timestamp, event_type string"
    for i, minutes in enumerate(([0, 30], [15], [300])):
        rows = [("a" if m < 300 else "z", at(m), "click") for m in minutes]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        sessions.sessions_stream(source, "k", str(tmp_path / "out"), str(tmp_path / "state"), gap="20 minutes").awaitTermination()
    got = spark.read.schema("k string, started_at timestamp, ended_at timestamp, n_events long, total_invocations long").parquet(str(tmp_path / "out" / "batch=*"))
    assert [(r.k, r.started_at, r.ended_at, r.n_events) for r in got.collect()] == [("a", at(0), at(30), 3)]


def test_compacted_counts_are_the_same(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    schema, out = "ts timestamp, event_type string", str(tmp_path / "out")
    assert not (tmp_path / "out").exists()

    def run(*minutes):
        spark.createDataFrame([(at(m), "x") for m in minutes], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        windows.counts_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), out, str(tmp_path / "state"), lateness="1 day").awaitTermination()
        return {(r.window_start, r.n_events) for r in windows.latest_counts(spark, out).collect()}

    assert run(0, 10, 70) == {(at(0), 2), (at(60), 1)}
    assert run(20) == {(at(0), 3), (at(60), 1)}
    newest = windows.compact_counts(spark, out)
    files = windows.latest_counts(spark, out).inputFiles()
    assert files and all(f"base={newest}" in f for f in files)
    assert run(71, 200) == {(at(0), 3), (at(60), 2), (at(180), 1)}
    assert windows.compact_counts(spark, out) > newest
    assert run(5) == {(at(0), 4), (at(60), 2), (at(180), 1)}


def test_a_policy_learns_and_replays_alike(spark, tmp_path):
    data, versions, state = (str(tmp_path / n) for n in ("data", "versions", "state"))
    schema = "id long, note string, mail string"
    batches = [[(1, "clean", None)], [(2, "call 555-123-4567", "x")], [(3, "clean again", "a@b.co")], []]

    def run(rows):
        if rows is not None:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        learning.learning_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), data, versions, state, SALT).awaitTermination()
        return sorted(map(tuple, learning.read_learned(spark, data, ["id", "note", "mail"]).collect()))

    for rows in batches:
        got = run(rows)
    tok = lambda x: token_of(x, SALT)
    want = [("1", "clean", None, 0), ("2", tok("call 555-123-4567"), "x", 1), ("3", tok("clean again"), tok("a@b.co"), 2)]
    assert got == want
    assert learning.version_before(spark, versions, 2) == [("note", ["phone"], 1)] and learning.version_before(spark, versions, 0) == []
    last = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    crc = last.with_name(f".{last.name}.crc")
    if crc.exists():
        crc.unlink()
    assert run(None) == want


# -- sketches, trails, prefixes -------------------------------------------------------------------------
def test_sketches_merge_without_the_events(spark):
    rows = [(datetime(2024, 1, 1, h), "x", float(v), v % 90) for h in range(6) for v in range(h, 600, 3)] + [(datetime(2024, 1, 1), "y", None, None), (None, "x", 5.0, 1)]
    events = spark.createDataFrame(rows, "ts timestamp, kind string, v double, u long")
    hourly = sketches.hourly_sketches(events, ["kind"], "v", "u").cache()
    got = {(r.span_start, r.kind): r for r in sketches.span_report(hourly.where("hour IS NOT NULL"), ["kind"], 6).collect()}
    x, y = got[datetime(2024, 1, 1), "x"], got[datetime(2024, 1, 1), "y"]
    values = sorted(v for t, k, v, _ in rows if k == "x" and t)
    assert x.n_events == len(values) and abs(sum(v <= x.p for v in values) / len(values) - 0.95) < 0.02
    assert abs(x.users - 90) <= 3 and abs(x.avg_value - sum(values) / len(values)) < 1e-9
    assert (y.n_events, y.p, y.avg_value, y.users) == (1, None, None, 0)
    hourly.unpersist()


def test_trails_against_a_plain_automaton(spark):
    rng = random.Random(8)
    kinds = {k: i for i, s in enumerate(trail.STEPS) for k in s.kinds} | {"odd": None}
    rows = [(f"i{i}", rng.randint(0, 6), rng.choice(list(kinds))) for i in range(300) for _ in range(rng.randint(1, 7))]
    rows += [(None, 1, "tool_invocation"), ("only-odd", 1, "odd"), ("untimed", None, "tool_invocation")]
    events = spark.createDataFrame(rows, "invocation_id string, ts int, event_type string")
    got = {r.invocation_id: r for r in trail.trail_faults(events).collect()}
    assert len(got) == len({r[0] for r in rows})
    for key, r in got.items():
        seen = sorted((t, kinds[k]) for i, t, k in rows if i == key and t is not None and kinds[k] is not None)
        n, refused = Counter(s for _, s in seen), any(k in trail.REFUSALS for i, _, k in rows if i == key)
        want = set()
        for i, s in enumerate(trail.STEPS):
            due = {"invocation": True, "policy": n[1] > 0, "call": not refused, "end": True}.get(s.name, False)
            if due and not n[i]:
                want.add(f"missing:{s.name}")
            if s.once and n[i] > 1:
                want.add(f"repeated:{s.name}")
        highest = {}
        for t, s in seen:  # a step after a later one
            if any(s2 > s and t2 < t for t2, s2 in highest.items()):
                want.add(f"misplaced:{trail.STEPS[s].name}")
            highest[t] = max(highest.get(t, -1), s)
        assert set(r.faults) == want and r.complete == (not want) and r.n_events == sum(i == key for i, _, _ in rows)


def test_longest_prefixes(spark):
    keys = ["a/b/c.txt", "a/b", "ab", "", None, "x/y", "a/b/c.txt"]
    listing = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, n int")
    prefixes = ["a", "a/b/", "x/y/z", None, "a/b/"]
    of = lambda ps: {r.n: r.matched_prefix for r in inventory.longest_prefix(listing, spark.createDataFrame([(p,) for p in ps], "p string")).collect()}
    assert of(prefixes) == {0: "a/b/", 1: "a", 2: "a", 3: None, 4: None, 5: None, 6: "a/b/"}
    assert of(["", "x"]) == {0: "", 1: "", 2: "", 3: "", 4: None, 5: "x", 6: ""}
    assert set(of([]).values()) == {None}
    kept = inventory.allowed_by_prefixes(listing, spark.createDataFrame([(p,) for p in prefixes], "p string"))
    assert {r.n for r in kept.collect()} == {0, 1, 2, 6} and kept.columns == listing.columns
    assert "NestedLoop" not in plan(kept)


def test_delivery_is_one_pass(spark, tmp_path):
    """The summary equals that of the staged way, and says what was written; the table is read once."""
    rows = [(i, f"mail a{i}@b.co" if i % 2 else "clean", f"city {i}") for i in range(30)]
    reads = spark.sparkContext.accumulator(0)
    spark.udf.register("counted", lambda x: reads.add(1) or x)  # a test's own look at how often rows are read
    df = spark.createDataFrame(rows, "id long, note string, city string").selectExpr("id", "counted(note) AS note", "city")
    profile = get_profile("databricks").with_tables(lambda _spark, _entity: df)
    ask = lambda **more: Request("databricks", "all the rows", "customers", pii_policy="mask", **more)
    for most, limit, n, truncated in ((None, None, 30, None), (10, None, 10, True), (40, None, 30, False), (30, None, 30, False), (10, 5, 5, None)):
        order = ("id",) if most or limit else ()  # (a sort of all rows samples them first)
        reads.value = 0
        got = deliver(spark, ask(limit=limit, order_by=order), str(tmp_path / f"out-{most}-{limit}"), Settings(salt=SALT, max_rows=most), profile)
        summary = got.summary.first()
        assert reads.value <= 30 and got.metadata.get("truncated") is truncated
        want = secure_query(spark, ask(limit=limit, order_by=order), Settings(salt=SALT, max_rows=most), profile)
        assert summary == want.summary.first() and summary.row_count == n
        assert sorted(map(tuple, got.df.collect())) == sorted(map(tuple, want.df.collect()))
    with pytest.raises(ValueError, match="masking"):
        deliver(spark, Request("databricks", "all the rows", "customers", pii_policy="hash"), str(tmp_path / "no"), Settings(salt=SALT), profile)


def test_policy_files_reach_the_rule_table(spark):
    rules = Rules.from_dict({"column_classifications": {"exact": ["Card"], "contains": ["Tail"]}, "backend_overrides": {"trino": {"additional_pii_columns": ["Extra"]}}})
    rows = {(r.kind, r.text, r.backend) for r in rule_table.rule_rows(spark, rules).collect()}
    assert rows == {("exact", "card", None), ("contains", "tail", None), ("backend", "extra", "trino")}


def test_queries_are_registered_with_twins():
    assert set(q.queries()) <= set(registry.queries()) and set(q.queries()) == set(q.oracle_sql())


def test_objects_are_written_where_their_rows_are_read(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, "text", "en" if i % 3 else "de", "web", 4) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(q, "scratch", lambda _spark: str(tmp_path / "out"))
    read = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # a task each
    try:
        got = q.object_listing(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", read)
    assert sorted(map(tuple, got)) == [("lang=de", "application/json", True, 20), ("lang=en", "application/json", True, 40)]
    assert len(list((tmp_path / "out" / "store" / "lang=en").glob("*.json"))) == 3
