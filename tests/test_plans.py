"""Shapes of physical plans: what must hold at any scale."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from cloakframe.operators import audit, linkage
from cloakframe.operators.profile import profile_table
from cloakframe.operators.protect import hash_table, redact_table
from cloakframe.operators.relational import aggregate, filter_equal, order_limit
from cloakframe.plans.policy import apply_policy
from cloakframe.sources.profiles import get_profile

SALT = "test-salt-123"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def docs(spark, sf001):
    return spark.read.parquet(f"{sf001}/documents.parquet")


@pytest.mark.parametrize("name", [n for n in registry.core_names() if not n.startswith("stream_")])
def test_no_python_and_no_cross_join(spark, sf001, name):
    text = plan(registry.queries()[name](spark, sf001))
    for node in ("PythonUDF", "ArrowEval", "BatchEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text


def test_row_local_operators_do_not_shuffle(docs):
    for df in (redact_table(docs), hash_table(docs, SALT), apply_policy(docs, "mask").df, apply_policy(docs, "hash", salt=SALT).df):
        assert "Exchange" not in plan(df)


def test_only_needed_columns_are_read(docs):
    text = plan(redact_table(docs).select("text"))
    assert "ReadSchema: struct<text:string>" in text
    text = plan(profile_table(docs, columns=["lang"]))
    assert "ReadSchema: struct<lang:string>" in text


def test_profile_is_one_scan_and_one_row_exchange(docs):
    text = plan(profile_table(docs))
    assert text.count("FileScan") == 1 and text.count("Exchange SinglePartition") == 1 and "partial_count" in text


def test_filters_reach_the_scan_below_the_policy(spark, sf001):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    orders = spark.read.parquet(f"{sf001}/orders.parquet")
    df = apply_policy(filter_equal(orders, {"o_orderstatus": "F", "o_custkey": 7, "o_totalprice": 1.5}), "mask").df
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan(df)).group(1)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    for part in ("EqualTo(o_orderstatus,F)", "EqualTo(o_custkey,7)", "EqualTo(o_totalprice,1.5)"):
        assert part in pushed


def test_aggregates_are_partial_and_topk_is_one_operator(spark, sf001):
    orders = spark.read.parquet(f"{sf001}/orders.parquet")
    wanted = ["COUNT(*)", "SUM(o_totalprice) AS s", "STDDEV(o_totalprice)", "APPROX_DISTINCT(o_custkey)"]
    text = plan(aggregate(orders, wanted, ["o_orderstatus"]))
    assert "partial_sum" in text and "partial_count" in text and text.count("Exchange hashpartitioning") == 1
    top = plan(order_limit(orders, ["o_totalprice DESC"], 10, get_profile("trino")))
    assert "TakeOrderedAndProject" in top and "Exchange rangepartitioning" not in top


def test_links_reduce_each_side_first(spark, sf001):
    orders = hash_table(spark.read.parquet(f"{sf001}/orders.parquet").select("o_orderkey", "o_custkey"), SALT, ["o_custkey"])
    customers = hash_table(spark.read.parquet(f"{sf001}/customer.parquet").select("c_custkey"), SALT, ["c_custkey"])
    counts = plan(linkage.linkage_counts(orders, customers, "o_custkey", "c_custkey"))
    assert counts.count("partial_count") == 2
    semi = plan(linkage.link(customers, orders, "c_custkey", "o_custkey", "left_semi"))
    assert "HashAggregate" in semi and "LeftSemi" in semi


def test_hot_token_is_one_row_per_side(spark):
    hot = spark.range(30000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"))
    tokens = hash_table(hot, SALT)
    counted = linkage.linkage_counts(tokens, tokens, "k")
    top = counted.orderBy(F.desc("pairs")).first()
    assert top.pairs == 10000 * 10000 and counted.count() == 20001


def test_reports_have_small_partial_state(spark, sf001):
    events = spark.read.parquet(f"{sf001}/events.parquet")
    for df in (audit.invocation_report(events, "user_id"), audit.window_counts(events)):
        text = plan(df)
        assert "partial_count" in text and text.count("Exchange hashpartitioning") == 1
