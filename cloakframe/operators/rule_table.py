"""Labelling column names by rules that are a table: many thousand names and fragments.

``label_names`` folds the rules into one expression, which suits a few dozen. Here the rules are
rows, so the plan is the same for ten and for a million. Every rule lies in an inverted index
under one key: a whole name, or one q-gram of a fragment, the one that the fewest fragments hold.
Names look up all their keys by one equi-join; the candidates are verified, and the first rule by
precedence (exact, contains, pattern, backend; then position) wins. Before that join, keys that no
rule has are dropped where they arise, by a table of at most ``SLOTS`` hash values of the rules' keys.

Results. Labels are one row for each distinct name (and backend), so a name that a third of all rows hold is
looked up once. Null and empty names match no key but their own. Rules that repeat count with their
smallest position. Fragments shorter than a q-gram are keys themselves; an empty one is refused, as it
would label everything. Patterns are code and stay an expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakframe.functions.names import name_category, name_sensitivity
from cloakframe.functions.regex import java_pattern
from cloakframe.functions.sql import lit
from cloakframe.rules import Rules

RULE_SCHEMA = "kind string, position long, text string, backend string"
GRAM = 4
#: Hash values that tell which keys rules have, and how often fragments hold a q-gram; what shares one only costs time.
SLOTS = 1 << 18
_AT = 1 << 20
# Precedence of the kinds of rules (fixed values).
_RANK = {"exact": 0, "contains": 1, "pattern": 2, "backend": 3}


def rule_rows(spark: SparkSession, rules: Rules) -> DataFrame:
    """The names and fragments of a rule set as a table (``kind``, ``position``, ``text``, ``backend``)."""
    n = rules.names
    rows = [("exact", i, x, None) for i, x in enumerate(n.exact)] + [("contains", i, x, None) for i, x in enumerate(n.contains)]
    rows += [("backend", i, x, b) for b, names in n.backends.items() for i, x in enumerate(names)]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def _grams(x: str, least: int, most: int) -> Column:
    """All distinct substrings of ``least`` to ``most`` characters."""
    of = f"transform(sequence(1, char_length({x}) - __n + 1), __i -> substring({x}, __i, __n))"
    every = f"transform(sequence({least}, {most}), __n -> IF(char_length({x}) >= __n, {of}, CAST(array() AS ARRAY<STRING>)))"
    return F.expr(f"array_distinct(flatten({every}))")


def _slot(key: str | Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLOTS)).alias("__slot")


def rule_index(rules: DataFrame, gram: int = GRAM) -> DataFrame:
    """``key``, ``rank``, ``position``, ``text``, ``backend``: every rule under one key.

    A fragment's key is its rarest q-gram among all fragments, so that common ones don't
    gather many rules. The counts are one aggregate by hash value, so small that every task
    has it: a fragment's q-grams are made, compared and dropped where it lies.
    """
    low = rules.select("kind", F.lower("text").alias("text"), "position", F.col("backend"))
    whole = low.where("kind IN ('exact', 'backend') AND text IS NOT NULL")
    whole = whole.select(
        F.when(F.col("kind") == "exact", F.concat(F.lit("e:"), "text")).otherwise(F.concat(F.lit("b:"), F.coalesce("backend", F.lit("")), F.lit(":"), "text")).alias("key"),
        F.when(F.col("kind") == "exact", _RANK["exact"]).otherwise(_RANK["backend"]).alias("rank"), "position", "text", "backend",
    )
    fragments = low.where("kind = 'contains' AND text IS NOT NULL").groupBy("text").agg(F.min("position").alias("position"))
    fragments = fragments.where(F.expr("IF(text = '', raise_error('an empty fragment would label every name'), true)"))
    size = f"least({gram}, char_length(text))"
    grams = fragments.select("text", "position", F.posexplode(F.expr(f"transform(sequence(1, char_length(text) - {size} + 1), __i -> substring(text, __i, {size}))")).alias("at", "gram"))
    grams = grams.select("text", "position", "at", _slot("gram"))
    count = grams.groupBy("__slot").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.min(F.col("n") * _AT + F.col("at") % _AT).alias("best")  # one number: how often, and where in the text
    best = grams.join(F.broadcast(count), "__slot").groupBy("text", "position").agg(rarest)
    gram = F.expr(f"substring(text, CAST(best % {_AT} AS INT) + 1, {size})")
    parts = best.select(F.concat(F.lit("c:"), gram).alias("key"), F.lit(_RANK["contains"]).alias("rank"), "position", "text", F.lit(None).cast("string").alias("backend"))
    return whole.unionByName(parts)


def label_by_rules(names: DataFrame, index: DataFrame, column: str = "column_name", backend: str | None = None, patterns: tuple[str, ...] = (), gram: int = GRAM) -> DataFrame:
    """``column``, (``backend``,) ``n_rows``, ``is_pii``, ``sensitivity``, ``category``, ``match_reason`` for every distinct name.

    ``backend`` names a column of ``names``. ``index`` comes from ``rule_index`` with the same ``gram``.
    """
    of = [F.col(column).alias("__name"), (F.col(backend) if backend else F.lit(None)).cast("string").alias("__backend")]
    distinct = names.select(*of).groupBy("__name", "__backend").agg(F.count(F.lit(1)).alias("n_rows"))
    low = distinct.withColumn("__low", F.lower("__name"))
    keys = F.concat(
        F.array(F.concat(F.lit("e:"), "__low")),
        F.when(F.col("__backend").isNotNull(), F.array(F.concat(F.lit("b:"), "__backend", F.lit(":"), "__low"))).otherwise(F.array().cast("array<string>")),
        F.transform(_grams("__low", "1", str(gram)), lambda g: F.concat(F.lit("c:"), g)),
    )
    asked = low.where("__low IS NOT NULL").select("__name", "__backend", F.explode(keys).alias("key"))
    held = index.select(_slot("key")).distinct()
    asked = asked.withColumn("__slot", _slot("key")).join(F.broadcast(held), "__slot", "left_semi").drop("__slot")
    met = asked.join(index, "key").where(f"rank <> {_RANK['contains']} OR contains(lower(__name), text)")
    reason = F.expr("CASE rank WHEN 0 THEN 'exact_match' WHEN 1 THEN concat('contains_pattern:', text) ELSE concat('backend_override:', backend) END")
    first = met.groupBy(F.col("__name").alias("__n"), F.col("__backend").alias("__b")).agg(F.min_by(F.struct("rank", reason.alias("reason")), F.struct("rank", "position", "text")).alias("__best"))
    same = F.col("__name").eqNullSafe(F.col("__n")) & F.col("__backend").eqNullSafe(F.col("__b"))
    by_pattern = "coalesce(" + ", ".join([f"IF(lower(__name) RLIKE {lit(java_pattern(p))}, {lit('regex_pattern:' + p)}, NULL)" for p in patterns] + ["NULL"]) + ")"
    found = low.join(first, same, "left").withColumn("__pattern", F.expr(f"CAST({by_pattern} AS STRING)"))
    words = F.expr(f"IF(__best.rank < {_RANK['pattern']}, __best.reason, coalesce(__pattern, __best.reason))")
    found = found.withColumn("match_reason", words)
    out = [F.col("__name").alias(column)] + ([F.col("__backend").alias(backend)] if backend else [])
    return found.select(
        *out, "n_rows", F.col("match_reason").isNotNull().alias("is_pii"), F.expr(name_sensitivity("__name", "match_reason")).alias("sensitivity"),
        F.expr(name_category("__name", "match_reason")).alias("category"), "match_reason",
    )


def label_rows(rows: DataFrame, labels: DataFrame, column: str = "column_name") -> DataFrame:
    """``rows`` with the labels of their names: a join with one row a name, so hot names don't multiply."""
    right = labels.drop("n_rows").withColumnRenamed(column, "__name")
    return rows.join(right, F.col(column).eqNullSafe(F.col("__name")), "left").drop("__name")


def positions(rules: DataFrame, kind: str, *order: str) -> DataFrame:
    """Rules of one kind from rows with ``text``, in ranges of the order: ``position`` follows it without sorting all rows in one task.

    Write the result before it is used twice: the ranges come from a sample, so the numbers, though not their order, may differ the next time.
    """
    ranged = rules.select("text", *order).repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    within = ranged.withColumn("position", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return within.select(F.lit(kind).alias("kind"), (F.col("__part").cast("long") * (1 << 33) + F.col("position")).alias("position"), "text", F.lit(None).cast("string").alias("backend"))
