"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source has a token budget. Complete epochs of a source come first; what remains of its
budget is filled in the order of exponential keys -ln(u) / weight, so that documents of greater
weight tend to come first, up to the budget (of the last document only the part that fits). u is
a hash of the id, so runs agree.

A source of any size is ranked without sorting it whole: its keys are dealt into ranges of their
logarithm, sums of the ranges show in which one the budget ends, and only that range is sorted. A
weight shifts the logarithm and no more, so a range holds at most 2.6e-4 of the documents of any weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm.frames import WORD, packed, running_total, saved

BUCKETS = 1024  # ranges for every doubling of the key
WEIGHTS = (1, 2, 3)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(id_col: str) -> Column:
    """A number between 0 and 1 (both excluded) from the first 48 bits of the id's MD5."""
    bits = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 12), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 48))


def plain_share(text: Column) -> Column:
    """A document's quality weight: the share of its words that are letters, with one mark behind at most; 0.05 at least."""
    plain = F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])\p{L}+[.,;:!?]?(?![^\x20\x09-\x0D])"))
    return F.greatest(F.lit(0.05), F.coalesce(plain.cast("double") / F.greatest(n_words(text), F.lit(1)), F.lit(0.0)))


def text_print(text_col: str) -> Column:
    """A number that tells the texts of rows with equal ids apart."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def key_range(key: Column) -> Column:
    """The number of the key's range; it rises with the key (null and NaN: the last one)."""
    level = F.greatest(F.lit(-1e6), F.least(F.lit(1e6), F.floor(F.log2(key) * BUCKETS).cast("double")))
    return F.when(key.isNull() | F.isnan(key), 1000001).when(key <= 0, -1000001).otherwise(level.cast("int"))


def targets(sizes: DataFrame, most: float = 3.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Of sources and sizes (source, source_size) each one's target.

    Sources in the order of their names' code points (null last) weigh ``weights`` in turn and share
    the sum of all sizes. A target stops at ``most`` times its source's size; what is over is shared
    by weight among the others until none is above. That is a level x with target = min(cap, weight
    * x): sources reach their caps in the order of cap / weight. One row per source is sorted.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(by_name) - 1
    rows = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights) + 1).cast("int")))
    rows = rows.withColumn("_cap", F.col("source_size") * F.lit(float(most))).withColumn("_at", F.col("_cap") / F.col("_w"))
    everything = Window.partitionBy()
    below = Window.orderBy("_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_all", F.sum("source_size").over(everything)).withColumn("_weight", F.sum("_w").over(everything))
    rows = rows.withColumn("_capped", F.coalesce(F.sum("_cap").over(below), F.lit(0.0))).withColumn("_spent", F.coalesce(F.sum("_w").over(below), F.lit(0.0)))
    rows = rows.withColumn("_level", (F.col("_all") - F.col("_capped")) / (F.col("_weight") - F.col("_spent")))
    level = F.max(F.when(F.col("_level") <= F.col("_at"), F.col("_level"))).over(everything)
    return rows.withColumn("target", F.least(F.col("_cap"), F.col("_w") * F.coalesce(level, F.lit(float("inf"))))).select("source", "source_size", "target")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, most: float = 3.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row for each row of ``docs``: id, source, ``size`` in words, ``source_size``, ``target``, ``taken``.

    ``taken`` counts words with repeats: whole epochs, then the document's part of the last one. A
    null or empty text has size 0 and is never taken; a null source is a source. Rows with equal
    ids have equal keys and count one after another. An empty table gives none.
    """
    text = F.col(text_col).cast("string")
    key = -F.log(uniform(id_col)) / (plain_share(text) if weight is None else weight)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(text).alias("size"), key.alias("key"), text_print(text_col).alias("print"))
    rows = saved(rows.withColumn("bucket", key_range(F.col("key"))))
    ranges = rows.groupBy("source", "bucket").agg(F.sum("size").alias("range_size"))
    sizes = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), most, weights)
    goal = F.floor(F.col("target") + 0.5).cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    sizes = sizes.withColumn("epochs", full).withColumn("rest", goal - F.col("epochs") * F.col("source_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    ranges = ranges.join(sizes, ranges["source"].eqNullSafe(sizes["source"])).select(
        ranges["source"].alias("s"), F.col("bucket").alias("b"), "before", "range_size", "source_size", "target", "epochs", "rest"
    )
    rows = rows.join(ranges, rows["source"].eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    room = F.col("rest") - F.col("before")
    whole = F.when(F.col("range_size") <= room, F.col("size")).otherwise(F.lit(0))
    split = (room > 0) & (F.col("range_size") > room)
    inside = Window.partitionBy("source", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = rows.filter(split)
    ended = ended.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), room - (F.sum("size").over(inside) - F.col("size")))))
    out = rows.filter(~split).withColumn("part", whole).unionByName(ended)
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"), "epochs", "part", "print")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix as rows of ``docs`` with all their columns: a document once for every epoch, and once more if at least half of it fits into the last one.

    Of rows with equal id, source and text as many come once more as ``mix`` says; which of them is settled by the order of their other columns.
    """
    taken = mix(docs, id_col, text_col, source_col, **how)
    more = (F.col("size") > 0) & (2 * F.col("part") >= F.col("size"))
    times = taken.groupBy(F.col(id_col).alias("_id"), F.col("source").alias("_source"), F.col("print").alias("_print")).agg(
        F.max("epochs").cast("int").alias("_epochs"), F.count("*").alias("_rows"), F.count_if(more).alias("_more")
    )
    times = times.filter("_epochs > 0 OR _more > 0")
    rows = packed(docs, key=F.col(id_col), source=F.col(source_col).cast("string"), print=text_print(text_col))
    both = rows.join(times, rows["key"].eqNullSafe(times["_id"]) & rows["source"].eqNullSafe(times["_source"]) & (rows["print"] == times["_print"]))
    # rows of one id, source and text that differ in their copies: the budget ends among them, at most once a source
    split = (F.col("_more") > 0) & (F.col("_more") < F.col("_rows"))
    plain = both.filter(~split).select("row", (F.col("_epochs") + F.when(F.col("_more") > 0, 1).otherwise(0)).cast("long").alias("_n"))
    odd = both.filter(split).groupBy("row", "_epochs", "_more").agg(F.count("*").alias("_same"))
    odd = odd.withColumn("_range", F.pmod(F.xxhash64(F.to_json("row")), F.lit(BUCKETS)))
    odd = running_total(odd, ["_epochs", "_more"], "_range", [F.to_json("row")], F.col("_same"), "_upto")
    last = F.greatest(F.lit(0), F.least(F.col("_same"), F.col("_more") - (F.col("_upto") - F.col("_same"))))
    odd = odd.select("row", (F.col("_epochs") * F.col("_same") + last).cast("long").alias("_n"))
    return plain.unionByName(odd).filter("_n > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select("row.*")
