"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its content says so, a chunk is known by a digest, and a text by its
recipe: the ordered list of its chunks' identifiers. Recipes are about a hundredth of the
texts, so whole documents are never shuffled, sorted or compared. Digests become verified
identifiers: the least and greatest SHA-256 of the contents of a digest must be one, over
the chunks of all repeated recipes. A digest with two contents is replaced by SHA-256 of the
text in the recipes that hold it.

Groups of copies of any size collapse in partial aggregates before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.frames import SPACE, packed, saved

#: A chunk has at least 256 characters, ends behind one of these pairs, and has at most 2,048 characters (fixed values of the recipe).
CHUNK = r"(?s).{256,2048}?(?<=[aeiourns][dgkpt .,])|.{1,2048}"


def normalised(text: Column) -> Column:
    """Runs of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def chunks(text: Column, pattern: str = CHUNK) -> Column:
    """The pieces of a text in order; together they are the text."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = CHUNK, digest=F.xxhash64) -> DataFrame:
    """One row for each row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when their normalised forms are; a null text counts as empty. The smallest
    id of a group is kept (null ids last; of rows with the same id every one counts as kept).
    Empty table: empty result. Other columns play no part.
    """
    text = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    parts = F.transform(chunks(F.col("_text"), pattern), lambda c: F.struct(digest(c).alias("d"), F.unhex(F.sha2(c, 256)).alias("s")))
    rows = rows.select("_id", F.sha2("_text", 256).alias("text_sha256"), parts.alias("_parts"))
    rows = rows.select("_id", "text_sha256", F.col("_parts.d").alias("_recipe"), F.col("_parts.s").alias("_contents"))
    rows = saved(rows.withColumn("_print", F.xxhash64(F.lit("recipe"), "_recipe")))
    # the contents of all chunks of recipes that occur again
    # (a table of its own, so that a join with it can split the rows of a large group)
    again = saved(rows.groupBy("_print").agg(F.count("*").alias("_n")).filter("_n > 1").select("_print"))
    pieces = rows.join(again, "_print", "left_semi").select(F.explode(F.arrays_zip("_recipe", "_contents")).alias("_c"))
    unsure = pieces.groupBy(F.col("_c._recipe").alias("_digest")).agg(F.min("_c._contents").alias("_a"), F.max("_c._contents").alias("_b")).filter("_a <> _b")
    unsure = unsure.select("_digest")
    held = rows.select("_print", F.explode(F.array_distinct("_recipe")).alias("_digest")).join(unsure, "_digest", "left_semi").select("_print").distinct()
    # one row for each content, however many copies; a text with an unsure chunk is known by the SHA-256 of its content beside its recipe
    contents = rows.groupBy("_print", "_recipe", "text_sha256").agg(F.min("_id").alias("_low"), F.count("*").alias("_n"))
    contents = contents.join(held.withColumn("_unsure", F.lit(True)), "_print", "left")
    contents = contents.withColumn("_exact", F.when(F.col("_unsure"), F.col("text_sha256")).otherwise(F.lit("")))
    key = ["_print", "_recipe", "_exact"]
    groups = contents.groupBy(*key).agg(F.min("_low").alias("keep_id"), F.sum("_n").alias("group_size"))
    known = contents.join(groups, key).select("_print", "text_sha256", "keep_id", "group_size")  # a content has one recipe
    return rows.join(known, ["_print", "text_sha256"]).select(
        F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated rows with the same id and text one stays.

    The texts are moved once, to the marks of their ids; rows with equal ids then lie together.
    """
    marks = mark_copies(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_sha"))
    rows = packed(docs, id=F.col(id_col), key=F.sha2(normalised(F.col(text_col)), 256))
    out = rows.join(marks, rows["id"].eqNullSafe(marks["_id"]) & (rows["key"] == marks["_sha"]), "left_semi")
    return out.dropDuplicates(["id", "key"]).select("row.*")
