"""A training corpus from raw documents: five stages, each over all that its predecessor kept.

``run(spark, sf_dir)`` applies them to ``documents``. Each stage's rows are written as Parquet to
the shared folder and reread as the next one's input, so an executor lost later costs no earlier
stage. The last stage can't be said in SQL, so there is no twin (``ORACLE_SQL`` is None); the tests
compare ``run`` with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm import bpe, exactdup, mixing, neardup, quality
from cloakframe.llm.frames import importable, saved

ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being rated good is one half at least (operator 7)."""
    importable(spark)
    model = quality.fit(docs, quality.grades(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.keep_good(docs, model)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (operator 6)."""
    return exactdup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, similarity of 0.8 (operator 5)."""
    return neardup.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target proportions; a document comes once for every time that the mix takes it (operator 4)."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str, path: str | None = None) -> DataFrame:
    """Token ids of the whole texts, with their number and whether they decode to the text (operator 8)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    vocabulary = bpe.load(spark, path)
    rows = bpe.encode(docs, vocabulary, decoded="decoded")
    n = F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)")
    same = F.col("decoded").eqNullSafe(F.coalesce("text", F.lit("")))
    return rows.select("doc_id", "source", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), same.alias("round_trip"), "ids")


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mix", mixed),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
