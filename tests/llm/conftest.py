import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, _id string, shard string, taken string, tails string"


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls in every column, empty and very long texts, ties, repeated rows and columns with clashing names."""
    rng = random.Random(3)
    words = "the of and to that with from this which there here lorem ipsum".split()
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    same = text(40)
    texts = [None, "", " \n\t ", "one", "one two three", "123 456", same, same, same.replace(" ", "\n"), same + " more", text(20000), "x" * 100000, "Ünï çødé 日本語", same.upper()]
    rows = [(i, t, ("en", "fr", None)[i % 3], ("a", "b", None)[i % 3], len(t or ""), "i", "x", "s", "t", "u") for i, t in enumerate(texts)]
    rows += [rows[6], rows[3], (None, same, None, None, None, None, None, None, None, None), (6, "another text under the same id", "en", "a", 1, "", "", "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).cache()
    yield docs
    docs.unpersist()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet").cache()  # other tests look at the plans of the same table
    yield docs
    docs.unpersist()
