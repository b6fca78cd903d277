"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade >= k) = logistic(x . w - threshold_k): one weight vector over hashed text features,
shared by all grades, and one ordered threshold per step. It gives an expected grade and tail
probabilities, by which documents are selected.

Features of the whole text, all hashed: forms of words (their last bytes, case, length, whether
they repeat the word before) as shares of all words, and the words themselves, A-Z lower-cased,
scaled by the square root of the number of words.

The fit uses a bounded sample of rated rows (``ROWS``, in the order of a hash of the id) in one
task; scoring is row-local.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.frames import importable, mixed, unused, utf8, word_hashes

ROWS, FORMS, WORDS, ROUNDS, RIDGE = 6000, 1 << 12, 1 << 18, 120, 1e-4
_KIND = np.zeros(256, np.uint64)  # of a byte: other, lower, upper, digit, beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word of all texts its form's and its own bucket; and which is the first word of each text (one more for the end)."""
    raw, at = utf8(texts)
    h, s, e, of = word_hashes(raw, at)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), of
    last, before, first = raw[e - 1].astype(np.uint64), raw[np.maximum(e - 2, s)], raw[s]
    again = np.zeros(len(h), np.uint64)
    again[1:] = h[1:] == h[:-1]
    again[of[:-1][of[:-1] < len(h)]] = 0
    plain = (_KIND[raw[e - 1]] == 1) | (_KIND[raw[e - 1]] == 4)
    tail = np.where(plain, np.uint64(1), last)  # which letter ends a word says little
    length = np.minimum(e - s, 15).astype(np.uint64) // np.uint64(3)
    form = tail | _KIND[before] << np.uint64(8) | _KIND[first] << np.uint64(12) | again << np.uint64(16) | length << np.uint64(20)
    return (mixed(form) % np.uint64(FORMS)).astype(np.int64), (h % np.uint64(WORDS)).astype(np.int64), of


def _scales(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.diff(of)
    row = np.repeat(np.arange(len(n)), n)
    return row, 1 / np.maximum(n, 1), 1 / np.sqrt(np.maximum(n, 1))


class Model:
    """Weights of forms and of words, and the thresholds in order."""

    def __init__(self, forms: np.ndarray, words: np.ndarray, thresholds: np.ndarray):
        self.forms, self.words, self.thresholds, self.name = forms, words, thresholds, uuid.uuid4().hex

    def tails(self, texts: pa.Array) -> np.ndarray:
        """P(grade >= k) for k = 1 .. top, a row for each text; a text without words has the thresholds' own."""
        form, word, of = features(texts)
        row, share, root = _scales(of)
        n = len(of) - 1
        eta = np.bincount(row, self.forms[form], n) * share + np.bincount(row, self.words[word], n) * root
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - eta[:, None], -500, 500)))


def learn(texts: pa.Array, grades: np.ndarray, top: int, rounds: int = ROUNDS, ridge: float = RIDGE) -> Model:
    """The weights of greatest likelihood (Adam on all rows). Grades that never occur leave their thresholds at the neighbours'."""
    parts, counts = [], [np.zeros(0, np.int64)]
    for a in range(0, len(texts), 64):  # a few texts at a time: their words' arrays are much larger than the buckets
        form, word, of = features(texts.slice(a, 64))
        parts.append((form.astype(np.int16), word.astype(np.int32)))
        counts.append(np.diff(of))
    form, word = (np.concatenate([np.zeros(0, t), *[p[i] for p in parts]]) for i, t in enumerate((np.int16, np.int32)))
    parts.clear()
    row, share, root = _scales(np.concatenate([[0], np.cumsum(np.concatenate(counts))]))
    row, share, root = row.astype(np.int32), share.astype(np.float32), root.astype(np.float32)
    n = len(grades)
    sizes = [FORMS, WORDS, top]
    rare = [max((grades >= k).mean(), 0.5 / n) if n else 0.5 for k in range(1, top + 1)]
    first = np.array([np.log(max(1 - p, 0.5 / max(n, 1)) / p) for p in rare])
    gaps = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    x = np.concatenate([np.zeros(FORMS + WORDS), gaps])
    moved, spread = np.zeros(len(x)), np.zeros(len(x))
    cut = np.cumsum(sizes)[:-1]

    def thresholds(gap: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate([gap[:1], np.exp(gap[1:])]))

    if not n:
        return Model(x[:FORMS], x[FORMS : FORMS + WORDS], thresholds(gaps))
    for t in range(1, rounds + 1):
        forms, words, gap = np.split(x, cut)
        theta = thresholds(gap)
        eta = np.bincount(row, forms.astype(np.float32)[form], n) * share + np.bincount(row, words.astype(np.float32)[word], n) * root
        tail = np.column_stack([np.ones(n), 1 / (1 + np.exp(np.clip(theta[None, :] - eta[:, None], -40, 40))), np.zeros(n)])
        above, over = tail[np.arange(n), grades], tail[np.arange(n), grades + 1]
        p = np.maximum(above - over, 1e-9)
        slope = (1 - above - over) / n
        g_theta = np.zeros(top + 2)
        np.add.at(g_theta, grades, -above * (1 - above) / p / n)
        np.add.at(g_theta, grades + 1, over * (1 - over) / p / n)
        g_theta = g_theta[1 : top + 1]
        g_gap = np.cumsum(g_theta[::-1])[::-1]
        g_gap[1:] *= np.exp(gap[1:])
        g = np.concatenate([np.bincount(form, (slope * share).astype(np.float32)[row], FORMS), np.bincount(word, (slope * root).astype(np.float32)[row], WORDS), g_gap])
        g[: FORMS + WORDS] -= ridge * x[: FORMS + WORDS]
        moved += 0.1 * (g - moved)
        spread += 0.01 * (g * g - spread)
        x = x + 0.3 / np.sqrt(t) * (moved / (1 - 0.9**t)) / (np.sqrt(spread / (1 - 0.99**t)) + 1e-8)
    forms, words, gap = np.split(x, cut)
    return Model(forms, words, thresholds(gap))


def fit(docs: DataFrame, ratings: DataFrame, grade_col: str = "grade", id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS) -> Model:
    """A model of the rated rows of ``docs``: at most ``rows`` of them, in the order of a hash of the id, learned from in one task.

    Ratings are integers from 0 (null: not rated). An id that is rated twice counts twice.
    Without ratings every text gets probability one half.
    """
    importable(docs.sparkSession)
    rated = ratings.filter(F.col(grade_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("id"), "id", "grade").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = texts.join(F.broadcast(chosen), "id").select("text", "grade")  # at most ``rows`` ids

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        grades = np.concatenate([np.zeros(0, np.int64), *[p.column("grade").to_numpy(zero_copy_only=False) for p in parts]]).astype(np.int64)
        texts = pa.concat_arrays([p.column("text") for p in parts]) if parts else pa.array([], pa.string())
        top = max(1, int(grades.max(initial=1)))
        m = learn(texts, np.maximum(grades, 0), top)
        yield pa.record_batch([pa.array([x.astype(np.float32 if len(x) > top else np.float64).tobytes()]) for x in (m.forms, m.words, m.thresholds)], ["forms", "words", "thresholds"])

    ordered = sample.withColumn("_order", F.xxhash64("text", "grade")).repartition(1).sortWithinPartitions("_order").select("text", "grade")
    got = ordered.mapInArrow(one, "forms binary, words binary, thresholds binary").first()
    if got is None:  # nothing is rated
        return Model(np.zeros(FORMS), np.zeros(WORDS), np.zeros(1))
    return Model(np.frombuffer(got["forms"], np.float32).astype(float), np.frombuffer(got["words"], np.float32).astype(float), np.frombuffer(got["thresholds"], np.float64))


def _slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about two megabytes of text each: the arrays of their words are many times larger."""
    at = utf8(batch.column(column))[1]
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``expected_grade`` and ``tails`` (P(grade >= 1), P(grade >= 2) ...), which replace columns of these names.

    A null text counts as empty; a text without words is judged by the thresholds alone.
    """
    from pyspark.sql.types import ArrayType, DoubleType, StructType

    spark = docs.sparkSession
    importable(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.drop("expected_grade", "tails").withColumn(text_col, F.col(text_col).cast("string"))
    schema = StructType([*rows.schema.fields]).add("expected_grade", DoubleType()).add("tails", ArrayType(DoubleType()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in _slices(batch, text_col):
                tails = m.tails(part.column(text_col))
                wide = tails.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(tails) + 1) * wide, wide, dtype=np.int32)), pa.array(tails.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tails.sum(1)), lists], [*part.schema.names, "expected_grade", "tails"])

    return rows.mapInArrow(work, schema)


def grades(labels: DataFrame) -> DataFrame:
    """Ratings from 0/1 labels: 0 for poor text, 1 for good text that is toxic, 2 for good text."""
    toxic = F.coalesce(F.col("toxic"), F.lit(0))
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(toxic == 1, 1).otherwise(2)).alias("grade"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", step: int = 1, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all their columns, with P(grade >= step) of at least ``least``."""
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    importable(spark)
    shared = spark.sparkContext.broadcast(model)
    text = unused(docs, "_text")
    rows = docs.withColumn(text, F.col(text_col).cast("string"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in _slices(batch, text):
                ok = m.tails(part.column(text))[:, step - 1] >= least
                yield part.filter(pa.array(ok)).select([n for n in part.schema.names if n != text])

    return rows.mapInArrow(work, StructType([*docs.schema.fields]))
