"""What the operators share: saved intermediate tables, ordering within hot groups, and array access to Arrow text."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: The folder of this process's intermediate tables.
_RUN = f"llm-{uuid.uuid4().hex}"
#: A regular expression for a word, and one for the white space between words.
WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (a cluster that installs it needs nothing)."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Unset, it is allowed in a local session only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.sparkContext.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """The rows of ``df`` written once to the shared folder and read back: later jobs neither repeat its work nor need its lineage.

    Parquet keeps columns apart, so a later job reads only those that it needs.
    """
    path = f"{shared_folder(df.sparkSession)}/{_RUN}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_saved(spark: SparkSession) -> None:
    """Delete what ``saved`` has written in this process; call it when the results that came of it are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{_RUN}")
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """``row``, all columns of ``df`` as one, and further columns, whose names then can't clash with them."""
    return df.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in more.items()])


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    while name in df.columns:
        name = "_" + name
    return name


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list[Column], size: Column, total: str) -> DataFrame:
    """Adds ``total``: the sum of ``size`` over the rows of the same keys up to and with this one, by bucket and then by order.

    ``bucket`` splits every key into many ranges of its order, so no key is sorted in one
    task: rows are sorted within a bucket, and of the other buckets only sums are needed.
    """
    row = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, bucket).agg(F.sum(size).alias("_sum"))
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, bucket])], F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    same = [F.col(f"_k{i}").eqNullSafe(F.col(k)) for i, k in enumerate([*keys, bucket])]
    out = df.withColumn("_within", F.sum(size).over(row))
    return out.join(sums, same).withColumn(total, F.col("_within") + F.col("_before")).drop("_within", "_before", *[f"_k{i}" for i in range(len(keys) + 1)])


# -- Arrow text as arrays ------------------------------------------------------------------
def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: none), and where each text starts; one more entry for the end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, starts, data = column.buffers()
    at = np.frombuffer(starts, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if starts else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data and at[-1] > at[0] else np.empty(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices whose texts have about ``most`` bytes at most together, or a single row."""
    at = utf8(batch.column(column))[1]
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit values with their bits well mixed (the finaliser of a common 64-bit hash)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_CODES_LOWER = _CODES[_LOWER]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 20
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, _BLOCK + (1 << 16)), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        if len(have) <= 4 * _BLOCK:
            _powers[base] = have
    return have


def word_hashes(raw: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of all texts: 64-bit hash, first byte and end in ``raw``; and which is the first word of each text (one more for the end).

    Works through blocks of about a megabyte that end between words, so memory follows the
    number of words. ``lower`` folds A-Z.
    """
    codes = _CODES_LOWER if lower else _CODES
    starts_at = at[:-1][at[1:] > at[:-1]]
    hashes, firsts, ends = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    a, n = 0, len(raw)
    while a < n:
        b = min(a + _BLOCK, n)
        while b < n:  # to the next space
            gap = np.flatnonzero(_IS_SPACE[raw[b : b + 4096]])
            if len(gap):
                b += int(gap[0])
                break
            b = min(b + 4096, n)
        part = raw[a:b]
        inside = ~_IS_SPACE[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cut = starts_at[(starts_at >= a) & (starts_at < b)] - a
        first[cut] = inside[cut]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        before = cut[cut > 0] - 1
        last[before] = inside[before]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(codes[part] * _power(_BASE, len(part))[: len(part)], out=sums[1:])
        h = (sums[e] - sums[s]) * _power(_BASE_INVERSE, len(part))[s]
        hashes.append(mixed(h + (e - s).astype(np.uint64)))
        firsts.append(s + a)
        ends.append(e + a)
        a = b
    s = np.concatenate(firsts)
    return np.concatenate(hashes), s, np.concatenate(ends), np.searchsorted(s, at)


_MASKS = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)


def exact_ids(raw: np.ndarray, first: np.ndarray, end: np.ndarray, hashes: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Equal ids for equal words (of equal groups), and where each id's word occurs first; words of equal hashes are compared byte by byte."""
    n = end - first
    _, where, ids = np.unique(hashes, return_index=True, return_inverse=True)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) + 1, np.dtype("<u8"), padded, strides=(1,))
    same = n == n[where][ids]
    if group is not None:
        same &= group == group[where][ids]
    left, k = np.flatnonzero(same & (n > 0)), 0
    while len(left) and k < 256:
        mask = _MASKS[np.minimum(n[left] - k, 8)]
        same[left] = (eight[first[left] + k] & mask) == (eight[first[where][ids[left]] + k] & mask)
        k += 8
        left = left[same[left] & (n[left] > k)]
    for i in left.tolist():  # long ones
        j = where[ids[i]]
        same[i] = i == j or np.array_equal(raw[first[i] : end[i]], raw[first[j] : end[j]])
    more: dict[tuple, int] = {}
    for i in np.flatnonzero(~same).tolist():  # two words of one hash: the others get ids of their own
        word = (0 if group is None else int(group[i]), raw[first[i] : end[i]].tobytes())
        if word not in more:
            more[word] = len(where)
            where = np.append(where, i)
        ids[i] = more[word]
    return ids, where


def run_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of ``raw`` that follow one another, in blocks of about a megabyte."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + _BLOCK, "right")))
        part = raw[starts[a] : ends[b - 1]]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_CODES[part] * _power(_BASE, len(part))[: len(part)], out=sums[1:])
        s, e = starts[a:b] - starts[a], ends[a:b] - starts[a]
        h = (sums[e] - sums[s]) * _power(_BASE_INVERSE, len(part) + 1)[s]
        out[a:b] = mixed(h + (e - s).astype(np.uint64))
        a = b
    return out


def gathered(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``pool`` that begin at ``starts``, one after the other."""
    before = np.cumsum(lengths) - lengths
    return pool[np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)]


def shingle_hashes(words: np.ndarray, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the runs of ``k`` words of each text (fewer words: the whole sequence as one), and where each text's begin."""
    n = np.diff(of)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    start = np.concatenate([[0], np.cumsum(count)])
    factor = mixed(np.arange(1, k + 1, dtype=np.uint64))
    if len(words) >= k:
        runs = sum((words[i : len(words) - k + 1 + i] * factor[i] for i in range(k)), np.zeros(len(words) - k + 1, np.uint64))
        runs = mixed(runs)
    else:
        runs = np.empty(0, np.uint64)
    ok = np.ones(len(runs), bool)
    for i in range(1, k):  # runs that would reach into the next text
        at = of[1:] - i
        at = at[(at >= of[:-1]) & (at < len(runs))]
        ok[at] = False
    out = np.empty(start[-1], np.uint64)
    long = n >= k
    where = np.ones(start[-1], bool)
    where[start[:-1][(n > 0) & ~long]] = False
    out[where] = runs[ok]
    for d in np.flatnonzero((n > 0) & ~long):
        w = words[of[d] : of[d + 1]]
        out[start[d]] = mixed(np.array([(w * factor[: len(w)]).sum() + np.uint64(len(w))], np.uint64))[0]
    return out, start
