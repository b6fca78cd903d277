"""Exact top-k search by columnar branch-and-bound.

Vectors lie in vertical layout, one array per dimension. Scores accumulate block of dimensions
by block, those with the most mass first; what the remaining dimensions can add is at most the
product of the remaining norms, and candidates whose bound falls below the k-th best known score
are compacted away. What survives all blocks is exact.

Queries and candidates are dealt into blocks by a hash of their id, and every pair of a query
block and a candidate block is one group of rows, so no side is broadcast. The best k of each pair
are merged by a window.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm.frames import importable

QUERY_BLOCK, BLOCK, DIMENSIONS = 2048, 8192, 16
_EXACT = 1 << 53


def _matrix(table: pa.Table, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and floor(scale * x), one row for each id; shorter vectors are filled up with 0."""
    ids = table.column("vec_id").to_numpy()
    lists = table.column("vector").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    values, sizes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(lists.offsets.to_numpy())
    wide = int(sizes.max(initial=0))
    if (sizes == wide).all():
        x = values.reshape(len(ids), wide)
    else:
        x = np.zeros((len(ids), wide))
        x[np.repeat(np.arange(len(ids)), sizes), np.concatenate([np.arange(s) for s in sizes])] = values
    x = np.floor(scale * x)
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    if len(ids) and (ids[1:] == ids[:-1]).any():  # rows that repeat an id count once, by their smallest vector
        order = np.lexsort([*x.T[::-1], ids])
        ids, x = ids[order], x[order]
        first = np.concatenate([[True], ids[1:] != ids[:-1]])
        ids, x = ids[first], x[first]
    return ids, x


def best(q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and scores of its k best candidates, its own id left out: by score, then by smaller id. Candidates come in the order of ids."""
    d = max(queries.shape[1], rows.shape[1])
    queries, rows = (np.pad(x, ((0, 0), (0, d - x.shape[1]))) for x in (queries, rows))
    if d * float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) >= _EXACT:
        return _large(q_ids, queries, ids, rows, k)
    order = np.argsort(-np.square(rows).sum(0), kind="stable")
    queries, columns = queries[:, order], np.ascontiguousarray(rows[:, order].T)
    cuts = list(range(0, d, DIMENSIONS)) + [d]
    # norms of what remains behind each cut
    left_q = [np.sqrt(np.square(queries[:, c:]).sum(1)) for c in cuts]
    left_x = [np.sqrt(np.square(columns[c:]).sum(0)) for c in cuts]
    half = len(cuts) // 2 if d else 0  # the blocks in which hardly anything can be pruned are summed for many queries at once
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for a in range(0, len(queries), 128):
        part = queries[a : a + 128, : cuts[half]] @ columns[: cuts[half]]
        for i in range(len(part)):
            q, sums = queries[a + i], part[i]
            alive = np.flatnonzero(ids != q_ids[a + i])
            sums = sums[alive]
            floor = -np.inf
            if len(alive) > 4 * k:  # a k-th best score to begin with: the best so far, in full
                lead = np.argpartition(-sums, 4 * k)[: 4 * k]
                floor = np.partition(sums[lead] + q[cuts[half] :] @ columns[cuts[half] :, alive[lead]], -k)[-k]
            for b in range(half, len(cuts) - 1):
                bound = sums + left_q[b][a + i] * left_x[b][alive]
                keep = bound + 1e-6 * (1 + np.abs(bound)) >= floor
                alive, sums = alive[keep], sums[keep]
                sums = sums + q[cuts[b] : cuts[b + 1]] @ columns[cuts[b] : cuts[b + 1], alive]
            top = np.lexsort((alive, -sums))[:k]
            out.append((ids[alive[top]], sums[top].astype(np.int64)))
    return out


def _large(q_ids, queries, ids, rows, k):
    """The same for numbers beyond the exact range of doubles: whole numbers of any size; scores are held within 64 bits."""
    whole = [[int(v) for v in r] for r in rows]
    out = []
    for own, q in zip(q_ids, queries, strict=True):
        q = [int(v) for v in q]
        scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(map(int.__mul__, q, r)))), i) for i, r in zip(ids.tolist(), whole, strict=True) if i != own)[:k]
        out.append((np.array([i for _, i in scores], np.int64), np.array([-s for s, _ in scores], np.int64)))
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0) -> DataFrame:
    """Of vectors and queries (vec_id, vector) each query's k best rows: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``.

    The score is the inner product of floor(scale * x). Rows with a null id or a vector that is
    null or holds null or non-finite components take no part; rows that repeat an id count once;
    an id is never its own result. Fewer rows than k: all. An empty table: none.
    """
    importable(vectors.sparkSession)
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    vectors, queries = (df.select(F.col("vec_id").cast("long"), F.col("vector").cast("array<double>")).filter("vec_id IS NOT NULL").filter(F.coalesce(finite, F.lit(False))) for df in (vectors, queries))
    c, r = (max(1, math.ceil(df.count() / size)) for df, size in ((vectors, BLOCK), (queries, QUERY_BLOCK)))
    deal = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    vectors = vectors.withColumn("c", deal(c, 1)).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(r - 1))))
    queries = queries.withColumn("r", deal(r, 2)).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(c - 1))))

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        q_ids = np.zeros(0, np.int64)
        if left.num_rows and right.num_rows:
            q_ids, q = _matrix(left, scale)
            found = best(q_ids, q, *_matrix(right, scale), k)
        sizes = [len(i) for i, _ in found]
        ids, scores = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (([i for i, _ in found]), ([s for _, s in found])))
        return pa.table({"query_id": np.repeat(q_ids, sizes) if sizes else q_ids[:0], "vec_id": ids, "score": scores})

    pairs = queries.groupBy("r", "c").cogroup(vectors.groupBy("r", "c")).applyInArrow(pair, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
