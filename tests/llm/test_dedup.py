"""Exact and near deduplication against brute force."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from cloakframe.llm import exactdup, neardup

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def exact_truth(rows):
    groups = {}
    for r in rows:
        groups.setdefault(SPACE.sub(" ", r.text or ""), []).append(r.doc_id)
    out = []
    for r in rows:
        text = SPACE.sub(" ", r.text or "")
        ids = [i for i in groups[text] if i is not None]
        keep = min(ids) if ids else None
        out.append((r.doc_id, keep, len(groups[text]), r.doc_id == keep, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def shingles(text, k):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()


def near_truth(rows, k, percent):
    sets = [shingles(r.text, k) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            low[find(i)] = min(low.get(find(i), r.doc_id), r.doc_id)
    out = [(r.doc_id, len(sets[i]), low.get(find(i)) if sets[i] else r.doc_id) for i, r in enumerate(rows)]
    return sorted(((d, n, c, d == c) for d, n, c in out), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_copies(odd, none, small):
    for docs in (odd, small):
        assert got(exactdup.mark_copies(docs)) == exact_truth(docs.select("doc_id", "text").collect())
    assert exactdup.mark_copies(none).count() == 0 and exactdup.drop_copies(none).columns == none.columns


def test_digests_that_clash_are_told_apart(spark):
    docs = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "aa"), (4, "cc")], "doc_id long, text string")
    clash = lambda c: F.length(c).cast("long")
    out = {r.doc_id: (r.keep_id, r.group_size) for r in exactdup.mark_copies(docs, digest=clash).collect()}
    assert out == {1: (1, 2), 2: (2, 1), 3: (1, 2), 4: (4, 1)}


def test_null_ids_are_verified_too(spark):
    docs = spark.createDataFrame([(None, "aa"), (None, "bb"), (None, "aa"), (7, "cc")], "doc_id long, text string")
    clash = lambda c: F.length(c).cast("long")
    out = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size) for r in exactdup.mark_copies(docs, digest=clash).collect())
    assert out == [(0, 0, 1), (0, 0, 2), (0, 0, 2), (7, 7, 1)]


def test_documents_are_not_shuffled(spark, sf001):
    """No exchange of the marks holds a text: what is read again is what was saved of it."""
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    text = exactdup.mark_copies(docs)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in text


def test_dropped_copies(odd):
    out = exactdup.drop_copies(odd)
    assert out.columns == odd.columns
    want = sorted({(d, SPACE.sub(" ", r.text or "")) for r in odd.collect() for d, k, n, kept, s in [next(x for x in exact_truth(odd.collect()) if x[0] == r.doc_id and x[4] == hashlib.sha256(SPACE.sub(" ", r.text or "").encode()).hexdigest())] if kept}, key=repr)
    assert sorted(((r.doc_id, SPACE.sub(" ", r.text or "")) for r in out.collect()), key=repr) == want


def test_chunks_are_the_whole_text(spark):
    docs = spark.createDataFrame([(t,) for t in ("", "a", "x" * 9000, "word " * 3000, "é\n" * 700)], "text string")
    for r in docs.select("text", exactdup.chunks(F.col("text")).alias("c")).collect():
        assert "".join(r.c) == r.text and all(0 < len(c) <= 2048 for c in r.c)


@pytest.mark.parametrize("k", [4, 5])
def test_near_copies(odd, none, small, k):
    for docs in (odd, small):
        assert got(neardup.near_components(docs, words=k)) == near_truth(docs.select("doc_id", "text").collect(), k, 80)
    assert neardup.near_components(none, words=k).count() == 0


def test_one_large_group(spark):
    """Near copies of which many pairs are below the threshold, in one component."""
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base[: 3 * (i % 30)] + [f"z{i % 30}"] + base[3 * (i % 30) + 1 :])) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(neardup.near_components(docs, words=4)) == near_truth(docs.collect(), 4, 80)


def test_null_ids_link_and_go(spark):
    """A near copy under a null id is linked, links others, and goes; an unlike text under a null id stays."""
    base = [f"w{i}" for i in range(100)]
    at = lambda n: " ".join(base[n:] + [f"x{i}" for i in range(n)])
    alone = "nothing like the others at all"
    rows = [(1, at(0), 1), (None, at(8), 2), (2, at(16), 3), (None, alone, 4), (None, None, 5), (None, "", 6), (None, at(8), 7), (None, "a null near copy " + at(30)[::-1], 8), (3, "three", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    for k in (4, 5):
        want = near_truth(docs.select("doc_id", "text").collect(), k, 80)
        assert got(neardup.near_components(docs, words=k)) == want
        assert [c for d, _, c, _ in want if d == 2] == [1] and sum(d is None and c == 1 for d, _, c, _ in want) == 2
    out = neardup.drop_near_copies(docs)
    assert out.columns == docs.columns and sorted(r.n for r in out.collect()) == [1, 4, 5, 6, 8, 9]


def test_pruning_bounds():
    """A pair at the threshold is hardly ever dropped."""
    import math

    for n, m in zip((64, 128, 192, 256), neardup.needed(80, neardup.MISS), strict=True):
        assert sum(math.comb(n, i) * 0.85**i * 0.15 ** (n - i) for i in range(m)) < 1e-3


def test_pruning_of_all_batches_together():
    """A pair at the threshold is dropped in one of the batches no more often than the bands miss it."""
    import math

    left, lost = {0: 1.0}, 0.0
    one = [math.comb(neardup.BATCH, i) * 0.85**i * 0.15 ** (neardup.BATCH - i) for i in range(neardup.BATCH + 1)]
    for m in neardup.needed(80, neardup.MISS):
        now = {}
        for n, p in left.items():
            for i, q in enumerate(one):
                now[n + i] = now.get(n + i, 0.0) + p * q
        lost += sum(p for n, p in now.items() if n < m)
        left = {n: p for n, p in now.items() if n >= m}
    assert lost < (1 - 0.8**neardup.ROWS) ** neardup.BANDS < 5e-5


def test_blocks_of_a_bucket(spark, monkeypatch):
    """Many members of several components, compared in small blocks."""
    import random

    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base + [f"x{rng.randint(0, 40)}-{i % 9}" for _ in range(rng.randint(3, 14))])) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(neardup.near_components(docs, words=4)) == near_truth(docs.collect(), 4, 80)
