"""Near-duplicates by MinHash bands and sequential Bayesian verification.

1. Every text becomes the set of its word shingles' hashes, a signature of minimum hashes and
   band values. Texts with the same set collapse to one node (a partial aggregate, so groups of
   copies of any size cost one row per task).
2. Nodes that share a band value are candidates. Instead of all pairs of a bucket, rounds of
   stars link its members to a pivot (first the node that shares most buckets with others); only
   members whose components still differ are compared with each other in the end, so a bucket of
   one component costs its size, and no candidate pair that could join two is left out.
3. A candidate pair's signatures are compared batch by batch, two bits of every hash, where the
   pair is formed: such bits agree with probability x = (1 + 3 * similarity) / 4. With a uniform
   prior for the similarity, the posterior of x after m of n agreements is Beta(m + 1, n - m + 1)
   above 1/4; a pair is dropped when its probability of reaching the threshold is below ``miss``,
   before anything is moved or counted for it.
4. Survivors are verified on their full sets. Members that still have a likely partner of another
   component are compared in blocks of ``BLOCK``: a task gets two blocks' sets and returns the
   links that join components, never more than it has members. Connected components of the links
   are found by alternating large-star and small-star steps over tables in the shared folder.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from cloakframe.llm.frames import importable, mixed, packed, saved, shingle_hashes, utf8, word_hashes

BANDS, ROWS, BATCH, MISS = 25, 5, 64, 1e-5  # all batches together drop a pair at similarity 0.8 with probability 4.2e-5
FIRST_BANDS, BLOCK = 8, 512
HASHES = 256  # the bands take the first 125
_FACTORS = mixed(np.arange(1000, 1000 + HASHES, dtype=np.uint64)) | np.uint64(1)
_SHIFTS = mixed(np.arange(5000, 5000 + HASHES, dtype=np.uint64))


# -- sets and signatures of texts ----------------------------------------------------------
def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after another, and where each set begins."""
    raw, at = utf8(texts)
    words, _, _, of = word_hashes(raw, at)
    shingles, start = shingle_hashes(words, of, k)
    sets = [np.unique(shingles[a:b]) for a, b in zip(start[:-1], start[1:], strict=True)]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return np.concatenate([np.empty(0, np.uint64), *sets]), np.concatenate([[0], np.cumsum(sizes)])


def prints(sets: np.ndarray, of: np.ndarray) -> list[bytes | None]:
    """A 128-bit name of each set; none for the empty set."""
    return [hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(of[:-1], of[1:], strict=True)]


def signatures(sets: np.ndarray, of: np.ndarray) -> np.ndarray:
    """HASHES minimum hashes (32 bits) of each set that isn't empty."""
    sizes = np.diff(of)
    full = np.flatnonzero(sizes)
    out = np.empty((len(full), HASHES), np.uint32)
    a = 0
    while a < len(full):  # as many sets at a time as the cache holds
        b = max(a + 1, int(np.searchsorted(of[full + 1], of[full[a]] + 32768, "right")))
        x, starts = sets[of[full[a]] : of[full[b - 1] + 1]], of[full[a:b]] - of[full[a]]
        if len(x) < 1 << 20:
            for i in range(HASHES):
                out[a:b, i] = np.minimum.reduceat(x * _FACTORS[i] + _SHIFTS[i], starts) >> np.uint64(32)
        else:  # one very long text, in parts
            for i in range(HASHES):
                out[a, i] = min(int((x[j : j + 65536] * _FACTORS[i] + _SHIFTS[i]).min()) for j in range(0, len(x), 65536)) >> 32
        a = b
    return out


def band_values(sigs: np.ndarray) -> np.ndarray:
    """A 64-bit value for each band of each signature, different between bands."""
    rows = sigs[:, : BANDS * ROWS].reshape(len(sigs), BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = np.broadcast_to(h, rows.shape[:2])
    for i in range(ROWS):
        h = mixed(h * np.uint64(0x100000001B3) + rows[:, :, i] + np.uint64(1))
    return h.view(np.int64)


def sketches(sigs: np.ndarray) -> np.ndarray:
    """Two bits of each hash: for every batch a 64-bit number of first bits and one of second bits."""
    batches = sigs.reshape(len(sigs), HASHES // BATCH, BATCH)
    bits = np.stack([batches >> np.uint32(k) & np.uint32(1) for k in (0, 1)], 2).astype(np.uint8)
    return np.packbits(bits, axis=3).view(np.uint64).reshape(len(sigs), -1).view(np.int64)


def _parts(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a few megabytes of text each (a longer text alone)."""
    _, at = utf8(batch.column("text"))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def _names(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                sets, of = shingle_sets(part.column("text"), k)
                yield pa.record_batch([part.column("doc_id"), pa.array(np.diff(of)), pa.array(prints(sets, of), pa.binary())], ["doc_id", "n_shingles", "node"])

    return work


def _signed(k: int):
    def lists(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                sets, of = shingle_sets(part.column("text"), k)
                sigs, sizes = signatures(sets, of), np.diff(of)
                nodes = pa.array([p for p in prints(sets, of) if p], pa.binary())
                yield pa.record_batch([nodes, pa.array(sizes[sizes > 0]), lists(sketches(sigs)), lists(band_values(sigs))], ["node", "size", "sketch", "bands"])

    return work


def _whole_sets(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                sets, of = shingle_sets(part.column("text"), k)
                rows = [(p, sets[a:b].tobytes()) for p, a, b in zip(prints(sets, of), of[:-1], of[1:], strict=True) if p]
                yield pa.record_batch([pa.array([p for p, _ in rows], pa.binary()), pa.array([s for _, s in rows], pa.binary())], ["node", "elements"])

    return work


# -- verification --------------------------------------------------------------------------
@functools.cache
def needed(percent: int, miss: float) -> list[int]:
    """For one batch, two batches ...: the fewest agreements with which P(similarity >= percent / 100) is at least ``miss``.

    For a Beta(m + 1, n - m + 1) posterior, P(x >= t) is P(Binomial(n + 1, t) <= m).
    """
    def tail(n: int, m: int, t: float) -> float:
        return sum(math.comb(n + 1, i) * t**i * (1 - t) ** (n + 1 - i) for i in range(m + 1))

    reach = (1 + 3 * percent / 100) / 4
    return [next(m for m in range(n + 1) if tail(n, m, reach) >= miss * tail(n, m, 0.25)) for n in range(BATCH, HASHES + 1, BATCH)]


def likely(percent: int, miss: float) -> Column:
    """Whether columns ``size_a``, ``sketch_a``, ``size_b``, ``sketch_b`` may belong to a linked pair."""
    ok = 100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")
    agree = F.lit(0)
    for i, m in enumerate(needed(percent, miss)):
        first, second = (F.col("sketch_a")[2 * i + k].bitwiseXOR(F.col("sketch_b")[2 * i + k]) for k in (0, 1))
        agree = agree + BATCH - F.bit_count(first.bitwiseOR(second))
        ok = ok & (agree >= m)
    return ok


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _linked(percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = ([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(c)] for c in ("set_a", "set_b"))
            ok = [_alike(x, y, percent) for x, y in zip(*sides, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return work


def _block_links(percent: int, miss: float):
    """Of a group's members those links that join components, whole sets compared."""

    def work(rows: pa.Table) -> pa.Table:
        least = needed(percent, miss)
        order = np.argsort(np.array(rows.column("node").to_pylist(), object), kind="stable")
        rows = rows.take(order)
        node, block = rows.column("node").to_pylist(), rows.column("block").to_numpy()
        sizes = rows.column("size").to_numpy()
        sketch = np.array(rows.column("sketch").to_pylist(), np.int64).view(np.uint64)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("elements").combine_chunks()]
        names, root = np.unique(np.array(rows.column("root").to_pylist(), object), return_inverse=True)
        one = rows.column("i")[0].as_py() == rows.column("j")[0].as_py()
        found = []
        for k in range(len(node)):
            rest = np.arange(k + 1, len(node))
            rest = rest[(root[rest] != root[k]) & (100 * np.minimum(sizes[rest], sizes[k]) >= percent * np.maximum(sizes[rest], sizes[k]))]
            if not one:
                rest = rest[block[rest] != block[k]]
            agree = np.zeros(len(rest), np.int64)
            for n, m in enumerate(least):
                differ = (sketch[rest, 2 * n] ^ sketch[k, 2 * n]) | (sketch[rest, 2 * n + 1] ^ sketch[k, 2 * n + 1])
                agree += BATCH - np.bitwise_count(differ)
                rest, agree = rest[agree >= m], agree[agree >= m]
            for p in rest:
                if root[p] != root[k] and _alike(sets[k], sets[p], percent):
                    found.append((node[k], node[p]))
                    root[root == root[p]] = root[k]
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    return work


def links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of nodes those whose whole sets are similar enough."""
    a = sets.select(F.col("node").alias("a"), F.col("elements").alias("set_a"))
    b = sets.select(F.col("node").alias("b"), F.col("elements").alias("set_b"))
    return saved(pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(_linked(percent), "a binary, b binary"))


# -- components ----------------------------------------------------------------------------
def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node of its component; roots too.

    A node's links to its smallest neighbour replace its other links, alternately for larger and
    for smaller neighbours, until the links are stars around roots. Minima are partial aggregates,
    so a node with very many links is never gathered.
    """
    def stars(df: DataFrame) -> bool:
        """Every node is either a root or linked to one root."""
        ends = df.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(df.select("b", F.lit(0), F.lit(1)))
        return ends.groupBy("n").agg(F.max("up").alias("up"), F.sum("down").alias("down")).filter("up + down > 1").isEmpty()

    links = saved(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    while not stars(links):
        both = links.union(links.select("b", "a")).toDF("u", "v")
        low = saved(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")))  # so that the join can split a node with many links
        large = both.filter("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b").alias("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e"))
        links = saved(small.select("e.*").filter("a < b").distinct())
    return saved(links.select(F.col("b").alias("node"), F.col("a").alias("root")).union(links.select("a", "a")).distinct())


# -- the operator --------------------------------------------------------------------------
def _with_nodes(k: int):
    """Adds the name of each row's set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                node = pa.array(prints(*shingle_sets(part.column("text"), k)), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("row"), node], ["row", "node"])

    return work


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """One row for each row of ``docs``: id, ``n_shingles``, ``component_id``, ``kept``.

    Texts are linked when 100 * |A and B| >= percent * |A or B| for their sets of ``words``-word
    shingles, A-Z lower-cased; a text of fewer words is one shingle; one without words is linked
    with nothing. ``component_id`` is the smallest id reachable, itself included; rows that repeat
    an id are each judged by their text (both are in a component through it). A null id is its own
    component unless its text is linked to one with an id. Empty table: empty result.
    """
    out = _near_components(docs, id_col, text_col, words, percent, miss)
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", "kept")


def _near_components(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, miss: float = MISS) -> DataFrame:
    """The rows of ``near_components`` with the name of each one's set, ``node`` (null: no words)."""
    spark = docs.sparkSession
    importable(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    named = saved(docs.mapInArrow(_names(words), f"doc_id {id_type}, n_shingles long, node binary"))
    signed = docs.mapInArrow(_signed(words), "node binary, size long, sketch array<bigint>, bands array<bigint>")
    nodes = signed.groupBy("node").agg(F.any_value(F.struct("size", "sketch", "bands")).alias("s"))
    nodes = saved(nodes.select("node", "s.*"))
    band = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    # (what is joined with bucket members is saved first, so that the join can split a large bucket)
    shared = saved(band.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    members = saved(band.join(shared, "key").select("key", "band", "node", "n"))
    met = members.groupBy("node").agg(F.sum("n").alias("met"))  # how often a node shares a bucket
    members = saved(members.drop("n").join(nodes.select("node", "size", "sketch").join(met, "node"), "node"))
    # the full sets of nodes that are candidates at all, from one document each
    wanted = named.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(members.select("node").distinct(), "node", "left_semi")
    # (merged at every size: texts move once, whether or not the ids of candidates would fit into a broadcast)
    texts = docs.join(wanted.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    sets = texts.mapInArrow(_whole_sets(words), "node binary, elements binary")
    # (nodes that only rows with a null id hold: no id leads to their texts, so the sets of such rows are collapsed by node)
    lost = docs.filter("doc_id IS NULL").mapInArrow(_whole_sets(words), "node binary, elements binary")
    lost = lost.groupBy("node").agg(F.any_value("elements").alias("elements")).join(wanted.filter("doc_id IS NULL").select("node"), "node", "left_semi")
    sets = sets.union(lost)
    sets = saved(sets.groupBy("node").agg(F.any_value("elements").alias("elements")))
    may = likely(percent, miss)

    def ordered(df: DataFrame) -> DataFrame:
        return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def stars(rows: DataFrame, seed: int) -> DataFrame:
        """Likely pairs of a member with its bucket's pivot, of different components, once."""
        rank = F.struct(-F.col("met"), "node") if seed == 1 else F.struct(F.xxhash64("node", F.lit(seed)), "node")
        low = rows.groupBy("key", "root").agg(F.min(F.struct(rank.alias("rank"), "node", "size", "sketch")).alias("p"))
        pivot = low.groupBy("key").agg(F.min(F.struct("p.rank", "p", "root")).alias("q"))
        pivot = pivot.select("key", F.col("q.p.node").alias("b"), F.col("q.p.size").alias("size_b"), F.col("q.p.sketch").alias("sketch_b"), F.col("q.root").alias("root_b"))
        pairs = rows.select("key", F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("sketch").alias("sketch_a"), "root").join(saved(pivot), "key")
        return ordered(pairs.filter("root <> root_b").filter(may))

    def still_open(root: DataFrame) -> DataFrame:
        """Members of buckets that hold more than one component."""
        rows = members.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
        ends = rows.groupBy("key", "root").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        return saved(rows.join(saved(ends.select("key")), "key"))

    def merged(root: DataFrame, new: DataFrame) -> DataFrame:
        return components(root.filter("root <> node").select(F.col("root").alias("a"), F.col("node").alias("b")).union(new))

    tried = saved(stars(members.filter(F.col("band") < FIRST_BANDS).withColumn("root", F.col("node")), 1))
    root = components(links(tried, sets, percent))
    pairs = stars(still_open(root), 2).join(tried, ["a", "b"], "left_anti")
    root = merged(root, links(pairs, sets, percent))
    # what is left: members that have a likely partner of another component in their bucket
    rows = still_open(root)
    a = rows.select("key", F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("sketch").alias("sketch_a"), "root")
    b = rows.select("key", F.col("size").alias("size_b"), F.col("sketch").alias("sketch_b"), F.col("root").alias("root_b"))
    left = a.join(b, (a["key"] == b["key"]) & (a["root"] != b["root_b"]) & may, "left_semi")
    left = saved(left.select("key", F.col("a").alias("node"), F.col("size_a").alias("size"), F.col("sketch_a").alias("sketch"), "root"))
    blocks = saved(left.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    left = left.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    groups = left.join(sets, "node").select("key", "i", "j", "block", "node", "size", "sketch", "root", "elements").groupBy("key", "i", "j")
    root = merged(root, saved(groups.applyInArrow(_block_links(percent, miss), "a binary, b binary")))
    # back to rows: the smallest id of each node, then of each component
    rooted = named.groupBy("node").agg(F.min("doc_id").alias("low")).join(root, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    lowest = rooted.filter("node IS NOT NULL").groupBy("root").agg(F.min("low").alias("component_id"))
    ids = rooted.join(lowest, "root").select("node", "component_id")
    alone = named.filter("node IS NULL").withColumn("component_id", F.col("doc_id"))
    out = named.filter("node IS NOT NULL").join(ids, "node").withColumn("component_id", F.coalesce("component_id", "doc_id")).unionByName(alone)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "node")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that lead their component, with all columns. Rows that repeat an id stay or go together, and texts without words stay.

    A row with a null id goes by its text: it stays unless that is linked to a text with an id.
    """
    judged = saved(_near_components(docs, id_col, text_col, words, percent).select("doc_id", "kept", "node"))
    kept = judged.filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    named = docs.join(kept, docs[id_col] == kept["_id"], "left_semi")
    rows = packed(docs.filter(F.col(id_col).isNull()), text=F.col(text_col).cast("string"))
    rows = rows.mapInArrow(_with_nodes(words), StructType([rows.schema["row"], StructField("node", BinaryType())]))
    gone = judged.filter("NOT kept AND doc_id IS NULL").select("node").distinct()
    return named.unionByName(rows.join(gone, "node", "left_anti").select("row.*"))
