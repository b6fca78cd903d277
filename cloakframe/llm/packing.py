"""Best-fit packing of documents' tokens into sequences of equal capacity, planned from a histogram of lengths.

1. Each document becomes its token ids and an end id; only what is longer than a sequence is cut.
2. Pieces are counted by length: a table of at most ``most`` rows, and all that the driver sees.
3. ``plan`` does best-fit decreasing over these counts. Sequences with the same free space form
   runs of consecutive numbers, so a step places many pieces at once and the plan's size
   depends on ``most``, not on the number of documents.
4. Pieces are numbered within their length and take the planned slots by a join on that rank.
   A hot length is numbered by ranges of a hash (``running_total``), never in one task.

Results. Documents whose text is null or empty are the end id alone. Repeated rows are packed one
by one; a null id stays null. Extra columns are not carried. An empty table gives no rows. Texts of
any length are encoded whole.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from operator import itemgetter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructType

from cloakframe.llm.frames import exact_ids, gathered, importable, run_hashes, running_total, saved, slices, utf8

#: Words remembered in each of two generations, the bytes of a word that is remembered, and the ranges that a length is numbered by.
KNOWN, LONGEST, RANGES = 1 << 19, 64, 4096


def load(spark: SparkSession, path: str):
    """The tokenizer file, broadcast (two megabytes)."""
    importable(spark)
    return spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))


# Kinds of bytes: 0 ASCII white space, 1 letters, 2 digits, 3 the apostrophe and 4 other printable ASCII; 5 all else, beside which no word is cut.
_KIND = np.full(256, 5, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[0x21:0x7F], _KIND[0x30:0x3A], _KIND[0x27] = 4, 2, 3
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 1
#: The rules under which words are cut further: no part of a word then reaches over a cut, and capitals count as small letters.
_RULES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
# By the kinds before and behind it, where a word is cut; a contraction begins with the apostrophe.
_CUTS = np.zeros((6, 6), bool)
_CUTS[1, 2:5] = _CUTS[2, 1:5] = _CUTS[3:5, 2] = _CUTS[4, 1] = True
_SPACES = np.zeros((6, 6), bool)
_SPACES[0, 1:] = _SPACES[1:, 0] = True


class Words:
    """The ids of words that end at ASCII white space, which the vocabulary drops: each is encoded once while it is remembered.

    Where the vocabulary's rules are ``_RULES``, words are cut where letters, digits and marks meet in ASCII and their
    capitals folded, so that a word before a comma, or at the beginning of a sentence, is the word that was encoded before.
    """

    def __init__(self, json_text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json_text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        rules = json.loads(json_text)
        self.added = [t["content"].encode() for t in rules["added_tokens"]]
        steps = [(n["type"], n.get("content")) for n in (rules["normalizer"] or {}).get("normalizers", [])]
        split, *then = (rules["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        as_is = not any(t[k] for t in rules["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")) and not any(a.isalpha() for a in self.added)
        bytewise = [(p["type"], p.get("add_prefix_space"), p.get("use_regex")) for p in then] == [("ByteLevel", False, False)]
        self.cuts = as_is and bytewise and steps == [("NFC", None), ("Replace", " "), ("Lowercase", None)] and split.get("pattern") == {"Regex": _RULES}

    def encode(self, words: list[bytes], step: int = 512) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers.

        Small letters of ASCII only, which the rules leave as they are, go to the vocabulary's model; of the others many
        are encoded as one text and told apart by offsets.
        """
        plain = [self.cuts and w.isalpha() and w.islower() for w in words]
        some = self._encode([w for w, p in zip(words, plain, strict=True) if not p], step)
        small = self._letters([w for w, p in zip(words, plain, strict=True) if p], 8 * step)
        return [next(small) if p else next(some) for p in plain]

    def _letters(self, words: list[bytes], step: int) -> Iterator[bytes]:
        tokenize = self.tokenizer.model.tokenize
        for i in range(0, len(words), step):
            tokens = [tokenize(w.decode()) for w in words[i : i + step]]
            raw, a = np.array([t.id for ts in tokens for t in ts], "<u4").tobytes(), 0
            for ts in tokens:
                yield raw[a : a + 4 * len(ts)]
                a += 4 * len(ts)

    def _encode(self, words: list[bytes], step: int) -> Iterator[bytes]:
        for i in range(0, len(words), 8 * step):
            some = [[w.decode("utf-8", "replace") for w in words[j : j + step]] for j in range(i, min(i + 8 * step, len(words)), step)]
            for line, e in zip(some, self.tokenizer.encode_batch([" ".join(t) for t in some], add_special_tokens=False), strict=True):
                at = np.zeros(len(line) + 1, np.int64)
                np.cumsum(np.fromiter(map(len, line), np.int64, len(line)) + 1, out=at[1:])
                cut = (4 * np.searchsorted(np.fromiter(map(itemgetter(0), e.offsets), np.int64, len(e)), at)).tolist()
                raw = np.array(e.ids, "<u4").tobytes()
                yield from (raw[a:b] for a, b in zip(cut, cut[1:], strict=False))

    def pieces(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all texts, folded if the rules allow it, and where pieces of words begin and end."""
        kind = np.frombuffer(raw.tobytes().translate(_KIND.tobytes()), np.uint8)
        pairs = (_SPACES | _CUTS if self.cuts else _SPACES).tobytes().ljust(256, b"\0")
        edge = np.ones(len(raw) + 1, bool)  # before a byte: a piece or white space begins there
        edge[1:-1] = np.frombuffer((6 * kind[:-1] + kind[1:]).tobytes().translate(pairs), bool)
        if self.cuts and len(raw):
            alone = np.append(raw[1:] < 0x80, True)  # no mark may follow that would make one letter of both
            folded = np.where((raw >= 0x41) & (raw <= 0x5A) & alone, raw | 0x20, raw)
            blob = folded.tobytes()
            for added in self.added:  # stands for itself as it is written
                i = blob.find(added)
                while i >= 0:
                    j = i + len(added)
                    folded[i:j] = raw[i:j]
                    edge[i + 1 : j] = False
                    i = blob.find(added, i + 1)
            raw = folded
        edge[at] = True
        edges = np.flatnonzero(edge)
        keep = kind[edges[:-1]] > 0
        return raw, edges[:-1][keep], edges[1:][keep]

    def ids_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin (one more for the end)."""
        raw, at = utf8(texts)
        raw, first, end = self.pieces(raw, at)
        ids, where = exact_ids(raw, first, end, run_hashes(raw, first, end))
        blob = raw.tobytes()
        words = [blob[a:b] for a, b in zip(first[where].tolist(), end[where].tolist(), strict=True)]
        if len(self.new) + len(words) > KNOWN:
            self.old, self.new = self.new, {}
        missing = [w for w in words if w not in self.new]
        self.new.update([(w, self.old[w]) for w in missing if w in self.old])
        missing = [w for w in missing if w not in self.new]
        self.new.update(zip(missing, self.encode(missing), strict=True))
        found = list(map(self.new.__getitem__, words))
        for w in missing:
            if len(w) > LONGEST:
                del self.new[w]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool = np.frombuffer(b"".join(found), "<u4")
        each = sizes[ids]
        return gathered(pool, (np.cumsum(sizes) - sizes)[ids], each), np.concatenate([[0], np.cumsum(each)])[np.searchsorted(first, at)]


_words: dict[int, Words] = {}


def _loaded(shared) -> Words:
    key = hash(shared.value)
    if key not in _words:
        _words.clear()
        _words[key] = Words(shared.value)
    return _words[key]


def pieces(docs: DataFrame, vocabulary, most: int = 2048, end: int = 0, ids: bool = True) -> DataFrame:
    """doc_id, piece (from 0), start, length, ids_crc32 and, if asked for, ids: of every document its ids and ``end``, in pieces of ``most`` ids.

    Row-local: no shuffle.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    schema = StructType([rows.schema["doc_id"]]).add("piece", IntegerType()).add("start", LongType()).add("length", LongType()).add("ids_crc32", LongType())
    schema = schema.add("ids", BinaryType()) if ids else schema
    stop = int(end).to_bytes(4, "little")

    def work(batches):
        words = _loaded(vocabulary)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                of, piece, start, length, crc, parts = [], [], [], [], [], []
                all_ids, at = words.ids_of(part.column("text"))
                for row, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist(), strict=False)):
                    whole = all_ids[a:b].tobytes() + stop
                    for p in range(0, len(whole), 4 * most):
                        cut = whole[p : p + 4 * most]
                        of.append(row)
                        piece.append(p // (4 * most))
                        start.append(p // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                        if ids:
                            parts.append(cut)
                columns = [part.column("doc_id").take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(parts, pa.binary())] * ids, schema.names)

    return rows.mapInArrow(work, schema)


def plan(counts: dict[int, int], most: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths: rows (length, rank, until, each, sequence, offset).

    The pieces of that length whose rank is in [rank, until) go ``each`` by each into consecutive
    sequences from ``sequence`` on, side by side from ``offset`` on. As best fit does, a sequence
    takes further pieces of one length until they no longer fit, since it is then the fullest.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # free space: runs of sequences (first, how many)
    spaces: list[int] = []  # the free spaces in use, ascending
    rows, used = [], 0

    def add(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in runs:
                runs[space] = []
                insort(spaces, space)
            runs[space].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            i = bisect_left(spaces, length)
            if i < len(spaces):
                space = spaces[i]
                first, n = runs[space].pop()
                if not runs[space]:
                    del runs[space], spaces[i]
            else:
                space, first, n = most, used, -(-left // (most // length))
                used += n
            each = min(space // length, left)
            n_now = min(n, left // each)
            rows.append((length, rank, rank + each * n_now, each, first, most - space))
            add(space, first + n_now, n - n_now)
            add(space - each * length, first, n_now)
            rank, left = rank + each * n_now, left - each * n_now
    return rows


def pack(cut: DataFrame, most: int = 2048) -> DataFrame:
    """Rows of ``pieces`` (saved, since they are read twice) with sequence_id and offset: their place, gapless from 0 in each sequence."""
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    spark = cut.sparkSession
    slots = spark.createDataFrame(plan(counts, most), "_length long, _rank long, _until long, _each long, _sequence long, _offset long")
    ranges = cut.withColumn("_range", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(RANGES)))
    ranked = running_total(ranges, ["length"], "_range", [F.col("doc_id"), F.col("start"), F.col("ids_crc32")], F.lit(1), "_at")
    ranked = ranked.withColumn("_at", F.col("_at") - 1)
    place = (F.col("length") == F.col("_length")) & (F.col("_at") >= F.col("_rank")) & (F.col("_at") < F.col("_until"))
    k = F.col("_at") - F.col("_rank")
    sequence = F.col("_sequence") + F.floor(k / F.col("_each")).cast("long")
    offset = F.col("_offset") + k % F.col("_each") * F.col("length")
    return ranked.join(slots, place).select(*cut.columns, sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def packed_pieces(docs: DataFrame, vocabulary, most: int = 2048, end: int = 0, ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (if asked for), sequence_id, offset: every piece of every document in its place."""
    return pack(saved(pieces(docs, vocabulary, most, end, ids)), most)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_ids and ids of each sequence. A sequence has at most as many pieces as it holds ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), whole.alias("ids"))
