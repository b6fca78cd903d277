"""Byte-pair encoding and decoding of whole texts with a published vocabulary file.

A word's parts and the ranks of adjacent parts lie in two short rows. The smallest rank is
looked for again and again, its boundary deleted, and the ranks of the two neighbours looked up
anew; the rows of many words are worked through side by side as arrays. Words of more than
``SHORT`` bytes, where that would be quadratic, take the same merges from a heap. Texts are first
cut before spaces that a non-space follows, where words end under every rule of the pattern. Of a slice of
texts each distinct piece is encoded once, unless it is remembered; the ids of all pieces are then
gathered by array indexing, and bytes are gathered from ids likewise.

Row-local: no shuffle. The vocabulary file is read on the driver and broadcast (two megabytes).
"""

from __future__ import annotations

import heapq
import json
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm.frames import exact_ids, gathered, importable, run_hashes, slices, utf8

#: How byte-level vocabularies of this family split a text into words (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of a word that is merged in a row; pieces remembered in each of two generations, and the bytes of a piece that is; cells of a block of rows.
SHORT, KNOWN, LONGEST, CELLS = 256, 1 << 18, 64, 1 << 20
_NONE = 1 << 60
# Bytes that no white space begins with, in any of the rules' sense: not those of ASCII, and no first byte of a longer one (fixed values).
_NO_SPACE = np.ones(256, bool)
_NO_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = False


def byte_chars() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself if printable, else one above 255, in order."""
    out, more = [], 256
    for b in range(256):
        plain = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
        out.append(chr(b if plain else more))
        more += not plain
    return out


class Tokenizer:
    """A vocabulary with its merges. ``special`` texts become their own ids wherever they stand."""

    def __init__(self, vocab: dict[str, int], merges: list, special: dict[str, int], pattern: str = PATTERN):
        import regex

        to_byte = {c: b for b, c in enumerate(byte_chars())}
        as_bytes = lambda token: bytes(to_byte[c] for c in token)
        self.bytes = {i: as_bytes(t) for t, i in vocab.items()} | {i: t.encode() for t, i in special.items()}
        self.first = [vocab[c] for c in byte_chars()]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for n, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a] << 32 | vocab[b]] = n
            self.merged.append(vocab[a + b])
        self.special = special
        self.cut = re.compile(b"|".join(re.escape(s.encode()) for s in sorted(special, key=len, reverse=True))) if special else None
        self.words = regex.compile(pattern)
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        pairs = np.array(list(self.rank), np.int64)
        order = np.argsort(pairs)
        self._pairs, self._ranks = pairs[order], np.arange(len(pairs))[order]
        self._merged, self._first = np.array(self.merged, np.int64), np.array(self.first, np.int64)
        longest = max(self.bytes, default=-1) + 1
        self._length = np.full(longest, -1, np.int64)  # of the bytes of an id
        for i, x in self.bytes.items():
            self._length[i] = len(x)
        self._start = np.cumsum(np.maximum(self._length, 0)) - np.maximum(self._length, 0)
        self._bytes = np.frombuffer(b"".join(self.bytes.get(i, b"") for i in range(longest)), np.uint8)

    @classmethod
    def from_json(cls, text: str) -> Tokenizer:
        j = json.loads(text)
        return cls(j["model"]["vocab"], j["model"]["merges"], {t["content"]: t["id"] for t in j["added_tokens"]})

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids; ``_NONE`` where they don't merge."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
        return np.where(self._pairs[at] == key, self._ranks[at], _NONE) if len(self._pairs) else np.full(key.shape, _NONE)

    def words_ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of each (distinct, not empty) word as little-endian unsigned 32-bit integers."""
        out = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        i = 0
        while i < len(order):
            j = i
            while j < len(order) and len(words[order[j]]) <= SHORT and (j + 1 - i) * len(words[order[j]]) <= CELLS:
                j += 1
            if j == i:
                found = self._long([self.first[b] for b in words[order[i]]])
                out[order[i]] = np.array(found, "<u4").tobytes()
                j = i + 1
            else:
                some = order[i:j]
                ids, n = self._rows([words[k] for k in some])
                raw, width = ids.astype("<u4").tobytes(), 4 * ids.shape[1]
                for row, (k, m) in enumerate(zip(some, n.tolist(), strict=True)):
                    out[k] = raw[row * width : row * width + 4 * m]
            i = j
        return out

    def _rows(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Parts of short words, a row each, and how many they are, after all merges."""
        n = np.array([len(w) for w in words], np.int64)
        width = int(n.max())
        cols = np.arange(width)
        done = np.full((len(words), width), -1, np.int64)
        inside = cols < n[:, None]
        done[inside] = self._first[np.frombuffer(b"".join(words), np.uint8)]
        row, ids = np.arange(len(words)), done.copy()
        ranks = np.full((len(words), width), _NONE)  # of a part with the next
        pair = np.flatnonzero((cols < n[:, None] - 1).ravel())
        flat = ids.ravel()
        ranks.ravel()[pair] = self._rank_of(flat[pair], flat[pair + 1])
        while True:
            low = ranks.argmin(axis=1)
            least = ranks[np.arange(len(row)), low]
            going = least < _NONE
            if not going.all():
                done[row[~going]] = ids[~going]
                row, ids, ranks, low, least = row[going], ids[going], ranks[going], low[going], least[going]
                if not len(row):
                    return done, n
            at = np.arange(len(row))
            ids[at, low] = self._merged[least]
            # the boundary behind the part goes, and with it the merged pair's rank
            ids = np.take_along_axis(ids, np.minimum(cols + (cols > low[:, None]), width - 1), 1)
            ranks = np.take_along_axis(ranks, np.minimum(cols + (cols >= low[:, None]), width - 1), 1)
            n[row] -= 1
            ids[:, -1], ranks[:, -1] = -1, _NONE
            left, right = np.flatnonzero(low > 0), np.flatnonzero(low < n[row] - 1)
            ranks[left, low[left] - 1] = self._rank_of(ids[left, low[left] - 1], ids[left, low[left]])
            ranks[at, low] = _NONE
            ranks[right, low[right]] = self._rank_of(ids[right, low[right]], ids[right, low[right] + 1])

    def _long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (r := get(a << 32 | b, _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.merged[r], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (q := get(ids[x] << 32 | ids[after[x]], _NONE)) != _NONE:
                    heapq.heappush(heap, (q, x, ids[x], ids[after[x]]))
        return [x for x in ids if x >= 0]

    def _starts(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where pieces begin: texts, special texts and what follows them, and spaces before what is surely no space."""
        cut = np.zeros(len(raw) + 1, bool)
        cut[:-2] = (raw[:-1] == 32) & _NO_SPACE[raw[1:]]
        last = at[1:][at[1:] > at[:-1]] - 1
        cut[last] = False  # what follows is another text
        if self.cut:
            blob = raw.tobytes()
            for special in self.special:
                i = blob.find(special.encode())
                while i >= 0:
                    d = int(np.searchsorted(at, i, "right")) - 1
                    before = int(at[d])
                    for m in self.cut.finditer(blob, before, int(at[d + 1])):
                        if m.start() - 1 > before:
                            cut[m.start() - 1] = False  # white space at the end of a part stays together
                        cut[m.start()] = cut[m.end()] = True
                        cut[m.start() + 1 : m.end()] = False
                        before = m.end()
                    i = blob.find(special.encode(), int(at[d + 1]))
        cut[at] = True
        return np.flatnonzero(cut[:-1])

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin (one more for the end)."""
        raw, at = utf8(texts)
        starts = self._starts(raw, at)
        ends = np.append(starts[1:], len(raw))[: len(starts)]
        ids, where = exact_ids(raw, starts, ends, run_hashes(raw, starts, ends))
        blob = raw.tobytes()
        pieces = [blob[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
        if len(self.new) + len(pieces) > KNOWN:
            self.old, self.new = self.new, {}
        missing = [p for p in pieces if p not in self.new]
        self.new.update([(p, self.old[p]) for p in missing if p in self.old])
        missing = [p for p in missing if p not in self.new]
        special = {s.encode(): np.array([i], "<u4").tobytes() for s, i in self.special.items()}
        split = [[p] if p in special else [w.encode() for w in self.words.findall(p.decode())] for p in missing]
        words = list(set().union(*split).difference(special))
        known = dict(zip(words, self.words_ids(words), strict=True)) | special
        self.new.update((p, b"".join(map(known.__getitem__, ws))) for p, ws in zip(missing, split, strict=True))
        found = [self.new[p] for p in pieces]
        for p in missing:
            if len(p) > LONGEST:
                del self.new[p]
        sizes = np.array([len(x) for x in found], np.int64) // 4
        each = sizes[ids]
        out = gathered(np.frombuffer(b"".join(found), "<u4"), (np.cumsum(sizes) - sizes)[ids], each)
        return out, np.concatenate([[0], np.cumsum(each)])[np.searchsorted(starts, at)]

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return self.encode_all(pa.array([text], pa.string()))[0].astype("<u4").tobytes()

    def decode_all(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The texts of runs of ids (each begins at its entry of ``at``, one more for the end)."""
        if len(ids) and (int(ids.max()) >= len(self._length) or (self._length[ids] < 0).any()):
            raise ValueError("an id that the vocabulary doesn't have")
        lengths = self._length[ids]
        raw = gathered(self._bytes, self._start[ids], lengths)
        return _texts(raw, np.concatenate([[0], np.cumsum(lengths)])[at])

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_all(np.asarray(ids, np.int64), np.array([0, len(ids)]))[0].as_py()


def _texts(raw: np.ndarray, at: np.ndarray) -> pa.Array:
    """Runs of bytes as texts; what isn't UTF-8 is replaced."""
    binary = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)])
    try:
        return binary.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in binary.to_pylist()], pa.string())


_loaded: dict[int, Tokenizer] = {}


def _tokenizer(shared) -> Tokenizer:
    """This worker's tokenizer, made once from the broadcast file."""
    text = shared.value
    key = hash(text)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Tokenizer.from_json(text)
    return _loaded[key]


def load(spark: SparkSession, path: str):
    """The vocabulary file, for ``encode`` and ``decode``."""
    importable(spark)
    return spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))


def encode(docs: DataFrame, vocabulary, text_col: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with a column ``out``: the ids of the whole text as little-endian unsigned 32-bit integers. A null text counts as empty.

    ``decoded`` names a further column, the text that the ids stand for: as ``decode``, but slice by slice in the same
    pass, so that a task needs one Python worker with the vocabulary and not two.
    Both replace columns of those names; all other columns stay as they are.
    """
    from pyspark.sql.types import BinaryType, StringType, StructType

    more = [] if decoded is None else [decoded]
    rows = docs.drop(out, *more).withColumn(text_col, F.col(text_col).cast("string"))
    schema = StructType([*rows.schema.fields]).add(out, BinaryType())
    for name in more:
        schema = schema.add(name, StringType())

    def work(batches):
        t = _tokenizer(vocabulary)
        for batch in batches:
            for part in slices(batch, text_col):
                ids, at = t.encode_all(part.column(text_col))
                raw = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                texts = [t.decode_all(ids.astype(np.int64), at) for _ in more]
                yield pa.RecordBatch.from_arrays([*part.columns, raw, *texts], [*part.schema.names, out, *more])

    return rows.mapInArrow(work, schema)


def decode(rows: DataFrame, vocabulary, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with a column ``out``: the text that the ids stand for. Null ids count as none."""
    from pyspark.sql.types import StringType, StructType

    rows = rows.drop(out)
    schema = StructType([*rows.schema.fields]).add(out, StringType())

    def work(batches):
        t = _tokenizer(vocabulary)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                raw, at = utf8(part.column(ids_col))
                texts = t.decode_all(np.frombuffer(raw.tobytes(), "<u4").astype(np.int64), at // 4)
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*part.schema.names, out])

    return rows.mapInArrow(work, schema)
