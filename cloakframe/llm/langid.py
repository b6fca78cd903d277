"""Language identification by cross-parsing entropy.

Of labelled text of each language a suffix automaton is built (every substring is a path from its
start). A text is parsed greedily into the longest matches with each automaton; the number of
phrases times log2 of the labelled text's length, per letter, estimates the cross entropy, and
the language with the least wins. Every letter of the labelled text is a symbol; a letter outside
an automaton's own alphabet is a phrase there. An automaton's most frequent letters index a table of
transitions, the others are looked up among sorted (state, letter) keys, so that scripts of
thousands of letters fit.

Fitting uses a bounded sample (the ``LANGUAGES`` most frequent languages, ``rows`` texts of each in
the order of a hash of their id, and ``symbols`` letters of them); prediction reads all of every text. Texts are cut into segments of
``SEGMENT`` symbols at which a phrase ends in every language, and all segments of a batch walk the
automata in step: one array operation advances thousands of segments.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm.frames import importable, saved, utf8

SEGMENT = 512
#: Of a language at most so many texts and letters are learned, of all languages together so many letters.
ROWS, SYMBOLS, ALL_SYMBOLS = 64, 1 << 16, 1 << 24
#: Entries of the tables of all automata; what is beyond is looked up by key.
CELLS = 1 << 26


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that nothing is learned from: crc32 of the id as text is divisible by 5 (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


# -- fitting -------------------------------------------------------------------------------
def letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it isn't a letter."""
    out = np.zeros(0x110000, np.int32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def symbols_of(text: str, table: np.ndarray) -> np.ndarray:
    """The text's letters through ``table``, with one 0 for every run of other characters."""
    s = table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = s != 0
    keep[1:] |= s[:-1] != 0
    return s[keep]


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """The transitions of each state; state 0 is the start."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p != -1:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nexts[p].get(c) == q:
                    nexts[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return nexts


class Walk:
    """An automaton's transitions, for arrays of states.

    ``code`` gives the automaton's own number of each symbol, more frequent letters first. States are
    held times ``width``, the columns of ``table``; its last column is for all numbers from ``width - 1``,
    which are looked up in ``keys`` (state * letters + number, sorted). An entry is the next state; or, if
    a phrase ends before the symbol, ~ of where the next one goes on.
    """

    def __init__(self, states: int, edges: np.ndarray, size: int, cells: int):
        used = np.bincount(edges[:, 1], minlength=size)
        own = np.argsort(-used, kind="stable")[: int((used > 0).sum())]
        self.letters = len(own) + 1  # the last: letters that this automaton doesn't have
        self.code = np.full(size, len(own), np.int32)
        self.code[own] = np.arange(len(own), dtype=np.int32)
        # one state more, where a symbol that was never learned leads: a phrase of its own, so the next one ends it
        self.width = width = max(1, min(self.letters, cells // (states + 1)))
        self.begin = states * width
        s, c, t = edges[:, 0], self.code[edges[:, 1]], edges[:, 2] * width
        first = np.full(self.letters, self.begin, np.int32)  # where a phrase that begins with the symbol goes on
        first[c[s == 0]] = t[s == 0]
        self.ends = ~first
        dense = c < width - 1
        table = np.full((states + 1, width), -1, np.int32)
        table[s[dense], c[dense]] = t[dense]
        self.table = np.where(table >= 0, table, self.ends[None, :width]).ravel()
        key = s[~dense].astype(np.int64) * self.letters + c[~dense]
        order = np.argsort(key)
        self.keys, self.nexts = np.append(key[order], np.iinfo(np.int64).max), np.append(t[~dense][order], 0).astype(np.int32)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        out = self.table[state + np.minimum(code, self.width - 1)]
        if len(self.keys) > 1:
            rare = np.flatnonzero(code >= self.width - 1)
            if len(rare):
                c = code[rare]
                key = (state[rare] // self.width).astype(np.int64) * self.letters + c
                at = np.searchsorted(self.keys, key)
                out[rare] = np.where(self.keys[at] == key, self.nexts[at], self.ends[c])
        return out


class Model:
    """Languages in order, the symbol of each code point, and the transitions of each automaton as (state, symbol, state)."""

    def __init__(self, texts: dict[str, list[str]], symbols: int = SYMBOLS):
        low = letters()
        read: dict[str, np.ndarray] = {}
        for lang in sorted(texts):
            each = max(1, symbols // max(1, len(texts[lang])))
            parts = [symbols_of(t, low) for t in texts[lang]]
            short = sum(min(len(p), each) for p in parts)
            longer = max(1, sum(len(p) > each for p in parts))
            each += (symbols - short) // longer if short < symbols else 0
            read[lang] = np.concatenate([np.zeros(1, np.int32), *[np.append(p[:each], 0) for p in parts]])[: symbols + len(parts)]
        known = np.unique(np.concatenate([np.zeros(1, np.int32), *read.values()]))[1:]
        self.languages = sorted(texts)
        self.size = len(known) + 2  # 0: no letter; the last: letters not learned
        kind = np.min_scalar_type(self.size - 1)
        code = np.full(0x110000, self.size - 1, kind)
        code[known] = np.arange(1, len(known) + 1, dtype=kind)
        self.table = np.where(low > 0, code[low], kind.type(0))
        self.lengths, self.edges = [], []
        for lang in self.languages:
            text = code[read[lang]]
            text[read[lang] == 0] = 0
            self.lengths.append(len(text))
            nexts = suffix_automaton(text.tolist())
            self.edges.append((len(nexts), np.array([(s, c, t) for s, out in enumerate(nexts) for c, t in out.items()], np.int32).reshape(-1, 3)))

    def walks(self, cells: int = CELLS) -> list[Walk]:
        """Each automaton's transitions, in tables of ``cells`` entries together (one column each at least)."""
        each = cells // max(1, len(self.edges))
        return [Walk(states, edges, self.size, each) for states, edges in self.edges]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS, symbols: int = SYMBOLS) -> Model:
    """A model of the labelled rows of ``docs`` that hold a letter.

    At most ``rows`` texts and ``symbols`` letters of a language are learned, fewer letters where more than 256
    languages share ``ALL_SYMBOLS``. Texts are cut in Spark to eight times their share, so at most
    2^27 characters reach the driver. Every language is learned, however many there are.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    known = known.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = known.select("id", "lang").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= rows).select("id", "lang").distinct()
    chosen = chosen.withColumn("texts", F.count("*").over(Window.partitionBy("lang")))
    chosen = saved(chosen)
    languages = chosen.select("lang").distinct().count()
    symbols = max(1, min(symbols, ALL_SYMBOLS // max(1, languages)))
    few = F.broadcast(chosen) if languages * rows <= 1 << 16 else chosen  # ids and languages: a few megabytes at most
    same = known["id"].eqNullSafe(few["id"]) & (known["lang"] == few["lang"])
    sample = known.join(few, same).select(known["lang"], F.expr(f"substring(text, 1, greatest(1, {8 * symbols} DIV texts))").alias("text"))
    sample = sample.orderBy("lang", F.xxhash64("text"))
    texts: dict[str, list[str]] = {}
    for r in sample.collect():
        texts.setdefault(r["lang"], []).append(r["text"])
    return Model({lang: t[:rows] for lang, t in texts.items()}, symbols)


# -- prediction ----------------------------------------------------------------------------
def phrases(pieces: list[np.ndarray], walks: list[Walk], width: int) -> np.ndarray:
    """For each text's symbols and each automaton, the number of phrases; there are ``width`` symbols."""
    of, rows = [], []
    for i, s in enumerate(pieces):
        for a in range(0, len(s), SEGMENT):
            of.append(i)
            rows.append(s[a : a + SEGMENT])
    counts = np.zeros((len(pieces), len(walks)), np.int64)
    if not rows:
        return counts
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    order = np.argsort(-sizes, kind="stable")
    of, sizes = np.array(of)[order], sizes[order]
    grid = np.zeros((int(sizes[0]), len(rows)), np.min_scalar_type(width - 1))
    for k, r in enumerate(order):
        grid[: sizes[k], k] = rows[r]
    active = len(rows) - np.searchsorted(sizes[::-1], np.arange(int(sizes[0])), "right")
    for w, walk in enumerate(walks):
        # from the state in which every symbol begins a phrase
        state, ended = np.full(len(rows), walk.begin, np.int32), np.zeros(len(rows), np.int32)
        for j, n in enumerate(active.tolist()):
            v = walk.step(state[:n], walk.code[grid[j, :n]])
            sign = v >> 31
            ended[:n] -= sign
            state[:n] = v ^ sign
        counts[:, w] = np.bincount(of, weights=ended, minlength=len(pieces))
    return counts


_ready: dict[str, tuple] = {}


def _model(shared) -> tuple[Model, list[Walk]]:
    if shared.id not in _ready:
        _ready.clear()
        _ready[shared.id] = (shared.value, shared.value.walks())
    return _ready[shared.id]


class _Shared:
    def __init__(self, spark, value):
        self.broadcast = spark.sparkContext.broadcast(value)
        self.id = uuid.uuid4().hex

    @property
    def value(self):
        return self.broadcast.value


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, ``lang_pred``, ``score``.

    ``und`` with score 0 for texts that are null or have no letter, and for all if no language was
    learned. Of equal entropies the smaller language name wins. The score is the winner's share of
    2 ** -(bits) over all languages.
    """
    spark = docs.sparkSession
    importable(spark)
    shared = _Shared(spark, model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, walks = _model(shared)
        bits = np.array([math.log2(max(n, 2)) for n in m.lengths])
        for batch in batches:
            at = utf8(batch.column("text"))[1]
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(at, at[a] + (4 << 20), "right")) - 1)
                part = batch.slice(a, b - a)
                a = b
                pieces = [symbols_of(t, m.table) if t else np.zeros(0, m.table.dtype) for t in part.column("text").to_pylist()]
                said, score = ["und"] * len(pieces), np.zeros(len(pieces))
                if walks:
                    cost = phrases(pieces, walks, m.size) * bits
                    best = cost.argmin(1)
                    share = 1 / np.exp2(-np.minimum(cost - cost.min(1)[:, None], 1000)).sum(1)
                    some = np.fromiter((bool(p.any()) for p in pieces), bool, len(pieces))
                    said = [m.languages[k] if ok else "und" for k, ok in zip(best, some, strict=True)]
                    score = np.where(some, share, 0.0)
                yield pa.record_batch([part.column("id"), pa.array(said, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    return rows.mapInArrow(work, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
