"""Phrase collocations of a corpus, counted in weighted acyclic automata.

A word is a label; a phrase is a path; its weight is its count. ``Automaton`` is built from sorted
phrases one by one, and equal tails are shared as they are completed. A path's number in sorted
order is the sum of the path counts that it passes by, and indexes the weights.

1. Upper bounds. Phrases of 1, 2 and 3 words are counted by 64-bit hash. A phrase occurs no more
   often than its parts, so only occurrences whose parts reach ``least`` are counted. The hashes that
   reach it become a bitmap of fixed size (``BITS``); a clash lets a phrase through, never out.
2. Shards. Each task counts the phrases that are let through exactly, by word ids that are
   compared with their words, and builds an automaton for each prefix range. (Ranges are of the
   hash of language and first two words, so a frequent first word is spread over all of them.)
3. Union. The automata of a range are merged in sorted order and their weights summed, first in
   salted groups, then whole; phrases below ``least`` fall away.
4. Parts. Each range asks every other for the parts of its phrases, as automata of distinct parts.
   The asked range composes them with its counts and sends back a transducer. So a part that
   everything asks for travels once a range.
5. Inside longer phrases, and the first ``most`` of each language: joins and a ranked window.

Results. Counts are over all documents; repeated rows count as often as they occur. A null text is
empty, a null language ``und``. Texts of any length are read whole. An empty table, and languages
without a candidate, give no rows. Other columns aren't read.
"""

from __future__ import annotations

import heapq
import itertools
import pickle
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakframe.llm.frames import exact_ids, importable, mixed, saved, slices, utf8, word_hashes

#: Words of the longest phrase, bits of a bitmap's size, prefix ranges of a language, salted groups of a range, rows that a task counts before it sends them on.
WORDS, BITS, RANGES, SALTS, PENDING = 4, 26, 64, 8, 1 << 21
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[*b".,;:!?\x0b\x0c\x0d"]] = 10  # pieces end here
_LOWER[9] = 32
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
Phrase = tuple[bytes, ...]


# -- automata ----------------------------------------------------------------------------------
class Automaton:
    """A weighted acyclic automaton of phrases. ``states[i]`` is (final, ((label, target), ...)); the last state is the start."""

    def __init__(self, states: list, weights: list[int]):
        self.states, self.weights = states, weights
        self.paths: list[int] = []
        for final, arcs in states:
            self.paths.append(final + sum(self.paths[t] for _, t in arcs))

    @classmethod
    def build(cls, sorted_phrases: Iterable[tuple[Phrase, int]]) -> Automaton:
        """From distinct phrases in sorted order: what can no longer change is frozen and shared."""
        states, register, weights = [], {}, []
        open_: list[list] = [[False, []]]  # the states along the last phrase
        last: Phrase = ()

        def freeze(depth: int) -> None:
            while len(open_) > depth + 1:
                final, arcs = open_.pop()
                key = (final, tuple(arcs))
                target = register.get(key)
                if target is None:
                    target = register[key] = len(states)
                    states.append(key)
                open_[-1][1].append((last[len(open_) - 1], target))

        for phrase, weight in sorted_phrases:
            common = 0
            for a, b in zip(last, phrase, strict=False):
                if a != b:
                    break
                common += 1
            freeze(common)
            open_ += [[False, []] for _ in phrase[common:]]
            open_[-1][0] = True
            weights.append(weight)
            last = phrase
        freeze(0)
        states.append((open_[0][0], tuple(open_[0][1])))
        return cls(states, weights)

    def __iter__(self) -> Iterator[tuple[Phrase, int]]:
        """Phrases and weights in sorted order."""
        weights, states = iter(self.weights), self.states

        def walk(state: int, before: Phrase):
            final, arcs = states[state]
            if final:
                yield before, next(weights)
            for label, target in arcs:
                yield from walk(target, (*before, label))

        return walk(len(states) - 1, ())

    def compose(self, asked: Automaton) -> Automaton:
        """The phrases of ``asked`` that this one has, with this one's weights: both are walked together, arcs merged by label."""
        found: list[tuple[Phrase, int]] = []

        def walk(mine: int, theirs: int, number: int, before: Phrase) -> None:
            final, arcs = self.states[mine]
            final_asked, arcs_asked = asked.states[theirs]
            if final and final_asked:
                found.append((before, self.weights[number]))
            number += final
            want = dict(arcs_asked)
            for label, target in arcs:
                if label in want:
                    walk(target, want[label], number, (*before, label))
                number += self.paths[target]

        walk(len(self.states) - 1, len(asked.states) - 1, 0, ())
        return Automaton.build(found)

    def dumps(self) -> bytes:
        return pickle.dumps((self.states, self.weights), 5)

    @classmethod
    def loads(cls, raw: bytes) -> Automaton:
        return cls(*pickle.loads(raw))  # noqa: S301  # written by dumps in a task of the same job


def union(automata: Iterable[Automaton], least: int = 0) -> Automaton:
    """All phrases with their weights summed; those below ``least`` fall away."""
    merged = heapq.merge(*map(iter, automata))
    summed = ((p, sum(w for _, w in same)) for p, same in itertools.groupby(merged, key=lambda x: x[0]))
    return Automaton.build((p, w) for p, w in summed if w >= least)


def range_of(lang: str, phrase: Phrase, ranges: int) -> int:
    """The prefix range of a phrase: by its language and first two words. The empty phrase, whose weight is the number of words, lies in range 0."""
    return zlib.crc32(b" ".join((lang.encode(), *phrase[:2]))) * ranges >> 32 if phrase else 0


# -- words of a slice ------------------------------------------------------------------------------
class _Slice:
    """Of the words of some texts: hash (with the language), and whether each goes on the piece of the word before."""

    def __init__(self, part: pa.RecordBatch):
        raw, at = utf8(part.column("text"))
        self.raw = _LOWER[raw]
        h, self.first, self.end, of = word_hashes(self.raw, at, lower=False)
        self.doc = np.repeat(np.arange(len(at) - 1), np.diff(of))
        salt = part.column("salt").to_numpy(zero_copy_only=False).astype(np.uint64)
        self.hash = mixed(h + salt[self.doc] * _FACTOR)
        breaks = np.concatenate([[0], np.cumsum(self.raw == 10, dtype=np.int64)])
        self.goes_on = np.zeros(len(h), bool)
        self.goes_on[1:] = (self.doc[1:] == self.doc[:-1]) & (breaks[self.first[1:]] == breaks[self.end[:-1]])

    def levels(self, maps: list[np.ndarray], upto: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For phrases of 1 to ``upto`` words: where they begin, and their hashes; only those whose parts are in the bitmaps."""
        ok = np.ones(len(self.hash), bool)
        h = self.hash
        for k in range(1, upto + 1):
            if k > 1:
                ok = ok[:-1] & ok[1:] & self.goes_on[k - 1 :]
                h = mixed(h[:-1] * _FACTOR + self.hash[k - 1 :])
            at = np.flatnonzero(ok)
            yield at, h[at]
            if k <= len(maps):
                there = held(maps[k - 1], h[at])
                ok[at[~there]] = False

    def word_ids(self, used: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """Exact ids of the words at ``used`` in their languages ``lang``: those of equal hashes are compared byte by byte."""
        first, end = self.first[used], self.end[used]
        ids, where = exact_ids(self.raw, first, end, self.hash[used], lang)
        raw = self.raw.tobytes()
        return ids, [raw[a:b] for a, b in zip(first[where].tolist(), end[where].tolist(), strict=True)]


def held(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h >> np.uint64(64 - BITS)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _docs(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.xxhash64(lang).alias("salt"), F.col("text").cast("string").alias("text"))


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    return h[starts], np.add.reduceat(n, starts) if len(h) else n


def _bitmap(rows: DataFrame, k: int, maps: list, least: int) -> np.ndarray:
    """The bitmap of the hashes of phrases of ``k`` words that occur ``least`` times or more; at most 2^BITS bits reach the driver.

    Counts travel as arrays by range of the hash: 32 bits of it a phrase, and a count where that
    is not one. There are as many ranges as the session has shuffle partitions, or a few more.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(maps)
    bits = min(BITS - 3, max(6, int(spark.conf.get("spark.sql.shuffle.partitions")).bit_length()))

    def send(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        h = h >> np.uint64(32 - bits)
        at = np.searchsorted(h >> np.uint64(32), np.arange((1 << bits) + 1, dtype=np.uint64))
        low, once = h.astype(np.uint32), n == 1
        parts = [(r, low[a:b][once[a:b]].tobytes(), low[a:b][~once[a:b]].tobytes(), n[a:b][~once[a:b]].tobytes()) for r, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in parts], pa.binary() if i else pa.int32()) for i in range(4)], ["range", "once", "more", "n"])

    def work(batches):
        h, n = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                *_, (_, new) = _Slice(part).levels(shared.value, k)
                new, count = np.unique(new, return_counts=True)
                h, n = np.concatenate([h, new]), np.concatenate([n, count])
                if len(h) > PENDING:
                    h, n = _summed(h, n)
                    if 2 * len(h) > PENDING:
                        yield send(h, n)
                        h, n = h[:0], n[:0]
        yield send(*_summed(h, n))

    def often(table: pa.Table) -> pa.Table:
        once = np.frombuffer(b"".join(table.column("once").to_pylist()), np.uint32)
        more = np.frombuffer(b"".join(table.column("more").to_pylist()), np.uint32)
        n = np.frombuffer(b"".join(table.column("n").to_pylist()), np.int64)
        h, n = _summed(np.concatenate([once, more]), np.concatenate([np.ones(len(once), np.int64), n]))
        found = np.zeros(1 << BITS - bits, np.uint8)
        found[h[n >= least] >> np.uint32(32 - (BITS - bits))] = 1
        page = zlib.compress(np.packbits(found, bitorder="little").tobytes(), 1)
        return table.select(["range"]).slice(0, 1).append_column("page", pa.array([page], pa.binary()))

    counted = rows.mapInArrow(work, "range int, once binary, more binary, n binary")
    out = np.zeros(1 << BITS - 3, np.uint8)
    size = len(out) >> bits
    for r in counted.groupBy("range").applyInArrow(often, "range int, page binary").collect():
        out[r["range"] * size : (r["range"] + 1) * size] = np.frombuffer(zlib.decompress(bytes(r.page)), np.uint8)
    return out


def _shards(rows: DataFrame, maps: list) -> DataFrame:
    """lang, range, salt, automaton: of each task, the counts of the phrases that the bitmaps let through."""
    shared = rows.sparkSession.sparkContext.broadcast(maps)
    ranges, salts = RANGES, SALTS

    def flush(totals: dict):
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % salts
        out = []
        for lang, counts in totals.items():
            parts: dict[int, list] = {}
            for phrase, n in counts.items():
                parts.setdefault(range_of(lang, phrase, ranges), []).append((phrase, n))
            out += [(lang, r, salt, Automaton.build(sorted(p)).dumps()) for r, p in parts.items()]
        totals.clear()
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.binary()))], ["lang", "range", "salt", "automaton"])

    def work(batches):
        totals: dict[str, dict[Phrase, int]] = {}
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                count(part, totals)
                if sum(map(len, totals.values())) > PENDING:
                    yield flush(totals)
        yield flush(totals)

    def count(part: pa.RecordBatch, totals: dict) -> None:
        s = _Slice(part)
        langs, lang = np.unique(np.array(part.column("lang").to_pylist(), object), return_inverse=True)
        for name, words in zip(langs, np.bincount(lang[s.doc], minlength=len(langs)).tolist(), strict=True):
            mine = totals.setdefault(name, {})
            mine[()] = mine.get((), 0) + words
        there = [np.flatnonzero(held(shared.value[0], s.hash))]
        for k, (at, h) in enumerate(s.levels(shared.value, WORDS), 1):
            if k > 1:
                there.append(at[held(shared.value[k - 1], h)] if k <= len(shared.value) else at)
        ids, words = s.word_ids(there[0], lang[s.doc[there[0]]])
        word = np.full(len(s.hash), -1, np.int64)
        word[there[0]] = ids
        pair = np.full(len(s.hash), -1, np.int64)
        key = word
        for k, at in enumerate(there, 1):
            if k == 2:
                _, found = np.unique(word[at] << 32 | word[at + 1], return_inverse=True)
                pair[at] = found
                key = pair
            elif k == 3:
                key = np.full(len(s.hash), -1, np.int64)
                key[at] = pair[at] << 32 | word[at + 2]
            elif k == 4:
                key = np.full(len(s.hash), -1, np.int64)
                key[at] = pair[at] << 32 | pair[at + 2]
            _, where, n = np.unique(key[at], return_index=True, return_counts=True)
            first = at[where]
            spelt = [word[first + i].tolist() for i in range(k)]
            for name, phrase, times in zip(lang[s.doc[first]].tolist(), zip(*spelt, strict=True), n.tolist(), strict=True):
                mine = totals[langs[name]]
                p = tuple([words[i] for i in phrase])
                mine[p] = mine.get(p, 0) + times

    return rows.mapInArrow(work, "lang string, range int, salt int, automaton binary")


def _united(shards: DataFrame, keys: list[str], least: int) -> DataFrame:
    names = [*keys, "automaton"]

    def work(table: pa.Table) -> pa.Table:
        whole = union((Automaton.loads(a.as_py()) for a in table.column("automaton")), least)
        return table.select(keys).slice(0, 1).append_column("automaton", pa.array([whole.dumps()], pa.binary()))

    schema = ", ".join(f"{k} {'string' if k == 'lang' else 'int'}" for k in keys) + ", automaton binary"
    return shards.select(*names).groupBy(*keys).applyInArrow(work, schema)


def counts(docs: DataFrame, least: int = 30) -> DataFrame:
    """lang, range, automaton: the count transducers of all phrases of 1 to 4 words that occur ``least`` times, and of the empty phrase, which every word counts for."""
    importable(docs.sparkSession)
    rows, maps = _docs(docs), []
    for k in range(1, WORDS):
        maps.append(_bitmap(rows, k, maps, least))
    salted = _united(_shards(rows, maps), ["lang", "range", "salt"], 0)
    return saved(_united(salted, ["lang", "range"], least))


# -- parts -------------------------------------------------------------------------------------------
def _asked(table: DataFrame) -> DataFrame:
    """lang, range (asked), asker, automaton: the distinct parts of each range's phrases, by the range that counts them."""
    ranges = RANGES

    def work(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                lang, asker = batch.column("lang")[i].as_py(), batch.column("range")[i].as_py()
                parts: dict[int, set] = {}
                for phrase, _ in Automaton.loads(batch.column("automaton")[i].as_py()):
                    for k in range(1, len(phrase)):
                        for part in (phrase[:k], phrase[k:]):
                            parts.setdefault(range_of(lang, part, ranges), set()).add(part)
                n = len(parts)
                made = [Automaton.build((p, 0) for p in sorted(ps)).dumps() for ps in parts.values()]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(list(parts), pa.int32()), pa.array([asker] * n, pa.int32()), pa.array(made, pa.binary())], ["lang", "range", "asker", "automaton"])

    return table.mapInArrow(work, "lang string, range int, asker int, automaton binary")


def _answered(table: DataFrame, asked: DataFrame) -> DataFrame:
    """lang, range (of the asker), automaton: the parts with their counts."""

    def work(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out = []
        if mine.num_rows:
            own = Automaton.loads(mine.column("automaton")[0].as_py())
            out = [own.compose(Automaton.loads(a.as_py())).dumps() for a in theirs.column("automaton")]
        n = len(out)
        return pa.table({"lang": theirs.column("lang").slice(0, n), "range": theirs.column("asker").slice(0, n), "automaton": pa.array(out, pa.binary())})

    return table.groupBy("lang", "range").cogroup(asked.groupBy("lang", "range")).applyInArrow(work, "lang string, range int, automaton binary")


def _scored(table: DataFrame, answers: DataFrame, scale: int) -> DataFrame:
    """lang, phrase, words, a, l, r, score of all candidates; and the empty phrase with its weight as ``a``."""
    names, types = ["lang", "phrase", "words", "a", "l", "r", "score"], [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 4]

    def work(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out = []
        if mine.num_rows:
            lang = mine.column("lang")[0].as_py()
            f = {p: w for a in theirs.column("automaton") for p, w in Automaton.loads(a.as_py())}
            for phrase, a in Automaton.loads(mine.column("automaton")[0].as_py()):
                if len(phrase) == 1:
                    continue
                cuts = [(scale * a // (f[phrase[:k]] + f[phrase[k:]]), k) for k in range(1, len(phrase))]
                score, k = min(cuts) if cuts else (0, 0)
                out.append((lang, b" ".join(phrase).decode("utf-8", "replace"), len(phrase), a, f[phrase[:k]] if k else 0, f[phrase[k:]] if k else 0, score))
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=names)

    schema = "lang string, phrase string, words int, a long, l long, r long, score long"
    return table.groupBy("lang", "range").cogroup(answers.groupBy("lang", "range")).applyInArrow(work, schema)


def candidates(docs: DataFrame, least: int = 30, scale: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """All phrases of 2 to 4 words that occur ``least`` times, with their lowest-scoring cut; and the number of words of each language."""
    table = counts(docs, least)
    rows = saved(_scored(table, _answered(table, saved(_asked(table))), scale))
    return rows.filter("words > 0"), rows.filter("words = 0").select(F.col("lang").alias("_lang"), F.col("a").alias("n"))


def collocations(docs: DataFrame, least: int = 30, scale: int = 2_000_000, inside: tuple[int, int] = (80, 100), most: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``most`` highest scores, without phrases that mostly occur inside a longer one."""
    found, words = candidates(docs, least, scale)
    share, of = inside
    w = F.split("phrase", " ")
    sub = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))))
    longer = found.filter("words > 2").select("lang", F.explode(sub).alias("phrase"), "a").groupBy(F.col("lang").alias("_l"), F.col("phrase").alias("_p")).agg(F.max("a").alias("_f"))
    wide = lambda c: F.col(c).cast("decimal(28,0)")
    kept = found.join(longer, (found["lang"] == F.col("_l")) & (found["phrase"] == F.col("_p")), "left").filter(F.coalesce(F.lit(of) * wide("_f") < F.lit(share) * wide("a"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return top.join(words, F.col("lang") == F.col("_lang")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
