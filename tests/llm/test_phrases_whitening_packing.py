"""Phrase automata, whitening and packing, against plain versions of their own."""

import functools
import itertools
import json
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cloakframe.llm import packing, phrases, registry, whitening
from cloakframe.llm.phrases import Automaton


# -- phrases ----------------------------------------------------------------------------
def plain_collocations(docs, least, most=2000):
    f, n = defaultdict(Counter), Counter()
    for r in docs.select("lang", "text").collect():
        text = re.sub("[A-Z]", lambda m: m.group().lower(), r.text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^ \t]+", piece)
            n[r.lang or "und"] += len(w)
            for k in range(1, 5):
                f[r.lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        rows = []
        for p, a in found.items():
            if 100 * longer[p] >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:most])]
    return sorted(out)


def found(docs, **options):
    return sorted(tuple(r) for r in phrases.collocations(docs, **options).collect())


def test_automata():
    rng = random.Random(1)
    words = [b"a", b"b", b"c", b"\xc3\xa9", b"ab"]
    made = [{tuple(rng.choices(words, k=rng.randint(0, 4))): rng.randint(1, 9) for _ in range(40)} for _ in range(4)]
    automata = [Automaton.build(sorted(m.items())) for m in made]
    for m, a in zip(made, automata, strict=True):
        assert list(a) == sorted(m.items()) == list(Automaton.loads(a.dumps()))
        assert a.paths[-1] == len(m)
    total = sum(map(Counter, made), Counter())
    assert list(phrases.union(automata)) == sorted(total.items())
    assert list(phrases.union(automata, 7)) == sorted((p, n) for p, n in total.items() if n >= 7)
    asked = Automaton.build((p, 0) for p in sorted({*made[1], (b"zz",), (b"a", b"zz")}))
    assert list(automata[0].compose(asked)) == sorted((p, n) for p, n in made[0].items() if p in made[1])
    tails = Automaton.build(((x, b"of", b"the"), i) for i, x in enumerate(sorted(words)))
    assert len(tails.states) == 4  # equal tails are shared
    assert list(Automaton.build([])) == [] and list(phrases.union([])) == []


def test_collocations(spark, odd, none, small, sf001):
    assert found(odd, least=2) == plain_collocations(odd, 2)
    assert found(small, least=5) == plain_collocations(small, 5)
    assert found(none) == []
    assert phrases.collocations(none).columns == registry.op11_phrases(spark, sf001).columns


def test_pieces_ties_and_hot_phrases(spark, monkeypatch):
    rows = [("en", "A b. a B,c d!\tc\td e f g\x0ba b;"), ("en", None), (None, "a b a b a b a b"), ("und", "a b"), ("en", "x.y"), ("de", "")]
    rows += [("en", "same words again and again " * 30)] * 20 + [("xx", "one two")] * 3
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    want = plain_collocations(docs, 3)
    assert found(docs, least=3) == want and len(want) > 5
    assert found(docs, least=3, most=2) == plain_collocations(docs, 3, 2)
    monkeypatch.setattr(phrases, "PENDING", 4)  # counts are sent on early
    assert found(docs, least=3) == want


def test_clashing_hashes_are_told_apart():
    import pyarrow as pa

    part = pa.RecordBatch.from_pydict({"text": ["alpha beta alpha gamma longer-than-eight", "alpha"], "salt": [1, 2]})
    s = phrases._Slice(part)
    s.hash[:] = 7
    ids, words = s.word_ids(np.arange(6), np.array([0, 0, 0, 0, 0, 1]))
    assert [words[i] for i in ids] == [b"alpha", b"beta", b"alpha", b"gamma", b"longer-than-eight", b"alpha"]
    assert ids[0] == ids[2] != ids[5]


# -- whitening ---------------------------------------------------------------------------
@pytest.mark.parametrize("a", [np.diag([3.0, 3, 3, 1, 1, 0]), np.ones((8, 8)), np.zeros((3, 3)), np.array([[2.0]]), np.kron(np.eye(8), np.ones((4, 4))), "random"])
def test_eigenvectors(a):
    if isinstance(a, str):
        a = np.random.default_rng(0).normal(size=(40, 40))
        a = a @ a.T
    k = min(32, len(a))
    values, x = whitening.leading(a, k)
    size = max(np.abs(a).max(), 1)
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1][:k]).max() < 1e-13 * size
    assert np.abs(a @ x - x * values).max() < 1e-12 * size and np.abs(x.T @ x - np.eye(k)).max() < 1e-13


def whitened(spark, rows, k=32):
    vectors = spark.createDataFrame(rows, "vec_id long, vector array<float>, deviation string, label int").repartition(3)
    m = whitening.fit(vectors, k)
    return m, whitening.whiten(vectors, m).collect(), whitening.identity_error(vectors, m)


def test_whitening(spark):
    rng = np.random.default_rng(2)
    data = (rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) + 5).astype(np.float32)
    rows = [(i, v.tolist(), "clash", 1) for i, v in enumerate(data)]
    rows += [rows[3], rows[3], (None, rows[4][1], None, None), (900, [1.0, 2.0], "", 0), (901, [], "", 0)]
    odd = [(902, None, "", 0), (903, [1.0, None], "", 0), (904, [float("nan")] * 12, "", 0), (905, [float("inf")], "", 0)]
    m, got, error = whitened(spark, rows + odd, 5)
    x = np.array([np.floor(64 * np.pad(np.array(r[1], float), (0, 12 - len(r[1])))) + 1000000 for r in rows])
    v = (x - x.mean(0)).T @ (x - x.mean(0)) / len(x)
    assert m.n == len(got) == len(rows) and m.sums == x.sum(0).astype(int).tolist()
    assert np.abs(m.covariance - v).max() < 1e-9 * v.max()
    assert np.allclose(m.explained, np.linalg.eigvalsh(v)[::-1][:5] / np.trace(v), rtol=1e-10)
    assert error < 1e-10
    n, sums = len(x), x.sum(0).astype(int)
    assert Counter((r.vec_id, r.deviation) for r in got) == Counter((r[0], int((((n * e.astype(int)) - sums) ** 2).sum())) for r, e in zip(rows, x, strict=True))
    w = np.array([r.whitened for r in got])
    assert np.abs(w.T @ w / n - np.eye(5)).max() < 1e-10


def test_whitening_of_few_and_large_rows(spark):
    m, got, error = whitened(spark, [(1, [1.0, 2.0], "", 0)] * 3)
    assert not len(m.values) and error is None and [r.whitened for r in got] == [[]] * 3 and [r.deviation for r in got] == [0] * 3
    m, got, error = whitened(spark, [])
    assert m.n == 0 and got == [] and error is None
    m, got, error = whitened(spark, [(1, [1e17, 0.0], "", 0), (2, [-1e30, 1.0], "", 0), (3, [0.0, 2.0], "", 0)])
    assert error < 1e-6 and [r.deviation for r in got if r.vec_id != 3][0] is None
    m, got, _ = whitened(spark, [(i, [1.0, float(i), 2.0 * i], "", 0) for i in range(5)])
    assert len(m.values) == 1  # the others are constant or repeated


def test_whitening_query(spark, sf001):
    rows = registry.op12_whitening(spark, sf001).collect()
    assert len(rows) == 500 * 32 and Counter(r.component for r in rows) == {i: 500 for i in range(1, 33)}
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-10
    e = dict((r.component, r.explained) for r in rows)
    assert sorted(e.values(), reverse=True) == [e[i] for i in range(1, 33)] and sum(e.values()) < 1


# -- packing -----------------------------------------------------------------------------
@pytest.fixture(scope="session")
def vocabulary(spark):
    import public_tokenizers

    return packing.load(spark, public_tokenizers.path("word_bpe_49k.json"))


@functools.cache
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def encoded(text):
    return library().encode(text or "", add_special_tokens=False).ids


def held_to_contract(docs, rows, most):
    left = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = [*encoded(r.text), 0]
        for p in range(0, len(ids), most):
            cut = ids[p : p + most]
            left[r.doc_id, p // most, p, len(cut), zlib.crc32(struct.pack(f"<{len(cut)}I", *cut))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == left
    per = defaultdict(list)
    for r in rows:
        per[r.sequence_id].append((r.offset, r.length))
    for places in per.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= most
    return len(per)


def test_words_are_told_by_their_letters(vocabulary):
    from tokenizers import Tokenizer

    words = packing.Words(vocabulary.value)
    texts = pa.array(["the house", "The house, HOUSE: (house) house7 7the... it's", None, ""])
    ids, at = words.ids_of(texts)
    library = Tokenizer.from_str(vocabulary.value)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()]
    assert sorted(w for w in words.new if w.isalpha()) == [b"house", b"it", b"the"]  # each encoded once
    other = json.loads(vocabulary.value)
    other["normalizer"]["normalizers"].pop()  # capitals count
    words, library = packing.Words(json.dumps(other)), Tokenizer.from_str(json.dumps(other))
    assert words.ids_of(texts)[0].tolist() == [x for t in texts.to_pylist() for x in library.encode(t or "", add_special_tokens=False).ids]


def test_cut_words_keep_the_librarys_ids(vocabulary):
    from tokenizers import Tokenizer

    library, words, rng = Tokenizer.from_str(vocabulary.value), packing.Words(vocabulary.value), random.Random(5)
    parts = list("abAHTWYJIsStTmMdD019 '\u2019.,!-_~<>|$\t\n\x00\x1c\x1f\x7f\x0b\r\xa0\x85")
    parts += ["'s", "'re", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|endoftext", "|>", "\u00e9", "\u00c9", "\u0301", "\u0331", "\u030a", "\u0307", "\u0338"]
    parts += ["\u030c", "\u0308", "\u00df", "\u1e9e", "\u0130", "\u03a3", "\u2009", "\u200d", "\u4e2d", "\u0661", "\u00b2", "\u212a", "\u1100", "\u1161", "\U0001f600", "\ufb01", "\u20e3"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)] + ["<|", "ENDOFTEXT", "|>", "<|end", "oftext|>", None]
    for some in (texts, texts[-6:], [None], ["a"], []):
        ids, at = words.ids_of(pa.array(some, pa.string()))
        for text, a, b in zip(some, at, at[1:], strict=False):
            assert ids[a:b].tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_packing(spark, odd, none, small, vocabulary, monkeypatch):
    words = [" Émile's  naïve\tcafé", "<|endoftext|> a<|startoftext|>b", "é ́x", "a b\x1cc\x85d", "ΟΔΟΣ ΣΑΣ", "12345 \x00 \U0001f600", "y" * 5000]
    more = spark.createDataFrame(enumerate(words * 3), "doc_id long, text string")
    for docs in (odd, small, more):
        for most in (2048, 7):
            held_to_contract(docs, packing.packed_pieces(docs, vocabulary, most).collect(), most)
    assert packing.packed_pieces(none, vocabulary).collect() == []
    monkeypatch.setattr(packing, "KNOWN", 10)  # words are forgotten all the time
    held_to_contract(small, packing.packed_pieces(small, vocabulary).collect(), 2048)


def test_few_sequences(spark, small, vocabulary):
    rows = packing.packed_pieces(small, vocabulary).collect()
    least = -(-sum(r.length for r in rows) // 2048)
    assert held_to_contract(small, rows, 2048) <= least + 1


def test_plan_is_best_fit_decreasing():
    """Against one piece after the other into the fullest sequence that has room."""
    rng = random.Random(5)
    for _ in range(40):
        most = rng.choice([1, 5, 20, 64])
        counts = {n: rng.choice([1, 2, 3, 50]) for n in rng.sample(range(1, most + 1), rng.randint(1, min(most, 12)))}
        free = []
        for n in sorted(counts, reverse=True):
            for _ in range(counts[n]):
                fits = [(f, i) for i, f in enumerate(free) if f >= n]
                if fits:
                    free[min(fits)[1]] -= n
                else:
                    free.append(most - n)
        used, placed = defaultdict(int), Counter()
        for n, rank, until, each, sequence, offset in packing.plan(counts, most):
            assert rank == placed[n] and (until - rank) % each == 0
            placed[n] += until - rank
            for k in range(until - rank):
                assert used[sequence + k // each] == offset + k % each * n
                used[sequence + k // each] += n
        assert placed == counts and sorted(most - u for u in used.values()) == sorted(free)


def test_plan_does_not_grow_with_documents():
    rng = random.Random(6)
    sizes = [len(packing.plan({n: rng.randint(1, most) for n in range(1, 2049)}, 2048)) for most in (100, 100_000_000)]
    assert max(sizes) < 4 * 2048 * 4


def test_sequences_hold_the_ids(spark, small, vocabulary):
    packed = packing.packed_pieces(small, vocabulary, 512).cache()
    pieces = defaultdict(list)
    for r in packed.collect():
        pieces[r.sequence_id].append((r.offset, bytes(r.ids)))
    for r in packing.sequences(packed).collect():
        assert bytes(r.ids) == b"".join(x for _, x in sorted(pieces[r.sequence_id])) and r.n_ids == len(r.ids) // 4
    packed.unpersist()


def test_a_hot_length_is_numbered_in_many_ranges(spark, vocabulary):
    docs = spark.range(20000).selectExpr("id AS doc_id", "'one two three' AS text")
    rows = packing.packed_pieces(docs, vocabulary, 10, ids=False)
    assert rows.agg(F.countDistinct("sequence_id")).first()[0] == 10000
    assert len(set(itertools.chain.from_iterable(rows.select("sequence_id", "offset").distinct().groupBy("sequence_id").count().select("count").collect()))) == 1


def test_saved_tables_can_be_dropped(spark, tmp_path, monkeypatch):
    from cloakframe.llm import frames

    monkeypatch.setattr(frames, "shared_folder", lambda _: str(tmp_path))
    df = frames.saved(spark.range(5).toDF("id"))
    assert df.count() == 5 and len(list(tmp_path.rglob("*.parquet"))) > 0
    frames.drop_saved(spark)
    assert list(tmp_path.rglob("*.parquet")) == []
