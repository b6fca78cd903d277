"""Tokens, languages, quality: against libraries, brute force and held-out labels."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Library

import corpus_pipeline
from cloakframe.llm import bpe, langid, quality, registry

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Library.from_file(PATH)


def test_ids_equal_the_library(spark, odd, none, small, library):
    vocabulary = bpe.load(spark, PATH)
    for docs in (odd, small, none):
        out = bpe.decode(bpe.encode(docs, vocabulary), vocabulary)
        assert set(out.columns) == set(docs.columns) | {"ids", "decoded"} and out.count() == docs.count()
        for r in out.collect():
            assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(r.text or "", add_special_tokens=False).ids
            assert r.decoded == (r.text or "")


def test_random_texts(library):
    t, rng = bpe.Tokenizer.from_json(open(PATH).read()), random.Random(1)
    parts = [*"ab c  \n\t'sdtrelmv1!é\x1c\x85日💩ß|<>", " 's", "'re", "<|endoftext|>", "   ", "\n\n", " \n", "aaaaaa"]
    for _ in range(1500):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(0, 50)))
        ids = np.frombuffer(t.encode(x), "<u4")
        assert ids.tolist() == library.encode(x, add_special_tokens=False).ids and t.decode(ids) == x
    for x in ("a" * 5000, "the" * 3000, " " * 999):  # beyond the short words
        assert np.frombuffer(t.encode(x), "<u4").tolist() == library.encode(x, add_special_tokens=False).ids


def test_phrases_are_longest_matches():
    """Against a search for substrings of the learned text."""
    rng = random.Random(2)
    learned = "".join(rng.choice("ab c") for _ in range(200))
    m = langid.Model({"x": [learned], "y": ["xyz zyx"]}, symbols=10000)
    known = bytes([0, *langid.symbols_of(learned, m.table), 0])
    for _ in range(50):
        s = langid.symbols_of("".join(rng.choice("ab cxz") for _ in range(60)), m.table)
        text, n, i = bytes(s), 0, 0
        while i < len(text):  # the longest learned string from here, one symbol at least
            j = i + 1
            while j < len(text) and text[i : j + 1] in known:
                j += 1
            n, i = n + 1, j
        assert int(langid.phrases([s], m.walks(), m.size)[0, 0]) == n


def test_letters_of_many_scripts():
    """Every letter is a symbol: languages with little text beside scripts of many letters; and phrases, whatever part of the transitions is in tables."""
    rng = random.Random(7)
    han, hangul = ([chr(rng.randint(a, a + 400)) for _ in range(3000)] for a in (0x4E00, 0xAC00))
    texts = {"zh": ["".join(han)], "ko": ["".join(hangul)], "ka": ["მე ვარ აქ და ის არის იქ"], "hy": ["ես այստեղ եմ և նա այնտեղ է"]}
    m = langid.Model(texts)
    asked = {"ka": "ის აქ არის და მე იქ", "hy": "նա այստեղ է և ես այնտեղ", "zh": "".join(han[500:560]), "ko": "".join(hangul[70:100])}
    pieces = [langid.symbols_of(t, m.table) for t in asked.values()]
    assert all(len(set(p.tolist())) == len({c for c in t if c != " "}) + (" " in t) and m.size - 1 not in p for p, t in zip(pieces, asked.values(), strict=True))
    cost = langid.phrases(pieces, m.walks(), m.size) * np.log2(m.lengths)
    assert [m.languages[k] for k in cost.argmin(1)] == list(asked)
    mixed = [langid.symbols_of("".join(rng.choice([*han[:40], *hangul[:40], *texts["ka"][0], "q", "1"]) for _ in range(900)), m.table)] + pieces
    want = []
    for s in mixed:
        want.append([])
        for lang in m.languages:
            known, n = "\0" + "\0".join("".join(map(chr, langid.symbols_of(t, m.table))) for t in texts[lang]) + "\0", 0
            for a in range(0, len(s), langid.SEGMENT):
                part, i = "".join(map(chr, s[a : a + langid.SEGMENT])), 0
                while i < len(part):
                    j = i + 1
                    while j < len(part) and part[i : j + 1] in known:
                        j += 1
                    n, i = n + 1, j
            want[-1].append(n)
    for cells in (langid.CELLS, 1 << 20, 100000, 1):
        assert langid.phrases(mixed, m.walks(cells), m.size).tolist() == want


def test_languages(spark, odd, none, sf01):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    said = registry.op3_langid(spark, sf01).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right = said.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97
    out = langid.predict(odd, langid.fit(odd)).collect()
    by_text = {r.doc_id: r for r in out}
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert [by_text[i].lang_pred for i in (0, 1, 2, 5)] == ["und"] * 4 and by_text[10].lang_pred in ("en", "fr")
    assert langid.predict(none, langid.fit(none)).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(none)).collect()} == {"und"}


def test_thresholds_are_ordered_and_the_gradient_is_right():
    import pyarrow as pa

    rng = random.Random(5)
    grades = np.array([rng.randint(0, 2) for _ in range(400)])
    texts = pa.array([" ".join(rng.choice([f"bad{rng.randint(0, 3)}", "mid", f"good{rng.randint(0, 3)}"][g : g + 1] + ["x"]) for _ in range(20)) for g in grades])
    m = quality.learn(texts, grades, 2)
    tails = m.tails(texts)
    assert m.thresholds[0] < m.thresholds[1] and (tails[:, 0] >= tails[:, 1]).all()
    assert (np.rint(tails.sum(1)) == grades).mean() > 0.95


def test_the_fit_is_the_maximum():
    """The penalised likelihood, computed anew, has no slope at the learned weights in any direction (finite differences)."""
    import pyarrow as pa

    rng = random.Random(9)
    grades = np.array([rng.randint(0, 2) for _ in range(90)])
    texts = pa.array([" ".join(rng.choice(["bad", "mid", "good", ["bad", "mid", "good"][g]]) for _ in range(6)) for g in grades])
    m = quality.learn(texts, grades, 2, rounds=6000)

    def objective(forms, words, thresholds):
        t = np.column_stack([np.ones(90), quality.Model(forms, words, thresholds).tails(texts), np.zeros(90)])
        p = t[np.arange(90), grades] - t[np.arange(90), grades + 1]
        return np.log(p).mean() - quality.RIDGE / 2 * ((forms**2).sum() + (words**2).sum())

    def slopes(forms, words, thresholds, h=1e-4):
        x = [forms.astype(float), words.astype(float), thresholds.astype(float)]
        out = []
        for part in range(3):
            used = np.flatnonzero(x[part]) if part < 2 else np.arange(2)
            for i in used:
                up, down = [v.copy() for v in x], [v.copy() for v in x]
                up[part][i] += h
                down[part][i] -= h
                out.append((objective(*up) - objective(*down)) / (2 * h))
        return np.array(out)

    learned = slopes(m.forms, m.words, m.thresholds)
    away = slopes(m.forms * 0.5, m.words * 0.5, m.thresholds + 0.3)
    assert len(learned) > 5 and np.abs(learned).max() < 2e-3 and np.abs(away).max() > 20 * np.abs(learned).max()
    best = objective(m.forms, m.words, m.thresholds)
    for _ in range(200):  # and nothing near it is better
        move = np.random.default_rng(rng.randint(0, 1 << 30))
        forms = m.forms + (m.forms != 0) * move.normal(size=len(m.forms)) * 0.05
        words = m.words + (m.words != 0) * move.normal(size=len(m.words)) * 0.05
        assert objective(forms, words, np.sort(m.thresholds + move.normal(size=2) * 0.05)) < best + 1e-5


def test_quality_held_out(spark, odd, none, sf01):
    docs, labels = (spark.read.parquet(f"{sf01}/{n}.parquet") for n in ("documents", "labels"))
    rated = quality.grades(labels).join(labels.select("doc_id", "quality"), "doc_id")
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = quality.fit(docs, rated.filter(~out))
    said = quality.score(docs, model).join(rated.filter(out), "doc_id").select((F.col("tails")[0] >= 0.5) == (F.col("quality") == 1))
    rows = [r[0] for r in said.collect()]
    assert sum(rows) > 0.93 * len(rows)
    scored = quality.score(odd, model)
    assert scored.count() == odd.count() and set(scored.columns) == set(odd.columns) | {"expected_grade"}
    kept = quality.keep_good(odd, model)
    assert kept.columns == odd.columns and kept.count() <= odd.count()
    assert quality.score(none, model).count() == 0 and quality.keep_good(none, model).count() == 0
    unrated = quality.fit(odd, spark.createDataFrame([], "doc_id long, grade int"))
    assert {round(r.tails[0], 6) for r in quality.score(odd, unrated).collect()} == {0.5}


def test_every_language_is_learned(spark):
    """300 languages of few letters each, beside one with many texts."""
    word = lambda i: "".join(chr(97 + (i // 26**k) % 26) for k in range(3))
    rows = [(i, f"{word(7 * i)} {word(7 * i)}{word(11 * i)} " * 20, f"l{i:03d}") for i in range(300)] + [(1000 + i, "plain words of a large language " * 30, "zz") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.fit(docs)
    assert len(model.languages) == 301
    said = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).select("doc_id", "lang_pred").collect()}
    assert sum(said[i] == lang for i, _, lang in rows) > 0.97 * len(rows)


def test_pipeline_decodes_in_the_pass_that_encodes(spark):
    docs = spark.createDataFrame([(1, "plain words  here\n", "a"), (2, None, "a"), (3, "", "b"), (4, "naïve \u4f60\u597d <|endoftext|>" * 9, "b")], "doc_id long, text string, source string")
    vocabulary = bpe.load(spark, PATH)
    twice = {r.doc_id: (bytes(r.ids), r.decoded) for r in bpe.decode(bpe.encode(docs, vocabulary), vocabulary).collect()}
    once = {r.doc_id: (bytes(r.ids), r.decoded) for r in bpe.encode(docs, vocabulary, decoded="decoded").collect()}
    assert once == twice
    out = corpus_pipeline.tokens(spark, docs, "", PATH)
    assert all(r.round_trip and bytes(r.ids) == once[r.doc_id][0] for r in out.collect())
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # one Python worker a task
