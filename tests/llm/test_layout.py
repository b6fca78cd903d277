"""Sharding, search, mixing, chat, pages and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cloakframe.llm import chat, mixing, pages, registry, shard, topk


def sharded(docs):
    rows = shard.shards(docs).collect()
    n = docs.count()
    assert len(rows) == n and {r.law for r in rows} <= {"rows"} and all(r.grown_shard is None for r in rows)
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    per = Counter(r.shard for r in rows)
    assert all(per[j] == n // 8 + (j < n % 8) for j in range(8))
    for j in range(8):
        assert sorted(r.slot for r in rows if r.shard == j) == list(range(per[j]))
    return rows


def test_shards(spark, odd, none, small):
    sharded(odd)
    assert shard.shards(none).count() == 0
    cut = Counter()
    for r in sharded(small):
        cut[r.text_crc32, r["size"], r.shard] += 1
    groups = Counter((c, s) for c, s, _ in cut)
    assert max(groups.values()) == 1  # every group of copies lies in one shard


def test_a_group_beyond_the_quota_fills_whole_shards(spark):
    docs = spark.range(800).selectExpr("id AS doc_id", "IF(id % 2 = 0, 'hot', IF(id % 4 = 1, concat('t', id), concat('u', id % 40))) AS text")
    rows = sharded(docs)
    hot = Counter(r.shard for r in rows if r.text_crc32 == zlib.crc32(b"hot"))
    assert sum(hot.values()) == 400 and len(hot) <= 5


def test_search(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 40)).round(2)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(700, None), (701, [1.0, None]), (702, [float("nan")] * 40), (703, []), (None, [1.0] * 40), (704, [float("inf")]), (705, [2.0, 1.0]), rows[5], rows[0]]
    vectors = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    full = {i: np.floor(64 * np.pad(np.array(v), (0, 40 - len(v)))).astype(int) for i, v in rows if i is not None and v is not None and all(e is not None and np.isfinite(e) for e in v)}
    want = set()
    for q in full:
        if q % 20 == 0:
            best = sorted((-int(full[q] @ v), i) for i, v in full.items() if i != q)[:20]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    for block in (8192, 100):
        topk.BLOCK, before = block, topk.BLOCK
        try:
            got = {tuple(r) for r in topk.search(vectors, vectors.filter("vec_id % 20 = 0")).collect()}
        finally:
            topk.BLOCK = before
        assert got == want
    large = spark.createDataFrame([(0, [1e17, 3.0]), (1, [1e17, 1.0]), (2, [-1e30, 0.0])], "vec_id long, vector array<double>")
    out = topk.search(large, large.filter("vec_id = 0"), k=5).collect()
    assert [(r.vec_id, r.score) for r in out] == [(1, (1 << 63) - 1), (2, -(1 << 63))]
    assert topk.search(vectors.limit(0), vectors.limit(0)).count() == 0


def test_mix(spark, odd, none, small):
    for docs in (odd, small):
        rows = mixing.mix(docs).collect()
        assert len(rows) == docs.count()
        assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(sum(r["size"] for r in rows))
        taken, size = Counter(), Counter()
        for r in rows:
            taken[r.source] += r.taken
            size[r.source] += r["size"]
            assert 0 <= r.taken <= 3 * r["size"] and r.target <= 3 * r.source_size + 1e-6
        for r in rows:
            assert size[r.source] == r.source_size and abs(taken[r.source] - r.target) <= 1
        assert Counter(map(tuple, rows)) == Counter(tuple(r) for r in mixing.mix(docs.repartition(5)).collect())
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).columns == none.columns
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_repeated_ids_come_as_often_as_the_mix_says(spark):
    """Rows of one id among which the budget ends: equal ones, ones with another text, ones that differ in other columns."""
    many = [(1, "w " * 10, "a", i % 3) for i in range(9)] + [(1, "other text here", "a", 0)] + [(None, "w " * 10, None, None)] * 5
    for rows in ([(1, "x y", "a", 0), (1, "x y", "a", 0), (2, "z " * 3, "b", 0)], many, [*many, *((i, "v " * 7, "b", 0) for i in range(20, 40))]):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra long")
        mix = mixing.mix(docs).collect()
        want = sum(r.epochs + (r["size"] > 0 and 2 * r.part >= r["size"]) for r in mix)
        got = mixing.mixed_documents(docs).collect()
        assert len(got) == want and {tuple(r) for r in got} <= set(rows)
        each = Counter(tuple(r) for r in got)
        for r in set(rows):  # never more than the row's share of epochs and one more
            epochs = {m.epochs for m in mix if m.source == r[2]}.pop()
            assert epochs * rows.count(r) <= each[r] <= (epochs + 1) * rows.count(r)
        assert each == Counter(tuple(r) for r in mixing.mixed_documents(docs.repartition(5)).collect())


def test_ranges_of_keys_are_small_at_every_weight(spark):
    for weight in (0.05, 0.4, 1.0, 30.0):
        keys = spark.range(20000).select((-F.log(mixing.uniform("id")) / weight).alias("key"))
        ranges = keys.groupBy(mixing.key_range(F.col("key")).alias("r")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy("r").collect()
        assert max(r.n for r in ranges) < 40 and all(a.high < b.low for a, b in zip(ranges, ranges[1:], strict=False))
    odd = spark.sql("SELECT explode(array(NULL, double('NaN'), double('inf'), 0D, -1D, 1e-300)) AS key").select("key", mixing.key_range(F.col("key")).alias("r"))
    assert [r.r for r in odd.collect()] == [1000001, 1000001, 1000000, -1000001, -1000001, -1000000]
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('1 2 3 ', id) AS text", "IF(id % 2 = 0, 'a', 'b') AS source")  # all of the least weight
    assert {r.source for r in mixing.mix(docs).filter("part > 0").collect()} and mixing.mix(docs).agg(F.sum("taken")).first()[0] == 12000


def test_levels(spark):
    """Caps, and sources named null, against filling up step by step."""
    rng = random.Random(4)
    for _ in range(4):
        sizes = [(None if i == 5 else f"s{i}", rng.choice([0, 1, 10, 500, 10000])) for i in range(6)]
        w = [1, 2, 3, 1, 2, 3]
        left, open_, want = float(sum(s for _, s in sizes)), set(range(6)), [0.0] * 6
        while open_:
            level = left / sum(w[i] for i in open_)
            full = {i for i in open_ if w[i] * level > 3 * sizes[i][1]}
            for i in full or open_:
                want[i] = 3.0 * sizes[i][1] if full else w[i] * level
            left -= sum(want[i] for i in full)
            open_ = open_ - full if full else set()
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
        assert [got[s] for s, _ in sizes] == pytest.approx(want)


# -- chat -------------------------------------------------------------------------------
def brute(model, seen):
    import itertools

    emit, k = model.of(seen), len(model.roles)
    score = lambda p: model.first[p[0]] + sum(model.after[a, b] for a, b in itertools.pairwise(p)) + sum(e[r] for e, r in zip(emit, p, strict=True))
    return max(score(p) for p in itertools.product(range(k), repeat=len(seen))), score


def test_viterbi(spark, sf001):
    rows = spark.read.parquet(f"{sf001}/conversations.parquet")
    model = chat.fit(rows)
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 7):
        seen = np.column_stack([rng.integers(0, s, n) for s in chat.SIZES])
        best, score = brute(model, seen)
        path = chat.viterbi(model, seen, [(0, n)], np.array([-1]), np.array([-1]))
        assert score(path.tolist()) == pytest.approx(best)


def test_blocks_of_a_long_conversation_meet(spark, sf001):
    rows = spark.read.parquet(f"{sf001}/conversations.parquet")
    model = chat.fit(rows)
    long = rows.selectExpr("conv_id % 2 AS conv_id", "conv_id * 100 + turn AS turn", "text")
    at = lambda block: {(r.conv_id, r.turn): r.role for r in chat.roles(long, model, block=block).collect()}
    cut, whole = at(64), at(1 << 40)
    seen = {(r.conv_id, r.turn): r.s for r in long.select("conv_id", "turn", chat.observed(F.col("text")).alias("s")).collect()}
    for c in (0, 1):
        keys = sorted(k for k in seen if k[0] == c)
        x = np.array([seen[k] for k in keys])
        emit = model.of(x)
        score = lambda said: (p := [model.roles.index(said[k]) for k in keys]) and model.first[p[0]] + sum(model.after[a, b] for a, b in zip(p, p[1:], strict=False)) + sum(e[r] for e, r in zip(emit, p, strict=True))  # noqa: B023, E731
        assert score(cut) == pytest.approx(score(whole))


def test_roles(spark, sf01):
    rows = spark.read.parquet(f"{sf01}/conversations.parquet")
    said = registry.op9_chat(spark, sf01).filter("held_out").join(rows, ["conv_id", "turn"])
    assert said.agg(F.avg((F.col("role") == F.col("role_pred")).cast("double"))).first()[0] > 0.9
    model = chat.fit(rows)
    odd = spark.createDataFrame(
        [(1, 0, "User: hi?"), (1, 1, None), (1, 1, ""), (1, None, "x"), (None, 1, "y"), (None, None, None), (1, 0, "User: hi?"), (2, 5, "z" * 200000)], "conv_id long, turn long, text string"
    )
    out = chat.roles(odd, model)
    assert out.count() == 8 and out.filter("role IS NULL").count() == 0
    assert chat.roles(odd.limit(0), model).count() == 0
    assert chat.roles(odd, chat.fit(rows.limit(0))).filter("role IS NULL").count() == 8


def test_transcript_lines_and_rendering(spark):
    rows = [(c, t, r, f"{r.title()}: {x}") for c in range(40) for t, (r, x) in enumerate([("user", "what is it?"), ("assistant", "it is this. and that."), ("user", "why?"), ("assistant", "so.")])]
    model = chat.fit(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    raw = spark.createDataFrame([(1, "User: how <|x|>?\n\nAssistant: like that."), (2, None), (3, "")], "conv_id long, text string")
    got = chat.roles(chat.lines(raw), model).orderBy("turn").select(chat.rendered(F.col("role"), F.col("text"))).collect()
    assert [r[0] for r in got] == ["<|user|>\nhow < |x|>?\n<|end|>\n", "<|assistant|>\nlike that.\n<|end|>\n"]


def test_neighbours_across_gaps_and_all_roles(spark, monkeypatch):
    """Turns with gaps and over blocks follow each other, an unlabelled one between two says nothing, and no role is too rare."""
    monkeypatch.setattr(chat, "BLOCK", 8)
    talk = [(0, "a"), (3, "b"), (7, "a"), (20, "b"), (21, None), (22, "a"), (40, "c")]
    rows = [(c, t, r, "x") for c in range(5) for t, r in talk] + [(None, 1, "b", "x"), (None, 2, "b", "x")] + [(9, i, f"r{i}", "x") for i in range(0, 40, 2)]
    model = chat.fit(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert model.roles == sorted({r for _, _, r, _ in rows if r})
    k, at = len(model.roles), model.roles.index
    first, after = np.ones(k), np.ones((k, k))
    first[at("a")] += 5
    first[at("b")] += 2
    first[at("r0")] += 1
    for x, y, n in (("a", "b", 10), ("b", "a", 5), ("a", "c", 5), *((f"r{i}", f"r{i + 2}", 1) for i in range(0, 38, 2))):
        after[at(x), at(y)] += n
    assert np.exp(model.first) == pytest.approx(first / first.sum()) and np.exp(model.after) == pytest.approx(after / after.sum(1, keepdims=True))


def test_many_roles_stay_within_memory(spark, monkeypatch):
    """Tables of pairs of roles are worked through in slices: as exact, and bounded."""
    import tracemalloc

    rng = np.random.default_rng(5)
    k = 300
    log = lambda x: np.log(x / x.sum(-1, keepdims=True))
    model = chat.Model([f"r{i}" for i in range(k)], log(rng.random(k)), log(rng.random((k, k))), [log(rng.random((k, n))) for n in chat.SIZES])
    seen = np.column_stack([rng.integers(0, n, 12) for n in chat.SIZES])
    spans = [(0, 5), (5, 6), (6, 12)]
    ends = np.full(3, -1)
    whole, paths = chat.products(model, seen, spans), chat.viterbi(model, seen, spans, ends, ends)
    monkeypatch.setattr(chat, "CELLS", 1 << 17)
    tracemalloc.start()
    assert np.array_equal(chat.products(model, seen, spans), whole) and np.array_equal(chat.viterbi(model, seen, spans, ends, ends), paths)
    assert tracemalloc.get_traced_memory()[1] < 16 << 20  # k ^ 3 cells are 216 MB
    tracemalloc.stop()
    rows = spark.range(40).selectExpr("id AS conv_id", "1L AS turn", "concat('r', id) AS role", "'x' AS text")
    monkeypatch.setattr(chat, "MOST_ROLES", 39)
    with pytest.raises(ValueError, match="more than 39 roles"):
        chat.fit(rows)


# -- pages --------------------------------------------------------------------------------
def test_cut_is_cheapest():
    import itertools

    rng = random.Random(6)
    for _ in range(60):
        n = rng.randint(1, 8)
        gain = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, i + 1, rng.uniform(0, 2)) for i in range(n - 1)] + [(0, n - 1, 1.0)] * (n > 2)
        cost = lambda y: sum(max(g, 0) if not k else max(-g, 0) for g, k in zip(gain, y, strict=True)) + sum(w for a, b, w in edges if y[a] != y[b])  # noqa: B023, E731
        assert cost(pages.cut(gain, edges)) == pytest.approx(min(cost(y) for y in itertools.product([False, True], repeat=n)))


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body class="has-sidebar"><header><p>Site name</p></header>
<nav><ul><li><a href="/">Home</a><li><a href="/b">B</a></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div>
<article><header><h1>Head &amp;  line</h1></header><p><b>First
 para.<br><p>Second&nbsp;para &lt;x&gt;.</p><aside><p>Read also this.</p></aside><ul><li>Item one</li></ul>
<section id="comments"><p>A reader says no.</p></section></article><div id="sidebar"><p>More stories here.</p></div>
<form><p>Sign up now</p><input></form><footer><p>Copyright</p></footer>"""


def test_main_text(spark, sf01):
    table = spark.read.parquet(f"{sf01}/pages.parquet")
    weights = pages.fit(table)
    odd = spark.createDataFrame([(1, PAGE, "c"), (2, None, "c"), (3, "", "c"), (4, "<p><<a \"'<b", "c"), (5, "<div>" * 30000 + "deep", "c"), (6, "<nav>menu</nav>", "c"), (1, PAGE, "c")],
                                "page_id long, html string, text string")
    out = pages.extract(odd, weights)
    got = [(r.page_id, r.text) for r in out.orderBy("page_id").collect()]
    assert got[0] == got[1] == (1, "Head & line\nFirst para.\nSecond para <x>.\nItem one")
    assert dict(got)[2] == dict(got)[3] == dict(got)[6] == "" and out.columns == ["page_id", "html", "text"]
    assert pages.extract(odd.limit(0), pages.fit(odd.limit(0))).count() == 0
    # the pages' articles are what lies between their tags
    import html as h
    import re

    for r, q in zip(pages.extract(table, weights).orderBy("page_id").collect(), table.orderBy("page_id").collect(), strict=True):
        inner = q.html.split("<article>")[1].split("</article>")[0].replace("<br>", " ")
        blocks = (" ".join(h.unescape(re.sub("</?b>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner))
        assert r.text == "\n".join(b for b in blocks if b)


STORY = ("<h1>Head line</h1>" + "<p>This is a long enough paragraph of the story, with a comma and a full stop.</p>" * 3)
TOLD = "<nav><ul><li><a href='/'>Home</a></ul></nav>{}<div id='sidebar'><p>More stories here.</p></div><footer><p>Copyright</p></footer>"


@pytest.mark.parametrize("start", ["<form id='aspnetForm' action='./'>", "<div class='site has-sidebar'>", "<div class='layout no-ads'>", "<div class='wrap nav-open'>", "<div class='page header-fixed'><form>"])
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_a_wrapper_tells_nothing(spark, sf01, start, inner):
    """A form or name around the whole page leaves the article, whatever else is told in it."""
    weights = _weights(spark, sf01)
    end = "</form></div>" if start.endswith("<form>") else "</form>" if "<form" in start else "</div>"
    want = pages._texts(pa.array([f"<body>{TOLD.format(f'<{inner}>{STORY}</{inner}>')}</body>"]), weights)
    assert want[0].count("long enough") == 3 and "Copyright" not in want[0] and "More stories" not in want[0]
    assert pages._texts(pa.array([f"<body>{start}{TOLD.format(f'<{inner}>{STORY}</{inner}>')}{end}</body>"]), weights) == want
    within = f"<body>{TOLD.format(f'<main>{start}<{inner}>{STORY}</{inner}>{end}</main>')}</body>"
    assert pages._texts(pa.array([within]), weights)[0].count("long enough") == 3


def test_what_is_told_beside_the_article_stays_out(spark, sf01):
    weights = _weights(spark, sf01)
    talk = "<p>A reader says no, and this comment is about as long as a paragraph of the story.</p>" * 9
    story = f"<article>{STORY}</article>"
    for page in (
        f"{story}<section id='comments'><article>{talk}</article></section>", f"<main>{story}<div id='comments'>{talk}</div></main>", f"<article>{STORY}<section id='comments'>{talk}</section></article>",
        f"{story}<aside><article>{talk}</article></aside>", f"{story}<div class='related'><article><p>A reader says no.</p></article></div>", f"<nav><a href='/'>Home</a>{story}", f"<head><title>x</title><body>{story}",
    ):
        text = pages._texts(pa.array([page]), weights)[0]
        assert text.count("long enough") == 3 and "reader" not in text and "Home" not in text


@pytest.mark.parametrize("inside", ["<svg class='i'/>", "<svg><title>x</title></svg>", "<iframe/>", "<iframe src='x'></iframe>", "<select>", "<select><option>A</select>", "<template>", "<noscript>", "<textarea>"])
def test_skipped_elements_take_no_text_with_them(spark, sf01, inside):
    weights = _weights(spark, sf01)
    para = "<p>This is a long enough paragraph of the story, with a comma and a full stop.</p>"
    text = pages._texts(pa.array([f"<body><article>{para}{inside}{para}<div>{inside} {para}</div></article></body>"]), weights)[0]
    assert text.count("long enough") == 3 and "x" not in text.split() and "A" not in text.split()


def test_many_open_elements_take_linear_time():
    import time

    start = time.time()
    assert len(pages.blocks("<select><svg><p>a</p>" * 40000)) == 40000
    assert time.time() - start < 20


def test_one_word_of_a_name_drops_nothing(spark, sf01):
    weights = _weights(spark, sf01)
    for name in ("social-history", "share-prices", "notice-of-intent", "the-search-for-meaning"):
        within = f"<body><nav><p>Home</p></nav><article>{STORY}<div class='{name}'>{STORY}</div></article><footer><p>Copyright</p></footer></body>"
        assert pages._texts(pa.array([within]), weights)[0].count("long enough") == 6
        alone = f"<body><div class='story'>{STORY}</div><div class='{name}'>{STORY}</div><footer><p>Copyright</p></footer></body>"
        assert pages._texts(pa.array([alone]), weights)[0].count("long enough") == 6
    for name in ("social-links", "share", "cookie-notice", "search-box"):
        told = f"<body><article>{STORY}<div class='{name}'><p>Tell others.</p></div></article></body>"
        assert "Tell" not in pages._texts(pa.array([told]), weights)[0]


_learned = []


def _weights(spark, sf01):
    if not _learned:
        _learned.append(pages.fit(spark.read.parquet(f"{sf01}/pages.parquet")))
    return _learned[0]


# -- pipeline ------------------------------------------------------------------------------
def test_pipeline(spark, sf001, small, none, odd, tmp_path):
    from test_dedup import SPACE, near_truth

    docs = small.select("doc_id", "text", "lang", "source", "n_chars")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        steps.append(stage(spark, steps[-1], sf001).cache())
        assert steps[-1].columns == docs.columns
    ids = [[r.doc_id for r in s.select("doc_id").collect()] for s in steps]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf001}/labels.parquet").collect()}
    good = [i for i in ids[0] if labels.get(i) == 1]
    assert len(set(good) - set(ids[1])) <= 0.02 * len(good)
    seen, want = set(), []
    for r in sorted(steps[1].collect(), key=lambda r: r.doc_id):
        key = SPACE.sub(" ", r.text or "")
        want += [] if key in seen else [r.doc_id]
        seen.add(key)
    assert sorted(ids[2]) == want
    assert sorted(ids[3]) == [d for d, _, _, kept in sorted(near_truth(steps[2].collect(), 5, 80)) if kept]
    mix = {r.doc_id: r for r in mixing.mix(steps[3]).collect()}
    copies = Counter(ids[4])
    assert all(copies[i] == r.epochs + (r["size"] > 0 and 2 * r.part >= r["size"]) for i, r in mix.items())
    out = corpus_pipeline.run(spark, sf001).collect()
    assert Counter(r.doc_id for r in out) == copies and all(r.round_trip for r in out)
    for docs in (none, odd):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf001)
        docs.count()
