"""The registered queries of the operators in this package, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from cloakframe.llm import bpe, chat, exactdup, langid, mixing, neardup, packing, pages, phrases, quality, shard, topk, whitening
from cloakframe.llm.frames import importable

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_shards(spark: SparkSession, sf: str) -> DataFrame:
    return shard.shards(_table(spark, sf, "documents"), n_shards=8)


def op2_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return topk.search(vectors, vectors.filter("vec_id % 20 = 0"), k=20, scale=64.0)


def op3_langid(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    out = langid.held_out()
    model = langid.fit(docs.filter(~out))
    said = langid.predict(docs, model)
    return said.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op4_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_neardup(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_components(_table(spark, sf, "documents"), words=4, percent=80)


def op6_exactdup(spark: SparkSession, sf: str) -> DataFrame:
    return exactdup.mark_copies(_table(spark, sf, "documents"))


def op7_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    model = quality.fit(docs, quality.grades(_table(spark, sf, "labels")))
    scored = quality.score(docs, model)
    good, best = F.try_element_at("tails", F.lit(1)), F.try_element_at("tails", F.lit(2))
    return scored.select("doc_id", "expected_grade", good.alias("p_good"), best.alias("p_best"), (good >= 0.5).alias("kept"))


def op8_bpe(spark: SparkSession, sf: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    vocabulary = bpe.load(spark, path)
    rows = bpe.encode(_table(spark, sf, "documents").select("doc_id", "text"), vocabulary).select("doc_id", "ids")
    rows = bpe.decode(rows, vocabulary)
    return rows.select(
        "doc_id", F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op9_chat(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "conversations")
    out = F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit(""))) % 5 == 0
    model = chat.fit(rows.filter(~out))
    said = chat.roles(rows.drop("role"), model)
    return said.select("conv_id", "turn", out.alias("held_out"), F.col("role").alias("role_pred"), chat.rendered(F.col("role"), F.col("text")).alias("rendered"))


def op10_main_text(spark: SparkSession, sf: str) -> DataFrame:
    table = _table(spark, sf, "pages").select("page_id", "url", "html")
    found = pages.extract(table, pages.fit(table))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf, "documents"), least=30, scale=2_000_000, inside=(80, 100), most=2000)


def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    model = whitening.fit(vectors, k=32, scale=64.0, shift=1_000_000)
    error = whitening.identity_error(vectors, model)
    rows = whitening.whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*map(F.lit, model.explained)) if model.explained else F.array().cast("array<double>")
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def op13_packing(spark: SparkSession, sf: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return packing.packed_pieces(_table(spark, sf, "documents"), packing.load(spark, path), most=2048, end=0, ids=False)


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)


_SQL = {
    "op2_topk": r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20""",
    "op4_mix": r"""
WITH w AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                  coalesce(len(list_filter(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), lambda x: regexp_full_match(x, '\p{L}+[.,;:!?]?'))), 0) AS plain,
                  (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u FROM documents),
k AS (SELECT doc_id, source, size, -ln(u) / greatest(0.05::DOUBLE, plain::DOUBLE / greatest(size, 1)) AS key FROM w),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
r AS (SELECT *, (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS w FROM s),
c AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / w AS ratio FROM r),
l AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER b, 0)) / ((SELECT sum(w) FROM r) - coalesce(sum(w) OVER b, 0)) AS level
      FROM c WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, w * (SELECT max(level) FROM l WHERE level <= ratio)) AS target FROM l),
g AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS goal FROM t),
p AS (SELECT k.doc_id, k.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN goal // g.source_size ELSE 0 END AS epochs, goal,
             CAST(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id ROWS UNBOUNDED PRECEDING) - k.size AS BIGINT) AS before
      FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, goal - epochs * source_size - before)) AS BIGINT) AS taken FROM p""",
    "op6_exactdup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op11_phrases": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
      FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
x AS (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS i FROM c),
y AS (SELECT x.*, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * x.a // (l.f + r.f) AS BIGINT) AS score
      FROM x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:i], ' ')
             JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[i + 1:], ' ')),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
s AS (SELECT lang, a, k, w, unnest(range(2, k)) AS j FROM c WHERE k > 2),
t AS (SELECT lang, a, unnest(list_transform(range(1, k - j + 2), lambda i: array_to_string(w[i:i + j - 1], ' '))) AS phrase FROM s),
m AS (SELECT lang, phrase, max(a) AS longer FROM t GROUP BY ALL)
SELECT z.lang, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, a DESC, z.phrase) AS rank, z.phrase, a, l, r, n, score
FROM z JOIN n ON n.lang = z.lang LEFT JOIN m ON m.lang = z.lang AND m.phrase = z.phrase
WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a QUALIFY rank <= 2000""",
}


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in (op1_shards, op2_topk, op3_langid, op4_mix, op5_neardup, op6_exactdup, op7_quality, op8_bpe, op9_chat, op10_main_text, op11_phrases, op12_whitening, op13_packing, pipeline)}


def oracle_sql() -> dict[str, str]:
    return _SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
