"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorebook.llm import (
    decontaminate, hard_negatives, jaccard_join, license_scan, packing, pii_pseudonyms, quality, secret_scan, source_mix, spelling, substring_dedup, suffix_dedup, topk_search,
)
from scorebook.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return keep


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(read(spark, sf_dir, "documents"), tokenizer_path(), capacity=4096)


@query("op2_secret_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(read(spark, sf_dir, "documents"))


@query("op7_exact_top_k", """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(read(spark, sf_dir, "embeddings"), F.col("vid") % 20 == 0, k=20, scale=64)


@query("op10_importance_resampling")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the sample keeps."""
    return quality.kept_ids(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op4_winnowing_decontamination", r"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    n AS (SELECT DISTINCT least(13, len(w)) AS n FROM i WHERE len(w) > 0),
    iw AS (SELECT DISTINCT item, n, list_slice(w, s, s + n - 1) AS g
           FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
    dw AS (SELECT rid, n, s, list_slice(w, s, s + n - 1) AS g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, n WHERE len(w) >= n)),
    h AS (SELECT DISTINCT dw.rid, dw.n, dw.s, iw.item FROM dw JOIN iw USING (n, g)),
    c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM h) GROUP BY rid),
    t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), length=13, k=6)


@query("op5_difference_cover_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(read(spark, sf_dir, "documents"), length=50).drop("kept")


@query("op1_suffix_array_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(read(spark, sf_dir, "documents"), length=100, with_text=False).drop("kept")


@query("op8_ngram_jaccard_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.report(read(spark, sf_dir, "documents"), n=5, threshold=0.8)


#: Stands in for the secret that a deployment passes.
DEMO_KEY = "key of the registered query"


@query("op3_feistel_pseudonyms")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii_pseudonyms.pseudonymize(docs, DEMO_KEY)


@query("op6_license_sentence_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read(spark, sf_dir, "documents"))


@query("op13_source_mix", r"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, md5(coalesce(text, '')) AS th,
                      CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
          FROM d GROUP BY source),
    -- Holding the k sources of least size per weight at twice their size leaves a level for the others; the true level is the greatest of these.
    o AS (SELECT coalesce(sum(source_size) OVER w, 0) AS held, coalesce(sum(weight) OVER w, 0) AS held_weight FROM s
          WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    a AS (SELECT sum(source_size) AS words, sum(weight) AS weights FROM s),
    l AS (SELECT CAST(3 * words - 4 * held AS DOUBLE) AS up, CAST(2 * (weights - held_weight) AS DOUBLE) AS down FROM o, a),
    v AS (SELECT up, down FROM l ORDER BY up / down DESC LIMIT 1),
    t AS (SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), weight * up / down) AS target FROM s, v),
    q AS (SELECT *, CAST(floor(target) AS BIGINT) // greatest(source_size, 1) AS laps, CAST(floor(target) AS BIGINT) % greatest(source_size, 1) AS rest FROM t),
    p AS (SELECT d.*, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || th), doc_id NULLS FIRST, size, th, rid
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d)
    SELECT doc_id, size, source_size, target, CAST(laps * size + greatest(0, least(start + size, rest) - start) AS BIGINT) AS taken
    FROM p JOIN q ON p.source IS NOT DISTINCT FROM q.source""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.Mix(read(spark, sf_dir, "documents"), weights=(3, 1, 2), share=(3, 2), most=2, block_words=512).report()


@query("op12_spelling_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"), min_length=6, min_count=5, ratio=5)


@query("op11_hard_negatives", """
    WITH v AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.rid AS aid, a.vec_id AS anchor_id, c.vec_id AS vec_id, c.label = a.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
          FROM (SELECT min(rid) AS rid, vec_id, label, v FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id, label, v) a
          JOIN v c ON c.vec_id <> a.vec_id AND len(a.v) = len(c.v)),
    p AS (SELECT aid, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY aid ORDER BY score DESC, vec_id) AS pos_rank
          FROM s WHERE same QUALIFY pos_rank <= 5)
    SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.aid, pos_rank ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s ON p.aid = s.aid AND NOT s.same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", shifted.alias("label"))
    return hard_negatives.Mined(rows, F.col("vid") % 100 == 0, scale=256, n_positives=5, n_negatives=5, low=80).negatives().drop("pos_rank")
