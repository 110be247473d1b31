"""The registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gatewright.llm import covertree, decontaminate, html_extract, minhash, mixing, quality, secret_scan, substring, suffix_array, toxicity
from gatewright.sources.io import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))[0]


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination(docs, items)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxicity(docs, labels)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.repeated_spans(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_array.repeated_bytes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality(docs, labels)


QUERIES = {
    "op6_quality_classifier": op6_quality_classifier,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op5_html_extraction": op5_html_extraction,
    "op10_toxicity": op10_toxicity,
    "op9_secret_scan": op9_secret_scan,
    "op2_decontamination": op2_decontamination,
    "op3_source_mixing": op3_source_mixing,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
}

ORACLES = {
    "op8_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), g AS (
            SELECT doc_id, unnest(range(1, len(ws) - 33)) AS i, unnest(list_transform(range(1, len(ws) - 33), lambda i: md5(array_to_string(ws[i:i+34], ' ')))) AS w
            FROM d WHERE len(ws) >= 35
        ), r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY w) AS n FROM g
        ), c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r WHERE n >= 2
        ), w AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM d
        ), k AS (
            SELECT w.doc_id, count(*) AS n_words, count(c.p) AS n_removed, string_agg(word, ' ' ORDER BY w.p) FILTER (c.p IS NULL) AS kept
            FROM w LEFT JOIN c ON w.doc_id = c.doc_id AND w.p = c.p GROUP BY 1
        )
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)
    """,
    "op1_embedding_near_dedup": r"""
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0
        ), l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98
        ), r(vec_id, reached) AS (
            SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.reached
        ), c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY 1
        ), n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
        SELECT c.vec_id, coalesce(n_links, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
    """,
    "op2_decontamination": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
            FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
            FROM benchmark
        ), w AS (
            SELECT DISTINCT item_id, least(10, len(ws)) AS n, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda i: array_to_string(ws[i:i+9], ' '))) AS win
            FROM b WHERE len(ws) > 0
        ), lens AS (SELECT DISTINCT n FROM w
        ), g AS (
            SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS i, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i+n-1], ' '))) AS win
            FROM d, lens WHERE len(ws) >= n
        ), h AS (SELECT doc_id, item_id, i, g.n FROM g JOIN w ON g.win = w.win AND g.n = w.n
        ), hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1
        ), its AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY 1
        )
        SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
    """,
    "op3_source_mixing": r"""
        WITH RECURSIVE sized AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
        ), src AS (
            SELECT source, sum(size)::DOUBLE AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source
        ), rated AS (SELECT *, [5.0, 2.0, 1.0][(place % 3 + 1)::INT] AS weight FROM src
        ), fill(round, level) AS (
            SELECT 0, -1.0::DOUBLE
            UNION ALL
            SELECT round + 1, (
                SELECT (sum(source_size) - sum(CASE WHEN 3 * source_size <= level * weight THEN 3 * source_size ELSE 0 END))
                    / nullif(sum(CASE WHEN 3 * source_size <= level * weight THEN 0 ELSE weight END), 0) FROM rated)
            FROM fill WHERE level IS NOT NULL AND round < 40
        ), goal AS (
            SELECT source, place, source_size, least(3 * source_size, (SELECT max(level) FROM fill) * weight) AS target FROM rated
        ), laid AS (
            SELECT doc_id, size, source_size, target,
                coalesce(sum(size) OVER (PARTITION BY place ORDER BY md5(doc_id::VARCHAR || ':17') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_word
            FROM sized JOIN goal ON sized.source IS NOT DISTINCT FROM goal.source
        )
        SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
            (SELECT sum(greatest(0, least(size, round(target) - at_word - e * source_size)))
                FROM unnest([0, 1, 2]) AS u(e))::BIGINT AS taken
        FROM laid
    """,
    "op4_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
            FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4
                THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))
                WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g
            FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
        ), p AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), l AS (
            SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
        ), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
        ), r(doc_id, reached) AS (
            SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached
        ), c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY 1)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
        FROM w JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
    """,
}
