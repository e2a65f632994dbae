"""Queries of this subpackage: each applies one operator to its whole table and returns its full result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillmark.llm import embedding_dedup, fingerprints, html_text, mixing, near_dedup, packing, quality, secrets, token_output, toxicity
from quillmark.llm.common import table

VOCABULARY = "word_bpe_49k.json"


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.linked_vectors(table(spark, sf_dir, "embeddings"), least=0.93)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.clusters(table(spark, sf_dir, "documents"), size=4, threshold=0.8)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_packing": op2_packing,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_fingerprints": op4_fingerprints,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_mixing": op6_mixing,
    "op7_token_output": op7_token_output,
    "op8_secret_scan": op8_secret_scan,
    "op9_near_dedup": op9_near_dedup,
    "op10_toxicity": op10_toxicity,
}

SQL: dict[str, str] = {
    "op3_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: x::double) AS e FROM embeddings
        ), able AS (
            SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL
            AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0
        ), links AS (
            SELECT a.vec_id AS u, b.vec_id AS v FROM able a JOIN able b
            ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
        ), reach(u, v) AS (
            SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u
        ), part AS (SELECT u, min(v) AS c FROM reach GROUP BY u), degree AS (SELECT u, count(*) AS n FROM links GROUP BY u)
        SELECT e.vec_id, coalesce(n, 0)::bigint AS n_links, c AS component_id, e.vec_id = c AS kept
        FROM embeddings e JOIN part ON part.u = e.vec_id LEFT JOIN degree ON degree.u = e.vec_id
    """,
    "op9_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), s AS (
            SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS s FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), c AS (
            SELECT doc_id, n, sum(hash(s)) AS digest FROM s JOIN n USING (doc_id) GROUP BY ALL
        ), k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY n, digest) AS rep, n FROM c), r AS (SELECT DISTINCT rep, n FROM k),
        links AS (
            SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN r x ON x.rep = a.doc_id JOIN r y ON y.rep = b.doc_id
            GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
        ), reach(u, v) AS (SELECT rep, rep FROM r UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u),
        part AS (SELECT u, min(v) AS c FROM reach GROUP BY u)
        SELECT d.doc_id, coalesce(k.n, 0)::bigint AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
        FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN part ON part.u = k.rep
    """,
}
