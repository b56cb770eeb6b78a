"""One query for each operator over its whole table, and the same in DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsieve.llm import (
    byte_bpe,
    decontaminate,
    dual_tree,
    jaccard_join,
    lang_id,
    license_templates,
    lm_scoring,
    pii,
    quality,
    topk_search,
    url_rules,
    warc,
    whitening,
)
from cellsieve.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search.exact_topk(vectors, vectors.where("vec_id % 100 = 0"), 10)


ORACLES["op10_exact_topk"] = """
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 10
"""


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_pages(spark, table(spark, sf_dir, "pages")).where("record_type IS NOT NULL")
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).cast("long")
    return records.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )


ORACLES["op9_warc"] = """
WITH p AS (
    SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
    FROM pages
), r AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM r
"""


@query
def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"))


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_templates.scan_licenses(table(spark, sf_dir, "documents"))


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), verbatim=True)


@query
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90)


ORACLES["op1_jaccard_join"] = r"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS f
    FROM texts
), sizes AS (SELECT doc_id, len(f) AS n FROM sets),
each AS (SELECT doc_id, unnest(f) AS g FROM sets),
pairs AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM each a JOIN each b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
    SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * shared >= 90 * (p.n + q.n - shared)
), ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
    SELECT doc_id, doc_id AS r FROM sizes
    UNION
    SELECT reach.doc_id, ways.y FROM reach JOIN ways ON ways.x = reach.r
)
SELECT doc_id, any_value(n) AS n_shingles, min(r) AS component_id FROM reach JOIN sizes USING (doc_id) GROUP BY doc_id
"""


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(table(spark, sf_dir, "documents"))


@query
def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"))


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=16)


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.lexical_topk(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


ORACLES["op11_lexical_search"] = r"""
WITH doc_terms AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents
), docs AS (
    SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, w FROM doc_terms WHERE len(w) > 0
), total AS (
    SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM docs
), item_terms AS (
    SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), counts AS (
    SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs)
    WHERE term IN (SELECT term FROM item_terms) GROUP BY ALL
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM counts, total GROUP BY term
), impacts AS (
    SELECT r, term, weights.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // terms)))) AS impact
    FROM counts JOIN weights USING (term) JOIN docs USING (r), total
), scored AS (
    SELECT i, item_id, r, CAST(sum(impact) AS BIGINT) AS score FROM item_terms JOIN impacts USING (term) GROUP BY ALL
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (
    SELECT i, item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank
    FROM scored JOIN docs USING (r) WHERE score > 0
) WHERE rank <= 10
"""


@query
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(table(spark, sf_dir, "documents"))
