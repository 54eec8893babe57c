"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import filter_audit, html_extract, license_scan, mixing, pii, quality_fm, quality_rules, sentencepiece_bpe, simhash, substring_dedup, topk_search, url_filter, whitening
from corvane.llm.common import table

#: The tokenizer's file among the public ones; the path is looked up where the query runs.
PIECES = "piece_bpe_32k.model"


def piece_model(name: str = PIECES) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_decode(table(spark, sf_dir, "documents"), piece_model())


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op6_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_fm.score_quality(docs, quality_fm.train(docs, table(spark, sf_dir, "labels")))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search.top_k(vectors, F.col("vec_id") % 50 == 0, 5)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    done = quality_rules.annotate_quality(docs.select("doc_id", "text", "lang"), labels.where("quality = 1"))
    return done.drop("text", "lang")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS i, words FROM d WHERE len(words) >= 20),
h AS (SELECT doc_id, i, array_to_string(words[i : i + 19], ' ') AS seq FROM w),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY seq ORDER BY doc_id, i) AS k FROM h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r WHERE k > 1),
lost AS (SELECT doc_id, list(p) AS places FROM gone GROUP BY doc_id),
kept AS (SELECT d.doc_id, d.words, coalesce(lost.places, []) AS places FROM d LEFT JOIN lost ON d.doc_id = lost.doc_id),
word AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM d),
left_over AS (SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.p) AS text FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p
              WHERE gone.p IS NULL GROUP BY word.doc_id)
SELECT kept.doc_id, CAST(len(kept.words) AS BIGINT) AS n_words, CAST(len(kept.places) AS BIGINT) AS n_removed, sha256(coalesce(left_over.text, '')) AS kept_sha256
FROM kept LEFT JOIN left_over ON kept.doc_id = left_over.doc_id
"""

OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_substring_dedup, op3_simhash, op4_license_scan, op5_mixing, op6_quality_fm, op7_topk, op8_pii, op9_html, op10_quality_rules, op11_whitening, op12_url_filters, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": OP2_SQL, "op7_topk": OP7_SQL, "op12_url_filters": url_filter.sql(), "op13_filter_audit": filter_audit.SQL}
