"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import mixing, near_copies, pii, quality_rules, sentencepiece_bpe, simhash
from corvane.llm.common import table, written
from corvane.llm.queries import piece_model

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality_rules.annotate_quality(docs.select(*COLUMNS), trusted).where("kept").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: fingerprints within 3 bits, then five-word shingles alike by 0.8."""
    return near_copies.keep_one(written(simhash.keep_one(docs.select(*COLUMNS)), "distinct"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by marks; n_chars follows the text."""
    done = pii.find_personal_data(docs.select(*COLUMNS), clean=True)
    done = done.withColumn("n_chars", F.when(F.col("clean_text") != F.col("text"), F.length("clean_text").cast("long")).otherwise(F.col("n_chars")))
    return done.withColumn("text", F.col("clean_text")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix_sources(docs.select(*COLUMNS)).where("copies > 0").select(F.col("doc_id").alias("_m_id"), "_m_text", "copies").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_m_id")) & (F.xxhash64("text") == F.col("_m_text"))
    rows = docs.select(*COLUMNS).join(mixed, same)
    return rows.withColumn("_m_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, their number and digests."""
    return sentencepiece_bpe.encode_decode(docs, piece_model(), keep_ids=True).drop("decoded")


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", token_stage),
]

#: SQL can't express the likelihood ratio's hashing, the fingerprints, the tagger or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
