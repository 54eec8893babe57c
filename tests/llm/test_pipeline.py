"""The stages of the corpus pipeline, each on all that its predecessor kept."""

import sys
from pathlib import Path

import corpus_pipeline
import pytest
from corvane.llm import mixing, pii, quality_rules, simhash
from corvane.llm.common import table, written

sys.path.insert(0, str(Path(__file__).parent))
from test_near_copies import similar_pairs  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = table(spark, sf_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        done = written(stage(spark, docs, sf_dir), name)
        out.append((docs, done))
        docs = done
    return out


def test_stages_keep_the_columns_and_act(spark, sf_dir, stages):
    for docs, done in stages[:-1]:
        assert done.columns == docs.columns == list(corpus_pipeline.COLUMNS)
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    docs, done = stages[0]
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    assert ids(done) == ids(quality_rules.annotate_quality(docs, trusted).where("kept"))
    docs, done = stages[1]
    bits = ids(simhash.near_duplicates(docs).where("doc_id = component_id"))
    rows = {r["doc_id"]: r for r in docs.collect()}
    like = similar_pairs([rows[k] for k in bits])
    gone = set(bits) - set(ids(done))
    assert set(ids(done)) <= set(bits) and not similar_pairs([rows[k] for k in ids(done)])
    assert gone and gone <= {bits[k] for pair in like for k in pair}
    docs, done = stages[2]
    assert ids(done) == ids(docs)
    assert all(not pii.base_spans(r["text"]) and len(r["text"]) == r["n_chars"] for r in done.collect())
    docs, done = stages[3]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(docs).collect()}
    assert ids(done) == sorted(k for k, n in copies.items() for _ in range(n))
    docs, done = stages[4]
    assert ids(done) == ids(docs) and all(len(r["ids"]) == r["n_tokens"] and r["library_agrees"] for r in done.collect())


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    key = lambda df: sorted((r["doc_id"], r["ids_sha256"]) for r in df.select("doc_id", "ids_sha256").collect())
    assert key(corpus_pipeline.run(spark, sf_dir)) == key(stages[4][1])


def test_stages_take_nulls_and_empty_tables(spark, sf_dir):
    schema = table(spark, sf_dir, "documents").schema
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "x y", None, None, 3)], schema)
    for docs in (odd, odd.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf_dir).collect()
