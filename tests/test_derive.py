"""Manifest rows: every reason, the schema, missing columns; ids and chi-square totals that must not slip."""

import pytest
from corvane.functions import tails, text
from corvane.operators import derive, manifest
from corvane.plans import protocol_queries
from pyspark.sql import functions as F


def test_every_reason_is_reached_and_the_schema_holds(spark, sf_dir):
    rows = protocol_queries.manifest_rows_of(spark, sf_dir)
    assert rows.dtypes == [(c, {"long": "bigint", "byte": "tinyint"}.get(t, t)) for c, t in derive.MANIFEST.items()] and len(rows.columns) == 33
    assert {r[0] for r in rows.select("exclude_reason").distinct().collect()} == {None, *manifest.EXCLUDE_REASONS}


def test_few_columns_and_no_baseline(spark):
    judged = spark.createDataFrame([("s", 1, "negative", "authority", "b", "A", "b", "<think>x</think><answer>B</answer>", "b"), ("s", 2, "negative", "authority", "b", "A", "b", None, None)], "source_csv string, original_index long, sample_type string, hint_name string, hinted_answer string, baseline_answer string, groundtruth string, rollout string, final_answer string")
    pairs = spark.createDataFrame([("s", "m", None, "run", "mmlu", "all/test", "p", 100, None, None)], "source_csv string, subject_model string, subject_model_id string, run string, dataset string, dataset_split string, judge_prompt string, max_tokens long, baseline_n_samples int, degraded boolean")
    none = derive.baseline_votes(spark.createDataFrame([], "source_csv string, original_index long, seq long"))
    got = {r["original_index"]: r for r in derive.derive_rows(judged, pairs, none).collect()}
    one, two = got[1], got[2]
    assert (one["rollout_id"], one["question_id"], one["to_hint"], one["changed"], one["exclude_reason"], one["judge_label"], one["baseline_stability"]) == ("m:run:authority:1", "mmlu:all/test:1", True, True, None, None, None)
    assert two["truncated"] and two["exclude_reason"] == "truncated" and two["judge_prompt"] is None
    with pytest.raises(Exception, match="no partner right for source_csv=s"):
        derive.derive_rows(judged, pairs.where("false"), none).collect()
    # a source with statuses: a question that the baseline lacks is relabelled
    votes = derive.baseline_votes(spark.createDataFrame([("s", 1, 0, "incorrect", '["B", "b"]'), ("s", 1, 1, "correct", "[]")], "source_csv string, original_index long, seq long, baseline_status string, sample_answers string"))
    got = {r["original_index"]: r for r in derive.derive_rows(judged, pairs, votes).collect()}
    assert (got[1]["exclude_reason"], got[1]["baseline_hint_votes"]) == ("noise_flip", 2) and got[2]["exclude_reason"] == "baseline_relabelled"
    assert derive.derive_rows(judged, pairs, votes, min_votes=None).where("original_index = 1").first()["exclude_reason"] is None


def test_input_degraded_and_identity(spark):
    assert derive.input_degraded(["prompt"]) and not derive.input_degraded(["reasoning", "x", "prompt"])
    df = spark.createDataFrame([("gpqa", None, "train"), ("gpqa", "gpqa_main", "train"), ("medqa", "", "test"), (None, None, None)], "n string, c string, s string").coalesce(1)
    assert [tuple(r) for r in df.select(*derive.dataset_identity(F.col("n"), F.col("c"), F.col("s"))).collect()] == [("gpqa", "gpqa_diamond/train"), ("gpqa", "gpqa_main/train"), ("medqa", "test"), ("", "")]


def test_ids_keep_the_place_of_a_missing_part(spark):
    df = spark.createDataFrame([("a", None, 1), (None, "a", 1)], "x string, y string, z long").coalesce(1)
    assert [r[0] for r in df.select(text.joined_id(F.col("x"), F.col("y"), F.col("z"))).collect()] == ["a:None:1", "None:a:1"]


def test_totals_that_differ_fail(spark):
    cells = spark.createDataFrame([("g", 3, 4.0), ("g", 5, 4.0)], "g string, o long, e double")
    assert tails.pearson(cells, "o", "e", ["g"]).first()["stat"] == 0.5
    for bad in (cells.withColumn("e", F.col("e") + 1), cells.withColumn("e", F.when(F.col("o") == 3, 0.0).otherwise(8.0))):
        with pytest.raises(Exception, match="totals differ|not positive"):
            tails.pearson(bad, "o", "e", ["g"]).collect()


def test_sources_as_many_as_rows_are_not_broadcast(spark, sf_dir):
    plan = protocol_queries.manifest_rows(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan
