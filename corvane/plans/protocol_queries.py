"""Queries of checked joins: the single-sample protocol's stitch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import derive, protocols
from corvane.plans.adapters import ROLLOUTS, WITH_REL, rollouts, table
from corvane.plans.core_queries import base, pairs, query

#: The binary judge saw most of the rows, some of them with another answer or target, and rows that the manifest lacks; the baseline lacks some questions.
STITCH = (
    WITH_REL
    + """, m AS (SELECT * FROM r WHERE trace_token_len % 13 <> 0),
b AS (SELECT rollout_id, CASE WHEN trace_token_len % 17 = 0 THEN 'J' ELSE lower(target_option) END AS bin_target, CASE WHEN trace_token_len % 19 = 0 THEN NULL ELSE ' ' || model_answer END AS bin_final_answer, groundtruth AS bin_groundtruth, judge_label AS binary_judge_label FROM r WHERE trace_token_len % 11 <> 0),
q AS (SELECT question_id, min(groundtruth) AS bl_groundtruth, min(baseline_modal_answer) AS bl_modal_answer FROM r WHERE original_index % 23 <> 0 GROUP BY ALL),
l AS (SELECT source_rollout_id, reliance_label FROM rel),
s AS (SELECT m.*, b.rollout_id AS b_id, q.question_id AS q_id, b.* EXCLUDE (rollout_id), q.* EXCLUDE (question_id), l.reliance_label FROM m FULL JOIN b ON m.rollout_id = b.rollout_id LEFT JOIN q ON m.question_id = q.question_id LEFT JOIN l ON m.source_rollout_id = l.source_rollout_id)"""
)


def stitched(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = base(spark, sf_dir)
    every = lambda c, n: F.col("trace_token_len") % n == 0
    binary = r.where("trace_token_len % 11 <> 0").select(
        "rollout_id", F.when(every("t", 17), "J").otherwise(F.lower("target_option")).alias("bin_target"),
        F.when(~every("t", 19), F.concat(F.lit(" "), "model_answer")).alias("bin_final_answer"), F.col("groundtruth").alias("bin_groundtruth"), F.col("judge_label").alias("binary_judge_label"),
    )
    baseline = r.where("original_index % 23 <> 0").groupBy("question_id").agg(F.min("groundtruth").alias("bl_groundtruth"), F.min("baseline_modal_answer").alias("bl_modal_answer"))
    reliance = pairs(r).select("source_rollout_id", "reliance_label")
    return protocols.stitch(r.where("trace_token_len % 13 <> 0"), binary, baseline, reliance, row=["rollout_id"], question=["question_id"], pair=["source_rollout_id"])


@query(STITCH + "SELECT rollout_id, binary_judge_label, bl_modal_answer, reliance_label FROM s WHERE rollout_id IS NOT NULL")
def ssp_stitch(spark, sf_dir):
    return stitched(spark, sf_dir).where("in_manifest").select("rollout_id", "binary_judge_label", "bl_modal_answer", "reliance_label")


def _differ(name: str, a: str, b: str) -> str:
    return f"count(*) FILTER (WHERE rollout_id IS NOT NULL AND upper(trim({a})) IS DISTINCT FROM upper(trim({b}))) AS mismatch_{name}"


@query(
    STITCH
    + f"""SELECT subject_model, count(rollout_id) AS manifest_rows, count(*) FILTER (WHERE rollout_id IS NOT NULL AND b_id IS NULL) AS missing_in_binary, count(*) FILTER (WHERE rollout_id IS NOT NULL AND q_id IS NULL) AS missing_in_baseline,
count(*) FILTER (WHERE rollout_id IS NULL) AS binary_rows_not_in_manifest, {', '.join(_differ(*x) for x in protocols.AGREE)} FROM s GROUP BY ALL"""
)
def stitch_checks(spark, sf_dir):
    return protocols.stitch_checks(stitched(spark, sf_dir), ["subject_model"])


# ---------------------------------------------------------------- manifest rows

#: Of a rollout's number n: its text, by which answers are marked, cut or missing; letters as they come, in small letters or with blanks.
TEXTS = ("'<think>why</think><answer>' || a || '</answer>'", "'<think>cut off'", "'<think>why</think>I say \"answer\": maybe'", "'<think>why</think>no idea'", "NULL", "'<think>why</think>\\boxed{' || a || '}'")
ANSWER = "CASE WHEN n % 6 IN (0, 5) THEN ' ' || lower(model_answer) END"
LABEL = "CASE n % 7 WHEN 0 THEN '-1.0' WHEN 1 THEN '0' WHEN 2 THEN '1' WHEN 3 THEN 'x' WHEN 4 THEN NULL ELSE '0.0' END"
STATUS = "CASE WHEN original_index % 9 = 0 THEN NULL WHEN supp % 2 = 0 THEN 'correct' ELSE 'incorrect' END"
SAMPLES = "CASE WHEN original_index % 10 = 3 THEN '[\"A\", ' ELSE '[\"a\", \" B\", null, \"C\", \"A\", 7]' END"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rollouts(spark, sf_dir).withColumns({"n": F.col("trace_token_len"), "supp": F.expr("cast(split(rollout_id, ':')[2] as int)"), "part": F.expr("cast(split(rollout_id, ':')[1] as int)")})
    # one row a source and question: sources are told apart by what else names a row
    return r.withColumns({"source_csv": F.expr("concat(subject_model, '_', run, '_', part, '_', supp, '_', split(rollout_id, ':')[3], '_', split(rollout_id, ':')[4])"), "a": F.coalesce("model_answer", F.lit("?"))})


def manifest_rows_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _judged(spark, sf_dir)
    texts = F.expr("CASE n % 6 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(TEXTS)).replace("\\boxed", "\\\\boxed") + " END")
    judged = r.select(
        "source_csv", "original_index", F.col("case").alias("sample_type"), F.col("hint_style").alias("hint_name"), F.lower("target_option").alias("hinted_answer"), F.col("baseline_modal_answer").alias("baseline_answer"), "groundtruth",
        texts.alias("rollout"), F.expr(ANSWER).alias("final_answer"), F.when(F.col("n") % 4 > 0, "judge-1").otherwise(" ").alias("judge_model"), F.expr(LABEL).alias("judge_label"), F.lit("0.5").alias("judge_confidence"),
        F.when(F.col("n") % 3 > 0, "credited").otherwise("odd").alias("judge_role"), F.when(F.col("n") % 5 > 0, "said").otherwise("").alias("judge_hint_quote"),
    )
    sources = r.select("source_csv", "subject_model", F.lit(None).cast("string").alias("subject_model_id"), "run", F.lit("gpqa").alias("d"), F.lit("p1").alias("judge_prompt"), F.lit(4096).alias("max_tokens"), F.lit(8).alias("baseline_n_samples"), (F.col("part") % 11 == 0).alias("degraded"))
    name, split = derive.dataset_identity(F.col("d"), F.lit(None).cast("string"), F.lit("train"))
    pairs = sources.withColumns({"dataset": name, "dataset_split": split}).drop("d")
    votes = r.where("part % 5 <> 0 and original_index % 8 <> 0").select("source_csv", "original_index", F.explode(F.array(F.lit(0), F.lit(1))).alias("seq"), F.expr(STATUS).alias("baseline_status"), F.expr(SAMPLES).alias("sample_answers"), "supp")
    votes = votes.select("source_csv", "original_index", "seq", F.when(F.col("seq") == 0, F.col("baseline_status")).otherwise(F.lit("correct")).alias("baseline_status"), "sample_answers", F.when(F.col("seq") == 0, (4 + F.col("supp") % 5).cast("string")).otherwise("1").alias("n_top_votes"))
    return derive.derive_rows(judged, pairs, derive.baseline_votes(votes), token_len=F.length)


_TEXTS_SQL = "CASE n % 6 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(TEXTS)) + " END"


@query(
    f"""WITH r AS (SELECT *, trace_token_len AS n, CAST(split_part(rollout_id, ':', 2) AS INTEGER) AS part, CAST(split_part(rollout_id, ':', 3) AS INTEGER) AS supp, coalesce(model_answer, '?') AS a FROM ({ROLLOUTS})),
j AS (SELECT *, upper(trim({ANSWER})) AS ans, {LABEL} AS lb, {_TEXTS_SQL} AS t, part % 5 <> 0 AND original_index % 8 <> 0 AS voted, {STATUS} AS st, {SAMPLES} AS sa FROM r),
k AS (SELECT *, CAST(try_cast(lb AS DOUBLE) AS INTEGER) AS label, ans IS NOT NULL AND ans <> baseline_modal_answer AS changed, coalesce(ans <> baseline_modal_answer AND ans = target_option, FALSE) AS to_hint,
  CASE WHEN voted AND original_index % 10 <> 3 THEN CASE target_option WHEN 'A' THEN 2 WHEN 'B' THEN 1 WHEN 'C' THEN 1 ELSE 0 END END AS votes, n % 6 IN (1, 4) AS cut FROM j)
SELECT subject_model || ':' || run || ':' || hint_style || ':' || original_index AS rollout_id, 'gpqa:gpqa_diamond/train:' || original_index AS question_id, target_option, ans AS model_answer, changed, to_hint, cut AS truncated,
CASE WHEN voted THEN 4 + supp % 5 END AS baseline_stability, votes AS baseline_hint_votes, label AS judge_label, CASE WHEN label IS NOT NULL AND n % 4 > 0 THEN 'judge-1' END AS judge_model, CASE WHEN label IS NOT NULL THEN 'p1' END AS judge_prompt,
CASE WHEN n % 3 > 0 THEN 'credited' END AS judge_role, CASE WHEN n % 5 > 0 THEN 'said' END AS hint_quote, CASE WHEN n % 6 IN (1, 4) THEN 0 ELSE 3 END AS trace_token_len,
CASE WHEN voted AND st IS DISTINCT FROM CASE "case" WHEN 'positive' THEN 'correct' ELSE 'incorrect' END THEN 'baseline_relabelled' WHEN part % 11 = 0 THEN 'judge_input_degraded' WHEN cut THEN 'truncated'
 WHEN ans IS NULL THEN CASE WHEN n % 6 IN (0, 2, 5) THEN 'parse_fail' ELSE 'unanswered' END WHEN label = -1 THEN 'incoherent' WHEN to_hint AND votes >= 1 THEN 'noise_flip' END AS exclude_reason FROM k"""
)
def manifest_rows(spark, sf_dir):
    columns = "rollout_id question_id target_option model_answer changed to_hint truncated baseline_stability baseline_hint_votes judge_label judge_model judge_prompt judge_role hint_quote trace_token_len exclude_reason".split()
    return manifest_rows_of(spark, sf_dir).select(*columns)
