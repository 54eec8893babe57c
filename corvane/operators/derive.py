"""Manifest rows from judged rollouts, of all sources in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.operators import joins, manifest

#: The manifest's columns and types, in order.
MANIFEST = {
    "rollout_id": "string", "question_id": "string", "dataset": "string", "dataset_split": "string", "original_index": "long", "subject_model": "string", "subject_model_id": "string", "run": "string",
    "hint_style": "string", "case": "string", "target_option": "string", "groundtruth": "string", "baseline_modal_answer": "string", "baseline_stability": "byte", "baseline_n_samples": "byte", "baseline_hint_votes": "byte",
    "model_answer": "string", "changed": "boolean", "to_hint": "boolean", "judge_model": "string", "judge_prompt": "string", "judge_label": "byte", "judge_confidence": "double", "judge_role": "string", "hint_quote": "string",
    "judge_label_final": "byte", "judge_label_final_model": "string", "trace_token_len": "long", "truncated": "boolean", "max_tokens_used": "long", "exclude_reason": "string", "split": "string", "source_csv": "string",
}
#: What a judged source holds, what its judge needed, the baseline status that a case is selected on, what starts an answer.
JUDGED = "original_index sample_type hint_name hinted_answer baseline_answer groundtruth rollout reasoning final_answer judge_model judge_label judge_confidence judge_role judge_hint_quote".split()
JUDGE_INPUTS = ("prompt", "reasoning")
CASE_STATUS = {"positive": "correct", "negative": "incorrect"}
MARKER = r"(?i)<answer>|\\boxed\{|[\"']answer[\"']\s*:"
ROLES = ("none", "neutral", "verification_only", "rejected", "credited")
#: What a source contributes to each of its rows.
PAIR = "subject_model subject_model_id run dataset dataset_split judge_prompt max_tokens baseline_n_samples degraded".split()


def input_degraded(columns: list[str]) -> bool:
    """Whether a source with these columns was judged without what the judge needs."""
    return not set(JUDGE_INPUTS) <= set(columns)


def dataset_identity(name: Column, config: Column, split: Column) -> tuple[Column, Column]:
    """(dataset, dataset_split): the split is written config/split where there is a config, which of gpqa is gpqa_diamond if unsaid."""
    known = F.coalesce(F.nullif(config, F.lit("")), F.when(name == "gpqa", "gpqa_diamond"))
    return F.coalesce(name, F.lit("")), F.concat(F.coalesce(F.concat(known, F.lit("/")), F.lit("")), F.coalesce(split, F.lit("")))


def baseline_votes(rows: DataFrame) -> DataFrame:
    """(source_csv, original_index, n_top_votes, sample_answers, baseline_status, has_status): the first row of each question, by seq.

    Columns that a source lacks are null; has_status tells whether any question of the source has a status.
    """
    for c in ("n_top_votes", "sample_answers", "baseline_status"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    kept = F.struct("n_top_votes", "sample_answers", "baseline_status")
    first = rows.groupBy("source_csv", "original_index").agg(F.min_by(kept, "seq").alias("b"))
    status = rows.groupBy("source_csv").agg(F.max(F.col("baseline_status").isNotNull()).alias("has_status"))
    return first.select("source_csv", "original_index", "b.*").join(status, "source_csv")  # sources may be as many as rows: Spark broadcasts them where they are few


def _letter(c: str) -> Column:
    return F.nullif(F.upper(F.trim(F.col(c))), F.lit(""))


def _filled(c: str) -> Column:
    return F.when(F.trim(F.col(c)) != "", F.col(c))


def derive_rows(judged: DataFrame, pairs: DataFrame, baseline: DataFrame, *, token_len: Callable[[Column], Column] | None = None, min_votes: int | None = 1, close: str = "</think>", open_mark: str = "<think>") -> DataFrame:
    """The manifest's rows, in its columns and types.

    ``judged``: source_csv and the columns of JUDGED, of which missing ones are null.  ``pairs``: one row a source_csv with the columns
    of PAIR, ``degraded`` boolean.  ``baseline``: ``baseline_votes``; sources without one have no votes and are not checked for relabelled questions,
    in sources with statuses a question that the baseline lacks counts as relabelled.  ``token_len`` makes a trace's length.
    """
    for c in JUDGED:
        if c not in judged.columns:
            judged = judged.withColumn(c, F.lit(None).cast("string"))
    rollout = F.coalesce(F.col("rollout"), F.lit(""))
    trace = F.coalesce(_filled("reasoning"), text.extract_cot(rollout, open_mark, close))
    # what is made of texts is made first, so that no shuffle holds them
    read = {"_cut": F.when(F.trim(rollout) == "", True).otherwise(text.extract_cot(rollout, open_mark, close) == ""), "_marker": rollout.rlike(MARKER), "_len": token_len(trace) if token_len else F.lit(None).cast("long")}
    judged = judged.select("source_csv", *[c for c in JUDGED if c not in ("rollout", "reasoning")], *[v.alias(k) for k, v in read.items()])
    with_status = baseline.groupBy("source_csv").agg(F.max("has_status").alias("has_status"))
    rows = joins.checked_join(judged, pairs.select("source_csv", *PAIR), ["source_csv"], every_left=True, name="sources")
    rows = rows.join(with_status, "source_csv", "left")
    rows = joins.checked_join(rows, baseline.drop("has_status"), ["source_csv", "original_index"], name="baseline")
    label = F.col("judge_label").try_cast("double").cast("byte")
    answer, before, target = F.col("final_answer"), F.col("baseline_answer"), F.col("hinted_answer")
    expected = F.coalesce(*[F.when(F.col("sample_type") == k, v) for k, v in CASE_STATUS.items()])
    made = {
        "rollout_id": text.joined_id(F.col("subject_model"), F.col("run"), F.col("hint_name"), F.col("original_index")), "question_id": text.joined_id(F.col("dataset"), F.col("dataset_split"), F.col("original_index")),
        "hint_style": F.col("hint_name"), "case": F.col("sample_type"), "target_option": _letter("hinted_answer"), "groundtruth": _letter("groundtruth"), "baseline_modal_answer": _letter("baseline_answer"),
        "baseline_stability": F.col("n_top_votes").try_cast("double"), "baseline_hint_votes": manifest.hint_votes(F.col("sample_answers"), _letter("hinted_answer")), "model_answer": _letter("final_answer"),
        "changed": manifest.changed(answer, before), "to_hint": manifest.outcome(answer, before, target) == "switched", "judge_model": F.when(label.isNotNull(), _filled("judge_model")),
        "judge_prompt": F.when(label.isNotNull(), F.col("judge_prompt")), "judge_label": label, "judge_confidence": F.col("judge_confidence").try_cast("double"), "judge_role": F.when(F.col("judge_role").isin(*ROLES), F.col("judge_role")),
        "hint_quote": _filled("judge_hint_quote"), "judge_label_final": label, "judge_label_final_model": F.when(label.isNotNull(), _filled("judge_model")), "trace_token_len": F.col("_len"), "truncated": F.col("_cut"),
        "max_tokens_used": F.col("max_tokens"), "split": F.lit(None), "is_resample": F.lit(False), "_marker": F.col("_marker"),
        "_relabelled": F.coalesce(F.col("has_status"), F.lit(False)) & ~F.col("baseline_status").eqNullSafe(expected),
    }
    rows = rows.select("source_csv", "original_index", "dataset", "dataset_split", "subject_model", "subject_model_id", "run", "baseline_n_samples", "degraded", *[v.alias(k) for k, v in made.items()])
    rows = rows.withColumn("exclude_reason", manifest.exclude_reason(min_votes, has_marker=F.col("_marker"), relabelled=F.col("_relabelled"), degraded=F.coalesce(F.col("degraded"), F.lit(False))))
    return rows.select(*[F.col(c).cast(t).alias(c) for c, t in MANIFEST.items()])
