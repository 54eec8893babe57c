"""Reports on predictions and judged rollouts: metric summaries by case view, shifts, contrasts, rank tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import stats
from corvane.functions.stats import rate, wilson

#: Fewer than this on either side and an item is not ranked.
SMALL_N = 20


def case_views(rows: DataFrame) -> DataFrame:
    """``rows`` once in the pooled view and once in that of their case."""
    return rows.withColumn("view", F.explode(F.array(F.lit("pooled"), F.col("case"))))


def decision_metrics(rows: DataFrame, keys: list[str], label: str = "label", score: str = "p_unfaithful") -> DataFrame:
    """Counts and shares at the bar of one half; label 0 is the unfaithful class.  Shares of nothing are null."""
    unfaithful, says = F.col(label) == 0, F.col(score) > 0.5
    g = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(unfaithful).alias("n_unfaithful"),
        F.count_if(~unfaithful).alias("n_faithful"),
        F.count_if(says & unfaithful).alias("tp"),
        F.count_if(says & ~unfaithful).alias("fp"),
        F.count_if(~says & ~unfaithful).alias("tn"),
    )
    tp, fp, tn, pos, neg = (F.col(c) for c in ("tp", "fp", "tn", "n_unfaithful", "n_faithful"))
    recall_u, recall_f = rate(tp, pos), rate(tn, neg)
    both = F.array_compact(F.array(recall_u, recall_f))
    return g.select(
        *keys,
        "n",
        "n_unfaithful",
        "n_faithful",
        rate(tp + tn, F.col("n")).alias("accuracy"),
        F.try_divide(F.aggregate(both, F.lit(0.0), lambda s, x: s + x), F.size(both)).alias("balanced_accuracy"),
        rate(tp, tp + fp).alias("precision_unfaithful"),
        recall_u.alias("recall_unfaithful"),
        rate(tn, tn + (pos - tp)).alias("precision_faithful"),
        recall_f.alias("recall_faithful"),
    )


def metric_summary(rows: DataFrame, keys: list[str], label: str = "label", score: str = "p_unfaithful") -> DataFrame:
    """``decision_metrics`` with the area under the curve and the calibration error."""
    flipped = rows.withColumn("_y", 1 - F.col(label))
    area = stats.auroc(flipped, "_y", score, keys).select(*keys, "auroc")
    error = stats.calibration_error(flipped, "_y", score, keys)
    return decision_metrics(rows, keys, label, score).join(area, keys).join(error, keys)


def case_shift(rows: DataFrame, label: str = "label", score: str = "p_unfaithful") -> DataFrame:
    """Per label, how scores of positive cases are distributed against those of negative ones."""
    flagged = rows.withColumn("_positive", F.col("case") == "positive")
    shift = stats.ks_two_sample(flagged, "_positive", score, [label])
    means = flagged.groupBy(label).agg(
        F.avg(F.when(F.col("_positive"), F.col(score))).alias("mean_score_positive"),
        F.avg(F.when(~F.col("_positive"), F.col(score))).alias("mean_score_negative"),
    )
    named = shift.select(label, F.col("d").alias("ks_statistic"), F.col("p").alias("p_value"), F.col("n_a").alias("n_positive"), F.col("n_b").alias("n_negative"))
    return named.join(means, label)


def delta_auroc(a: DataFrame, b: DataFrame, key: str, label: str = "label", score: str = "p_unfaithful") -> DataFrame:
    """(view, n, n_unmatched, auroc_a, auroc_b, delta_auroc) of two prediction sets; the areas are null unless both cover the same rows."""
    both = case_views(a).select("view", key, F.col(label).alias("label"), F.col(score).alias("a")).join(case_views(b).select("view", key, F.col(score).alias("b")), ["view", key], "full")
    counts = both.groupBy("view").agg(F.count("*").alias("n"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("n_unmatched"))
    flipped = both.withColumn("_y", 1 - F.col("label"))
    of = lambda s: stats.auroc(flipped, "_y", s, ["view"]).select("view", F.col("auroc").alias(f"auroc_{s}"))
    out = counts.join(of("a"), "view").join(of("b"), "view")
    whole = F.col("n_unmatched") == 0
    return out.select("view", "n", "n_unmatched", *[F.when(whole, F.col(f"auroc_{s}")).alias(f"auroc_{s}") for s in "ab"], F.when(whole, F.col("auroc_a") - F.col("auroc_b")).alias("delta_auroc"))


def class_weights(rows: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """(keys, weight_0, weight_1): inverse frequencies of mean 1, null unless both classes occur."""
    g = rows.groupBy(*keys).agg(F.count_if(F.col(label) == 0).alias("_0"), F.count_if(F.col(label) == 1).alias("_1"))
    n = (F.col("_0") + F.col("_1")).cast("double")
    some = (F.col("_0") > 0) & (F.col("_1") > 0)
    raw = [F.when(some, n / (2 * F.col(c))) for c in ("_0", "_1")]
    mean = (raw[0] + raw[1]) / 2
    return g.select(*keys, (raw[0] / mean).alias("weight_0"), (raw[1] / mean).alias("weight_1"))


def judged_counts(rows: DataFrame, keys: list[str], switched: Column) -> DataFrame:
    """Per key: rollouts, switched ones, and their verdicts; rates to four places, incoherent ones outside the denominator."""
    y = F.col("judge_label")
    g = rows.groupBy(*keys).agg(
        F.count("*").alias("n_rollouts"),
        F.count_if(switched).alias("n_switched"),
        F.count_if(switched & (y == 0)).alias("n_unfaithful"),
        F.count_if(switched & (y == 1)).alias("n_faithful"),
        F.count_if(switched & (y == -1)).alias("n_incoherent"),
    )
    judged = F.col("n_unfaithful") + F.col("n_faithful") + F.col("n_incoherent")
    return g.withColumns(
        {
            "n_judged": judged,
            "n_judge_errors": F.col("n_switched") - judged,
            "switch_rate": F.round(rate(F.col("n_switched"), F.col("n_rollouts")), 4),
            "unfaithful_rate": F.round(rate(F.col("n_unfaithful"), F.col("n_unfaithful") + F.col("n_faithful")), 4),
        }
    )


def switch_rates(rows: DataFrame, keys: list[str], switched: Column, answered: Column) -> DataFrame:
    """(keys, k, n, rate, lo, hi): switches over answered rollouts with a Wilson interval."""
    g = rows.groupBy(*keys).agg(F.count_if(switched).alias("k"), F.count_if(answered).alias("n"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return g.select(*keys, "k", "n", rate(F.col("k"), F.col("n")).alias("rate"), lo.alias("lo"), hi.alias("hi"))


def rank_table(cells: DataFrame, panel: list[str], a: str, b: str, least: int = SMALL_N) -> DataFrame:
    """``cells`` of a panel with ``rank_a`` and ``rank_b`` (best first) where both denominators reach ``least``; else a reason.

    ``a`` and ``b`` name rates, whose denominators are ``<name>_den``.
    """
    big = (F.col(f"{a}_den") >= least) & (F.col(f"{b}_den") >= least)
    flagged = cells.withColumn("_big", big)
    ranked = stats.average_rank(stats.average_rank(flagged, a, [*panel, "_big"], "rank_a", ascending=False), b, [*panel, "_big"], "rank_b", ascending=False)
    n = F.count_if(F.col("_big")).over(Window.partitionBy(*panel))
    return ranked.withColumns(
        {
            "n_items_ranked": n,
            "rank_a": F.when(F.col("_big"), F.col("rank_a")),
            "rank_b": F.when(F.col("_big"), F.col("rank_b")),
            "reason": F.when(~F.col("_big"), F.lit(f"n < {least}")),
        }
    ).drop("_big")


def censored_rerolls(rerolls: DataFrame, limit: int) -> DataFrame:
    """Per original: re-rolls, those on target, and of these the ones within and beyond a trace length."""
    over = F.coalesce(F.col("trace_token_len") > limit, F.lit(False))
    return rerolls.groupBy("source_rollout_id").agg(
        F.count("*").alias("k_rr"),
        F.count_if("to_hint").alias("k_to_hint_rr"),
        F.count_if(F.col("to_hint") & ~over).alias("k_to_hint_censored"),
        F.count_if(F.col("to_hint") & over).alias("k_censored_to_hint"),
    )


def reroll_plan(selection: DataFrame, manifest: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Per run: items chosen, rollouts to make of them, and a token estimate from the run's mean trace."""
    chosen = selection.groupBy(*keys).agg(F.count_if(F.col("role") == "used_candidate").alias("n_used"), F.count_if(F.col("role") == "control").alias("n_control"))
    means = manifest.groupBy(*keys).agg(F.avg("trace_token_len").alias("_mean"), F.count("*").alias("n_original"), F.sum("trace_token_len").alias("_tokens"))
    items = F.col("n_used") + F.col("n_control")
    return chosen.join(means, keys).select(
        *keys,
        "n_used",
        "n_control",
        items.alias("n_items"),
        (items * k).alias("n_rollouts"),
        F.round("_mean", 1).alias("mean_trace_tokens"),
        F.round(items * k * F.col("_mean") / 1e6, 3).alias("est_tokens_m"),
        "n_original",
        F.round(F.col("_tokens") / 1e6, 3).alias("original_tokens_m"),
    )
