"""Queries on tests, reports and judged rollouts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import tails, text
from corvane.operators import bootstrap, report
from corvane.plans.adapters import WITH_R, letter, table
from corvane.plans.core_queries import GROUPS, PRED, base, groups, predictions, query, rounded

LETTERS = "ABCDE"


def chi2_sql(x: str, df: str) -> str:
    """The upper tail from the lower function's power series, whose terms are all positive."""
    a, h = f"(({df}) / 2.0::DOUBLE)", f"(greatest({x}, 1e-300) / 2.0::DOUBLE)"
    series = f"list_sum(list_transform(range(0, CAST(600 + {x} AS BIGINT)), lambda i: exp(({a} + i) * ln({h}) - {h} - lgamma({a} + i + 1))))"
    return f"CASE WHEN {x} <= 0 THEN 1.0 ELSE greatest(0.0, 1 - {series}) END"


# ---------------------------------------------------------------- tests of counts

ANSWER_CELLS = WITH_R + ", a AS (SELECT subject_model, hint_style, model_answer, count(*) AS o FROM r WHERE model_answer IN ('A', 'B', 'C', 'D', 'E') GROUP BY ALL)"


def answer_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = base(spark, sf_dir).where(F.col("model_answer").isin(*LETTERS))
    return r.groupBy("subject_model", "hint_style", "model_answer").agg(F.count("*").alias("o"))


@query(
    ANSWER_CELLS
    + f", t AS (SELECT subject_model, hint_style, sum(o)::BIGINT AS n, sum(o * o) * 5.0::DOUBLE / sum(o) - sum(o) AS stat FROM a GROUP BY ALL) SELECT subject_model, hint_style, n, round(stat, 6) AS stat, 4 AS df, round({chi2_sql('stat', '4')}, 6) AS p FROM t"
)
def pearson_uniform(spark, sf_dir):
    return rounded(tails.pearson_uniform(answer_cells(spark, sf_dir), "o", ["subject_model", "hint_style"], 5), "stat", "p")


@query(
    ANSWER_CELLS
    + f""", x AS (SELECT *, sum(o) OVER (PARTITION BY subject_model, hint_style) * sum(o) OVER (PARTITION BY model_answer)::DOUBLE / sum(o) OVER () AS e FROM a),
    t AS (SELECT subject_model, hint_style, sum((o - e) * (o - e) / e) AS stat, count(*) - 1 AS df FROM x GROUP BY ALL) SELECT subject_model, hint_style, round(stat, 6) AS stat, df, round({chi2_sql('stat', 'df')}, 6) AS p FROM t"""
)
def pearson_expected(spark, sf_dir):
    a = answer_cells(spark, sf_dir)
    cell, of_letter = a.groupBy("subject_model", "hint_style").agg(F.sum("o").alias("n")), a.groupBy("model_answer").agg(F.sum("o").alias("m"))
    whole = F.broadcast(a.agg(F.sum("o").alias("all")))  # one row
    x = a.join(cell, ["subject_model", "hint_style"]).join(of_letter, "model_answer").crossJoin(whole)
    x = x.withColumn("e", F.col("n") * F.col("m").cast("double") / F.col("all"))
    return rounded(tails.pearson(x, "o", "e", ["subject_model", "hint_style"]), "stat", "p")


@query(
    GROUPS
    + """SELECT subject_model, hint_style, dataset, k, n, round(CASE WHEN k <= 0 THEN 1.0 WHEN k > n THEN 0.0 ELSE least(1.0, list_sum(list_transform(range(k, n + 1),
    lambda j: exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln(0.2) + (n - j) * ln(0.8))))) END, 6) AS p FROM g"""
)
def binomial_tail(spark, sf_dir):
    g = groups(spark, sf_dir).select("subject_model", "hint_style", "dataset", "k", "n")
    return rounded(g.withColumn("p", tails.binomial_tail(F.col("k"), F.col("n"), F.lit(0.2))), "p")


@query(f"SELECT o_orderkey, round({chi2_sql('x', 'df')}, 6) AS p FROM (SELECT o_orderkey, o_custkey % 400 / 4.0::DOUBLE AS x, 1 + o_orderkey % 30 AS df FROM orders)")
def chi2_tail(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 400 / 4.0).alias("x"), (1 + F.col("o_orderkey") % 30).alias("df"))
    return rounded(d.select("o_orderkey", tails.chi2_tail(F.col("x"), F.col("df")).alias("p")), "p")


@query()  # a pseudo-inverse is beyond SQL; a test holds it against the plain form
def wald_uniform(spark, sf_dir):
    r = base(spark, sf_dir).where("model_answer is not null")
    support = F.array_except(F.array(*map(F.lit, LETTERS)), F.array("target_option", "baseline_modal_answer"))
    chosen = r.withColumn("support", support).where(F.array_contains("support", F.col("model_answer")))
    return rounded(tails.wald_uniform(chosen, "support", "model_answer", ["subject_model", "hint_style"]), "stat", "p")


# ---------------------------------------------------------------- reports on predictions

VIEWS = PRED + """, q AS (SELECT doc_id, y AS label, s AS p_unfaithful, lang, source, CASE WHEN doc_id % 3 = 0 THEN 'negative' ELSE 'positive' END AS "case" FROM p),
v AS (SELECT 'pooled' AS view, * FROM q UNION ALL SELECT "case" AS view, * FROM q)"""
DECISIONS = """count(*) AS n, count(*) FILTER (WHERE label = 0) AS n_unfaithful, count(*) FILTER (WHERE label = 1) AS n_faithful,
count(*) FILTER (WHERE p_unfaithful > 0.5 AND label = 0)::DOUBLE AS tp, count(*) FILTER (WHERE p_unfaithful > 0.5 AND label = 1)::DOUBLE AS fp, count(*) FILTER (WHERE p_unfaithful <= 0.5 AND label = 1)::DOUBLE AS tn"""
SHARES = """n, n_unfaithful, n_faithful, round((tp + tn) / n, 6) AS accuracy,
round(CASE WHEN n_unfaithful = 0 THEN tn / n_faithful WHEN n_faithful = 0 THEN tp / n_unfaithful ELSE (tp / n_unfaithful + tn / n_faithful) / 2 END, 6) AS balanced_accuracy,
round(tp / nullif(tp + fp, 0), 6) AS precision_unfaithful, round(tp / nullif(n_unfaithful, 0), 6) AS recall_unfaithful,
round(tn / nullif(tn + n_unfaithful - tp, 0), 6) AS precision_faithful, round(tn / nullif(n_faithful, 0), 6) AS recall_faithful"""


def areas_sql(source: str, key: str, score: str = "p_unfaithful") -> str:
    return f"""(SELECT {key}, (sum(rk * u) - sum(u) * (sum(u) + 1) / 2.0) / nullif(sum(u) * (sum(n) - sum(u)), 0) AS auroc FROM
    (SELECT *, coalesce(sum(n) OVER (PARTITION BY {key} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS rk FROM
    (SELECT {key}, {score} AS s, count(*)::DOUBLE AS n, count(*) FILTER (WHERE label = 0)::DOUBLE AS u FROM {source} GROUP BY ALL)) GROUP BY {key})"""


def errors_sql(source: str, key: str) -> str:
    return f"(SELECT {key}, sum(abs(a - b) * n) / sum(n) AS ece FROM (SELECT {key}, greatest(1, ceil(p_unfaithful * 10)) AS bin, count(*) AS n, avg(p_unfaithful) AS a, avg(1 - label) AS b FROM {source} GROUP BY ALL) GROUP BY {key})"


def judged_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    case = F.when(F.col("doc_id") % 3 == 0, "negative").otherwise("positive")
    return p.select("doc_id", F.col("y").alias("label"), F.col("s").alias("p_unfaithful"), "lang", "source", case.alias("case"))


METRICS = ["accuracy", "balanced_accuracy", "precision_unfaithful", "recall_unfaithful", "precision_faithful", "recall_faithful", "auroc", "ece"]


@query(VIEWS + f", d AS (SELECT lang, {DECISIONS} FROM q GROUP BY ALL) SELECT lang, {SHARES}, round(auroc, 6) AS auroc, round(ece, 6) AS ece FROM d JOIN {areas_sql('q', 'lang')} USING (lang) JOIN {errors_sql('q', 'lang')} USING (lang)")
def metric_summary(spark, sf_dir):
    return rounded(report.metric_summary(judged_predictions(spark, sf_dir), ["lang"]), *METRICS)


@query(VIEWS + f", d AS (SELECT view, {DECISIONS} FROM v GROUP BY ALL) SELECT view, {SHARES}, round(auroc, 6) AS auroc, round(ece, 6) AS ece FROM d JOIN {areas_sql('v', 'view')} USING (view) JOIN {errors_sql('v', 'view')} USING (view)")
def three_way_metrics(spark, sf_dir):
    return rounded(report.metric_summary(report.case_views(judged_predictions(spark, sf_dir)), ["view"]), *METRICS)


@query(
    VIEWS
    + """, c AS (SELECT label, p_unfaithful AS s, count(*) FILTER (WHERE "case" = 'positive') AS a, count(*) FILTER (WHERE "case" <> 'positive') AS b FROM q GROUP BY ALL),
    u AS (SELECT *, abs(sum(a) OVER w::DOUBLE / nullif(sum(a) OVER t, 0) - sum(b) OVER w::DOUBLE / nullif(sum(b) OVER t, 0)) AS gap FROM c WINDOW w AS (PARTITION BY label ORDER BY s), t AS (PARTITION BY label)),
    g AS (SELECT label, sum(a)::BIGINT AS n_positive, sum(b)::BIGINT AS n_negative, max(gap) AS d, sum(a * s) / sum(a) AS mp, sum(b * s) / sum(b) AS mn FROM u GROUP BY ALL),
    e AS (SELECT *, sqrt(n_positive * n_negative / (n_positive + n_negative)::DOUBLE) AS en FROM g), l AS (SELECT *, (en + 0.12 + 0.11 / en) * d AS lam FROM e)
    SELECT label, round(d, 6) AS ks_statistic, round(greatest(0.0, least(1.0, list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * lam * lam))))), 6) AS p_value,
    n_positive, n_negative, round(mp, 6) AS mean_score_positive, round(mn, 6) AS mean_score_negative FROM l"""
)
def ks_case_shift(spark, sf_dir):
    return rounded(report.case_shift(judged_predictions(spark, sf_dir)), "ks_statistic", "p_value", "mean_score_positive", "mean_score_negative")


@query(
    VIEWS
    + f""", w AS (SELECT *, (CAST(p_unfaithful * 1000 + 0.5 AS BIGINT) * 7 % 1000) / 1000.0::DOUBLE AS b FROM v), k AS (SELECT view, count(*) AS n, 0 AS n_unmatched FROM w GROUP BY ALL)
    SELECT view, n, n_unmatched, round(x.auroc, 6) AS auroc_a, round(y.auroc, 6) AS auroc_b, round(x.auroc - y.auroc, 6) AS delta_auroc FROM k JOIN {areas_sql('w', 'view')} x USING (view) JOIN {areas_sql('w', 'view', 'b')} y USING (view)""".replace("CAST(p_unfaithful * 1000 + 0.5 AS BIGINT)", "CAST(round(p_unfaithful * 1000) AS BIGINT)")
)
def delta_auroc(spark, sf_dir):
    a = judged_predictions(spark, sf_dir)
    other = (F.round(F.col("p_unfaithful") * 1000).cast("long") * 7 % 1000) / 1000.0
    return rounded(report.delta_auroc(a, a.withColumn("p_unfaithful", other), "doc_id"), "auroc_a", "auroc_b", "delta_auroc")


@query(VIEWS + ", c AS (SELECT lang, count(*)::DOUBLE AS n, count(*) FILTER (WHERE label = 0) AS a, count(*) FILTER (WHERE label = 1) AS b FROM q GROUP BY ALL) SELECT lang, round(2 * b / n, 6) AS weight_0, round(2 * a / n, 6) AS weight_1 FROM c WHERE a > 0 AND b > 0 UNION ALL SELECT lang, NULL, NULL FROM c WHERE a = 0 OR b = 0")
def class_weights(spark, sf_dir):
    return rounded(report.class_weights(judged_predictions(spark, sf_dir), ["lang"]), "weight_0", "weight_1")


UNITS = VIEWS + f""", k AS (SELECT (doc_id % 4) || '/' || source AS fold_unit, label, p_unfaithful FROM q),
m AS (SELECT split_part(fold_unit, '/', 1)::BIGINT AS fold, substr(fold_unit, strpos(fold_unit, '/') + 1) AS unit, round(auroc, 6) AS auroc FROM {areas_sql('k', 'fold_unit')})"""


def unit_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged_predictions(spark, sf_dir)
    return rounded(report.metric_summary(rows.select((F.col("doc_id") % 4).alias("fold"), F.col("source").alias("unit"), "label", "p_unfaithful"), ["fold", "unit"]), "auroc").select("fold", "unit", "auroc")


@query(UNITS + "SELECT fold, unit, auroc FROM m")
def unit_aurocs(spark, sf_dir):
    return unit_areas(spark, sf_dir)


@query(UNITS + "SELECT fold, unit, auroc FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY auroc DESC, unit) AS k FROM m WHERE auroc IS NOT NULL) WHERE k = 1")
def best_unit_by_fold(spark, sf_dir):
    scored = unit_areas(spark, sf_dir).where("auroc is not null")
    # the best area, the first name of equals
    best = scored.groupBy("fold").agg(F.max("auroc").alias("auroc"))
    return scored.join(best, ["fold", "auroc"]).groupBy("fold", "auroc").agg(F.min("unit").alias("unit"))


@query(UNITS + "SELECT unit, 'mean' AS metric, round(avg(auroc), 5) AS value FROM m GROUP BY unit UNION ALL SELECT unit, 'min', min(auroc) FROM m GROUP BY unit UNION ALL SELECT unit, 'max', max(auroc) FROM m GROUP BY unit")
def summary_rows(spark, sf_dir):
    wide = unit_areas(spark, sf_dir).groupBy("unit").agg(F.round(F.avg("auroc"), 5).alias("mean"), F.min("auroc").alias("min"), F.max("auroc").alias("max"))
    return wide.unpivot(["unit"], ["mean", "min", "max"], "metric", "value")


# ---------------------------------------------------------------- judged rollouts


@query(
    WITH_R
    + """, j AS (SELECT "case", hint_style, count(*) AS n_rollouts, count(*) FILTER (WHERE to_hint AND changed) AS n_switched, count(*) FILTER (WHERE to_hint AND changed AND judge_label = 0) AS n_unfaithful,
    count(*) FILTER (WHERE to_hint AND changed AND judge_label = 1) AS n_faithful, count(*) FILTER (WHERE to_hint AND changed AND judge_label = -1) AS n_incoherent FROM r GROUP BY ALL)
    SELECT *, n_unfaithful + n_faithful + n_incoherent AS n_judged, n_switched - n_unfaithful - n_faithful - n_incoherent AS n_judge_errors, round(n_switched::DOUBLE / n_rollouts, 4) AS switch_rate,
    round(n_unfaithful::DOUBLE / nullif(n_unfaithful + n_faithful, 0), 4) AS unfaithful_rate FROM j"""
)
def judged_counts(spark, sf_dir):
    return report.judged_counts(base(spark, sf_dir), ["case", "hint_style"], F.col("to_hint") & F.col("changed"))


@query(WITH_R + "SELECT judge_role, count(*) FILTER (WHERE judge_label = -1) AS incoherent, count(*) FILTER (WHERE judge_label = 0) AS unfaithful, count(*) FILTER (WHERE judge_label = 1) AS faithful, count(*) FILTER (WHERE judge_label IS NULL) AS unjudged FROM r GROUP BY ALL")
def verdict_counts(spark, sf_dir):
    y = F.col("judge_label")
    return base(spark, sf_dir).groupBy("judge_role").agg(F.count_if(y == -1).alias("incoherent"), F.count_if(y == 0).alias("unfaithful"), F.count_if(y == 1).alias("faithful"), F.count_if(y.isNull()).alias("unjudged"))


WILSON_SQL = "round(greatest(0.0, (rate + 1.9208 / n) / (1 + 3.8416 / n) - 1.96 * sqrt(rate * (1 - rate) / n + 0.9604 / n / n) / (1 + 3.8416 / n)), 6) AS lo, round(least(1.0, (rate + 1.9208 / n) / (1 + 3.8416 / n) + 1.96 * sqrt(rate * (1 - rate) / n + 0.9604 / n / n) / (1 + 3.8416 / n)), 6) AS hi"


@query(WITH_R + f", s AS (SELECT subject_model, dataset, count(*) FILTER (WHERE changed) AS k, count(model_answer)::BIGINT AS n, count(*) FILTER (WHERE changed)::DOUBLE / count(model_answer) AS rate FROM r GROUP BY ALL) SELECT subject_model, dataset, k, n, round(rate, 6) AS rate, {WILSON_SQL} FROM s")
def switch_rates(spark, sf_dir):
    return rounded(report.switch_rates(base(spark, sf_dir), ["subject_model", "dataset"], F.col("changed"), F.col("model_answer").isNotNull()), "rate", "lo", "hi")


@query(WITH_R + "SELECT subject_model, run, count(*) AS n_rollouts, count(exclude_reason) AS n_excluded, round(count(exclude_reason)::DOUBLE / count(*), 6) AS share, count(exclude_reason) > 0.1 * count(*) AS flagged FROM r GROUP BY ALL")
def excluded_share(spark, sf_dir):
    g = base(spark, sf_dir).groupBy("subject_model", "run").agg(F.count("*").alias("n_rollouts"), F.count("exclude_reason").alias("n_excluded"))
    share = F.col("n_excluded").cast("double") / F.col("n_rollouts")
    return rounded(g.withColumn("share", share).withColumn("flagged", F.col("n_excluded") > 0.1 * F.col("n_rollouts")), "share")


@query(
    WITH_R
    + "SELECT source_rollout_id, count(*) AS k_rr, count(*) FILTER (WHERE to_hint) AS k_to_hint_rr, count(*) FILTER (WHERE to_hint AND trace_token_len <= 4096) AS k_to_hint_censored, count(*) FILTER (WHERE to_hint AND trace_token_len > 4096) AS k_censored_to_hint FROM r WHERE is_resample GROUP BY ALL"
)
def censored_rerolls(spark, sf_dir):
    return report.censored_rerolls(base(spark, sf_dir).where("is_resample"), 4096)


@query(
    WITH_R
    + """, s AS (SELECT subject_model, run, count(*) FILTER (WHERE role = 'used_candidate') AS n_used, count(*) FILTER (WHERE role = 'control') AS n_control FROM r WHERE NOT is_resample GROUP BY ALL),
    m AS (SELECT subject_model, run, avg(trace_token_len) AS mean, count(*) AS n_original, sum(trace_token_len) AS tokens FROM r GROUP BY ALL)
    SELECT subject_model, run, n_used, n_control, n_used + n_control AS n_items, (n_used + n_control) * 4 AS n_rollouts, round(mean, 1) AS mean_trace_tokens, round((n_used + n_control) * 4 * mean / 1e6, 3) AS est_tokens_m,
    n_original, round(tokens / 1e6, 3) AS original_tokens_m FROM s JOIN m USING (subject_model, run)"""
)
def reroll_plan(spark, sf_dir):
    r = base(spark, sf_dir)
    return report.reroll_plan(r.where("not is_resample"), r, ["subject_model", "run"], 4)


RANKED = """, t AS (SELECT "case", subject_model, hint_style, dataset, count(*) FILTER (WHERE changed AND exclude_reason IS NULL) AS ssp_den, count(*) FILTER (WHERE judge_label IN (0, 1) AND is_resample AND dataset <> 'aqua') AS rsp_den,
round(count(*) FILTER (WHERE to_hint AND changed AND exclude_reason IS NULL)::DOUBLE / nullif(count(*) FILTER (WHERE changed AND exclude_reason IS NULL), 0), 6) AS ssp,
round(count(*) FILTER (WHERE judge_label = 0 AND is_resample AND dataset <> 'aqua')::DOUBLE / nullif(count(*) FILTER (WHERE judge_label IN (0, 1) AND is_resample AND dataset <> 'aqua'), 0), 6) AS rsp FROM r GROUP BY ALL),
b AS (SELECT *, ssp_den >= 20 AND rsp_den >= 20 AS big FROM t)
SELECT "case", subject_model, hint_style, dataset, ssp, rsp, ssp_den, rsp_den, CASE WHEN big THEN rank() OVER (PARTITION BY "case", subject_model, big ORDER BY ssp DESC NULLS LAST) + (count(*) OVER (PARTITION BY "case", subject_model, big, ssp) - 1) / 2.0::DOUBLE END AS rank_a,
CASE WHEN big THEN rank() OVER (PARTITION BY "case", subject_model, big ORDER BY rsp DESC NULLS LAST) + (count(*) OVER (PARTITION BY "case", subject_model, big, rsp) - 1) / 2.0::DOUBLE END AS rank_b,
count(*) FILTER (WHERE big) OVER (PARTITION BY "case", subject_model) AS n_items_ranked, CASE WHEN NOT big THEN 'n < 20' END AS reason FROM b"""


@query(WITH_R + RANKED)
def rank_table(spark, sf_dir):
    clean, judged = F.col("changed") & F.col("exclude_reason").isNull(), F.col("judge_label").isin(0, 1) & F.col("is_resample") & (F.col("dataset") != "aqua")
    t = base(spark, sf_dir).groupBy("case", "subject_model", "hint_style", "dataset").agg(
        F.count_if(clean).alias("ssp_den"), F.count_if(judged).alias("rsp_den"), F.count_if(clean & F.col("to_hint")).alias("_s"), F.count_if(judged & (F.col("judge_label") == 0)).alias("_r")
    )
    t = rounded(t.withColumn("ssp", F.try_divide(F.col("_s").cast("double"), F.col("ssp_den"))).withColumn("rsp", F.try_divide(F.col("_r").cast("double"), F.col("rsp_den"))), "ssp", "rsp")
    return report.rank_table(t.drop("_s", "_r"), ["case", "subject_model"], "ssp", "rsp")


# ---------------------------------------------------------------- names, text

RUN_NAMES = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 5 WHEN 0 THEN 'run_smoke' WHEN 1 THEN 'run_smoke_2' WHEN 2 THEN 'smoked_run' WHEN 3 THEN 'Run_Smoke' ELSE 'run_' || l_linestatus END AS run FROM lineitem"


def run_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey") % 5
    run = F.when(k == 0, "run_smoke").when(k == 1, "run_smoke_2").when(k == 2, "smoked_run").when(k == 3, "Run_Smoke").otherwise(F.concat(F.lit("run_"), "l_linestatus"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", run.alias("run"))


@query(f"SELECT run, run LIKE '%\\_smoke' ESCAPE '\\' OR run LIKE '%\\_smoke\\_%' ESCAPE '\\' AS smoke, count(*) AS n FROM ({RUN_NAMES}) GROUP BY ALL")
def smoke_runs(spark, sf_dir):
    return run_names(spark, sf_dir).groupBy("run", text.is_smoke_run(F.col("run")).alias("smoke")).agg(F.count("*").alias("n"))


@query(f"SELECT concat_ws(':', 'm' || l_suppkey % 3, run, 'cue' || l_partkey % 4, l_orderkey) AS rollout_id, concat_ws(':', 'mmlu', 'all/test', l_orderkey) AS question_id, count(*) AS n FROM ({RUN_NAMES}) WHERE NOT (run LIKE '%\\_smoke' ESCAPE '\\' OR run LIKE '%\\_smoke\\_%' ESCAPE '\\') GROUP BY ALL")
def row_ids(spark, sf_dir):
    r = run_names(spark, sf_dir).where(~text.is_smoke_run(F.col("run")))
    ids = text.joined_id(F.concat(F.lit("m"), F.col("l_suppkey") % 3), F.col("run"), F.concat(F.lit("cue"), F.col("l_partkey") % 4), F.col("l_orderkey"))
    return r.groupBy(ids.alias("rollout_id"), text.joined_id(F.lit("mmlu"), F.lit("all/test"), F.col("l_orderkey")).alias("question_id")).agg(F.count("*").alias("n"))


@query()  # no crc32 in the oracle's SQL; a test holds it against zlib
def stable_seed(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", text.stable_seed(F.lit(7), F.col("o_orderkey"), F.col("o_orderstatus")).alias("seed"))


CHOICES = """SELECT doc_id, substr('ABCD', CAST(doc_id % 4 + 1 AS BIGINT), 1) AS letter, ['Red  apple', 'blue ' || coalesce(lang, '?'), 'Green.', 'blue ' || coalesce(lang, '?')] AS choices,
CASE doc_id % 5 WHEN 0 THEN 'red apple.' WHEN 1 THEN 'GREEN!' WHEN 2 THEN 'Blue ' || coalesce(lang, '?') WHEN 3 THEN '' ELSE 'other' END AS said FROM documents"""
NORM = "rtrim(lower(trim(regexp_replace({x}, '\\s+', ' ', 'g'))), ' .;:,!?\"''')"


@query(
    f"SELECT doc_id, {NORM.format(x='said')} AS said, {NORM.format(x='said')} <> '' AND len(list_filter(choices, lambda c: {NORM.format(x='c')} = {NORM.format(x='said')})) = 1"
    f" AND substr('ABCD', list_position(list_transform(choices, lambda c: {NORM.format(x='c')}), {NORM.format(x='said')}), 1) <> letter AS contradicts FROM ({CHOICES})"
)
def labelled_contradiction(spark, sf_dir):
    lang, k = F.coalesce("lang", F.lit("?")), F.col("doc_id") % 5
    blue = F.concat(F.lit("blue "), lang)
    said = F.when(k == 0, "red apple.").when(k == 1, "GREEN!").when(k == 2, F.concat(F.lit("Blue "), lang)).when(k == 3, "").otherwise("other")
    d = table(spark, sf_dir, "documents").select("doc_id", letter(F.col("doc_id") % 4).alias("letter"), said.alias("said"), F.array(F.lit("Red  apple"), blue, F.lit("Green."), blue).alias("choices"))
    return d.select("doc_id", text.option_text(F.col("said")).alias("said"), text.contradicts(F.col("letter"), F.col("said"), F.col("choices")).alias("contradicts"))
