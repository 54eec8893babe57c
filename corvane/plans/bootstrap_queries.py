"""Bootstrap queries over the rollout view, with SQL that draws the same units by the same hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import bootstrap, validation
from corvane.plans.adapters import WITH_R
from corvane.plans.core_queries import FRAME, base, frame, query, rounded

_MASK = 0xFFFFFFFF


def _mixed(source: str) -> str:
    """``source`` with its columns a and b passed through the 32-bit mixer."""
    for shift, factor in ((16, bootstrap.MIX_1), (15, bootstrap.MIX_2), (16, None)):
        one = lambda c: f"xor({c}, {c} >> {shift})" + (f" * {factor}::UBIGINT & {_MASK}::UBIGINT" if factor else "") + f" AS {c}"  # noqa: B023, E731
        source = f"(SELECT * REPLACE ({one('a')}, {one('b')}) FROM {source})"
    return source


def weights_sql(sizes: str, reps: int = bootstrap.N_BOOT, seed: int = 42) -> str:
    """Common table expressions up to bw (rep, stratum, qno), one row a draw, for ``sizes`` (stratum, n)."""
    key = lambda at: f"CAST('0x' || substr(sha256('{seed}:' || stratum), {at}, 8) AS UBIGINT)"
    m, block = f"{_MASK}::UBIGINT", bootstrap.BLOCK
    own = "(2 * block + 1)::UBIGINT"
    return f"""
, b0 AS (SELECT stratum, n, rep, xor({key(1)}, rep::UBIGINT) AS a, ({key(9)} + rep::UBIGINT) & {m} AS b FROM {sizes} CROSS JOIN (SELECT unnest(range(0, {reps})) AS rep)),
b1 AS MATERIALIZED (SELECT stratum, n, rep, a AS k1, b AS k2 FROM {_mixed('b0')}),
b2 AS (SELECT stratum, n, rep, k1, k2, xor(j::UBIGINT, k1) AS a, (j::UBIGINT + k2) & {m} AS b FROM (SELECT *, unnest(range(0, n)) AS j FROM b1)),
b3 AS MATERIALIZED (SELECT stratum, n, rep, k1, k2, ((xor(a, b) * n::UBIGINT) >> 32)::BIGINT // {block} AS block, count(*) AS c FROM {_mixed('b2')} GROUP BY ALL),
b4 AS (SELECT stratum, rep, block, c, least({block}, n - block * {block}) AS size, xor(k1, {own}) AS a, (k2 + {own}) & {m} AS b FROM b3),
b5 AS MATERIALIZED (SELECT stratum, rep, block, c, size, a AS k1, b AS k2 FROM {_mixed('b4')}),
b6 AS (SELECT stratum, rep, block, size, xor(j::UBIGINT, k1) AS a, (j::UBIGINT + k2) & {m} AS b FROM (SELECT *, unnest(range(0, c)) AS j FROM b5)),
bw AS (SELECT rep, stratum, block * {block} + ((xor(a, b) * size::UBIGINT) >> 32)::BIGINT AS qno FROM {_mixed('b6')})"""


#: Questions numbered within their dataset.
UNITS = """, units AS (SELECT dataset AS stratum, original_index, row_number() OVER (PARTITION BY dataset ORDER BY original_index) - 1 AS qno FROM (SELECT DISTINCT dataset, original_index FROM r)),
sizes AS (SELECT stratum, count(*) AS n FROM units GROUP BY ALL)"""
NUM, DEN = "to_hint AND judge_label = 0", "to_hint AND judge_label IN (0, 1)"


def sums_sql(keys: list[str], num: str = f"count(*) FILTER (WHERE {NUM})", den: str = f"count(*) FILTER (WHERE {DEN})") -> str:
    """CTEs: pq, each question's counts in each group, and v (keys, rep, num, den, value) of all replicates."""
    k = "".join(f'"{c}", ' for c in keys)
    return f"""{UNITS}{weights_sql('sizes')},
pq AS (SELECT {k}units.stratum, qno, {num}::BIGINT AS num, {den}::BIGINT AS den FROM r JOIN units ON r.dataset = units.stratum AND r.original_index = units.original_index GROUP BY ALL),
got AS (SELECT {k}rep, sum(num) AS num, sum(den) AS den FROM bw JOIN pq USING (stratum, qno) GROUP BY ALL),
every AS (SELECT {k}rep FROM (SELECT DISTINCT {k}1 AS one FROM pq) CROSS JOIN (SELECT unnest(range(0, {bootstrap.N_BOOT})) AS rep)),
v AS (SELECT every.*, CASE WHEN den > 0 THEN num::DOUBLE / den END AS value FROM every LEFT JOIN got ON {' AND '.join(f'every."{c}" IS NOT DISTINCT FROM got."{c}"' for c in [*keys, 'rep'])})"""


def ratio_sql(keys: list[str]) -> str:
    k = "".join(f'"{c}", ' for c in keys)
    on = " AND ".join(f'p."{c}" IS NOT DISTINCT FROM i."{c}"' for c in keys) or "TRUE"
    bound = lambda q, name: f"CASE WHEN count(value) >= 0.5 * count(*) THEN round(quantile_cont(value, {q}), 6) END AS {name}"
    return (
        WITH_R
        + sums_sql(keys)
        + f""", p AS (SELECT {k}sum(num)::DOUBLE AS num, sum(den)::DOUBLE AS den FROM pq GROUP BY ALL),
i AS (SELECT {k}count(value) AS n_defined, count(*) - count(value) AS undefined_reps, {bound(0.025, 'ci_low')}, {bound(0.975, 'ci_high')} FROM v GROUP BY ALL)
SELECT {''.join(f'p."{c}", ' for c in keys)}p.num, p.den, round(CASE WHEN p.den > 0 THEN p.num / p.den END, 6) AS point, n_defined, undefined_reps, ci_low, ci_high FROM p JOIN i ON {on}"""
    )


def p_sql(keys: list[str]) -> str:
    """Positive minus negative case, from the same weights."""
    k = "".join(f'"{c}", ' for c in keys)
    tail = lambda sign: f"avg(CASE WHEN d {sign} 0 THEN 1.0 WHEN d IS NOT NULL THEN 0.0 END)"
    return (
        WITH_R
        + sums_sql([*keys, "case"])
        + f""", d AS (SELECT {k}rep, max(value) FILTER (WHERE "case" = 'positive') - max(value) FILTER (WHERE "case" = 'negative') AS d FROM v GROUP BY ALL)
SELECT {k}count(d) AS n_defined, CASE WHEN count(d) >= 0.5 * count(*) THEN round(least(1.0, 2 * least({tail('<=')}, {tail('>=')})), 6) END AS p FROM d GROUP BY ALL"""
    )


def questions(r: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, r with stratum and qno): the questions of ``r`` numbered within their dataset."""
    units = bootstrap.numbered(r.select("dataset", "original_index").distinct())
    units = units.select(F.col("dataset").alias("stratum"), "original_index", "qno")
    return units.select("stratum", "qno"), r.withColumn("stratum", F.col("dataset")).join(units, ["stratum", "original_index"])


def counted(r: DataFrame, keys: list[str], num: Column | None = None, den: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(units, per question and group: num, den); by default unfaithful and judged rollouts that follow the cue."""
    y = F.col("judge_label")
    num = F.count_if(F.col("to_hint") & (y == 0)) if num is None else num
    den = F.count_if(F.col("to_hint") & y.isin(0, 1)) if den is None else den
    per = r.groupBy("dataset", "original_index", *keys).agg(num.alias("num"), den.alias("den"))
    return questions(per)


def ratios(spark: SparkSession, sf_dir: str, keys: list[str], reps: int = bootstrap.N_BOOT) -> DataFrame:
    units, rows = counted(base(spark, sf_dir), keys)
    return rounded(bootstrap.ratio_table(units, rows, keys, reps=reps), "point", "ci_low", "ci_high")


def case_difference(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    units, rows = counted(base(spark, sf_dir), [*keys, "case"])
    sums = bootstrap.replicate_sums(units, bootstrap.with_groups(rows, [*keys, "case"]), ["num", "den"])
    sums = bootstrap.split_groups(sums.withColumn("value", bootstrap.ratio()), [*keys, "case"])
    side = lambda name: F.max(F.when(F.col("case") == name, F.col("value")))
    diff = sums.groupBy(*keys, "rep").agg((side("positive") - side("negative")).alias("value"))
    counts = diff.groupBy(*keys).agg(F.count("value").alias("n_defined"))
    p = bootstrap.p_value(diff, keys)
    both = counts.join(p, keys) if keys else counts.crossJoin(F.broadcast(p))  # one row each
    return rounded(both, "p")


@query(ratio_sql(["subject_model"]))
def bootstrap_ratio(spark, sf_dir):
    return ratios(spark, sf_dir, ["subject_model"])


@query(ratio_sql([]))
def bootstrap_ratio_all(spark, sf_dir):
    return ratios(spark, sf_dir, [])


@query(ratio_sql(["subject_model", "hint_style", "case"]))
def bootstrap_ratio_cells(spark, sf_dir):
    return ratios(spark, sf_dir, ["subject_model", "hint_style", "case"])


@query(p_sql(["subject_model"]))
def bootstrap_diff_pvalue(spark, sf_dir):
    return case_difference(spark, sf_dir, ["subject_model"])


@query(p_sql([]))
def bootstrap_diff_pvalue_all(spark, sf_dir):
    return case_difference(spark, sf_dir, [])


#: The least common multiple of the numbers of wrong options, for 4, 5 and 10 of them: 2, 3 and 8.
SIGN_KEYS = ["subject_model"]
SIGN_NUM = "sum(CASE WHEN changed AND NOT to_hint THEN 24 // (n_options - 2) ELSE 0 END - CASE WHEN changed AND baseline_hint_votes >= 1 THEN 24 ELSE 0 END)"


@query(
    WITH_R
    + sums_sql(SIGN_KEYS, SIGN_NUM, "count(*) FILTER (WHERE changed)").replace("CASE WHEN den > 0 THEN num::DOUBLE / den END AS value", "CASE WHEN den > 0 THEN num::DOUBLE END AS value")
    + """ SELECT subject_model, count(value) AS n_defined, min(value)::BIGINT AS low, max(value)::BIGINT AS high,
CASE WHEN count(value) >= 0.5 * count(*) THEN round(least(1.0, 2 * least(avg(CASE WHEN value <= 0 THEN 1.0 WHEN value IS NOT NULL THEN 0.0 END), avg(CASE WHEN value >= 0 THEN 1.0 WHEN value IS NOT NULL THEN 0.0 END))), 6) END AS p FROM v GROUP BY ALL"""
)
def exact_sign_contrast(spark, sf_dir):
    options = F.when(F.col("dataset") == "mmlu", 4).when(F.col("dataset") == "aqua", 5).otherwise(10)
    r = base(spark, sf_dir).withColumn("n_options", options)
    modelled = F.count_if(F.col("changed") & ~F.col("to_hint"))
    measured = F.count_if(F.col("changed") & (F.col("baseline_hint_votes") >= 1))
    per = r.groupBy("dataset", "original_index", "n_options", *SIGN_KEYS).agg(modelled.alias("modelled"), measured.alias("measured"), F.count_if("changed").alias("den"))
    units, rows = questions(per)
    v = bootstrap.sign_contrast(units, rows, SIGN_KEYS)
    ends = v.groupBy(*SIGN_KEYS).agg(F.count("value").alias("n_defined"), F.min("value").cast("long").alias("low"), F.max("value").cast("long").alias("high"))
    return rounded(ends.join(bootstrap.p_value(v, SIGN_KEYS), SIGN_KEYS), "p")


# ---------------------------------------------------------------- gap audit

PAIR = ["subject_model", "run"]
CELL = [*PAIR, "stratum", "hint_style"]
AUDIT_BOOT = 1000
#: The arbiter can't decide every seventeenth question; the cells of run_F with style post_hoc are not sampled.
AUDIT = f"""{FRAME}, fa AS (SELECT *, CASE WHEN original_index % 17 = 0 THEN -1 ELSE label_b END AS arbiter_label FROM fr),
s0 AS (SELECT *, row_number() OVER (PARTITION BY subject_model, run, stratum, hint_style ORDER BY sha256(concat_ws(':', '3', subject_model, run, stratum, hint_style, rollout_id)), rollout_id) AS place, count(*) OVER (PARTITION BY subject_model, run, stratum, hint_style) AS available FROM fa),
sm AS (SELECT *, available / least(available, 10)::DOUBLE AS w, concat_ws('|', subject_model, run, stratum, hint_style) AS cell, row_number() OVER (PARTITION BY subject_model, run, stratum, hint_style ORDER BY rollout_id) - 1 AS qno
  FROM s0 WHERE place <= 10 AND NOT (run = 'run_F' AND hint_style = 'post_hoc')),
sizes AS (SELECT cell AS stratum, count(*) AS n FROM sm GROUP BY ALL){weights_sql('sizes', AUDIT_BOOT, 7)},
sr AS (SELECT cell AS stratum, qno, subject_model, run, unnest([hint_style, 'overall']) AS style, CASE WHEN arbiter_label = 0 THEN w ELSE 0 END AS num, CASE WHEN arbiter_label IN (0, 1) THEN w ELSE 0 END AS den,
  CASE WHEN judge_label = 0 THEN w ELSE 0 END AS fnum, w AS fden, arbiter_label FROM sm),
v AS (SELECT subject_model, run, style, rep, CASE WHEN sum(den) > 0 THEN sum(num) / sum(den) END AS value FROM bw JOIN sr USING (stratum, qno) GROUP BY ALL),
pop AS (SELECT subject_model, run, style, count(*) AS n_frame, count(*) FILTER (WHERE judge_label = 0)::DOUBLE / count(*) AS pop_rate, count(*) FILTER (WHERE cell NOT IN (SELECT cell FROM sm)) AS uncovered
  FROM (SELECT subject_model, run, judge_label, concat_ws('|', subject_model, run, stratum, hint_style) AS cell, unnest([hint_style, 'overall']) AS style FROM fa) GROUP BY ALL),
st AS (SELECT subject_model, run, style, count(*) AS n_sample, count(*) FILTER (WHERE arbiter_label IN (0, 1)) AS n_binary, sum(fnum) / sum(fden) AS flash, CASE WHEN sum(den) > 0 THEN sum(num) / sum(den) END AS arb,
  count(*) FILTER (WHERE arbiter_label = 0)::DOUBLE / nullif(count(*) FILTER (WHERE arbiter_label IN (0, 1)), 0) AS raw FROM sr GROUP BY ALL)"""


def audit_sample(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(sample, frame) of an audit of the judge by an arbiter."""
    f = frame(spark, sf_dir).withColumn("arbiter_label", F.when(F.col("original_index") % 17 == 0, -1).otherwise(F.col("label_b")))
    sample = validation.draw(f, CELL, 10, 3).where("not (run = 'run_F' and hint_style = 'post_hoc')")
    return sample, f


@query(
    WITH_R
    + AUDIT
    + """, i AS (SELECT subject_model, run, style, CASE WHEN count(value) >= 500 THEN round(quantile_cont(value, 0.025), 6) END AS ci_low, CASE WHEN count(value) >= 500 THEN round(quantile_cont(value, 0.975), 6) END AS ci_high FROM v GROUP BY ALL)
SELECT subject_model, run, style, n_frame, n_sample, n_binary, uncovered AS n_frame_rows_uncovered, round(pop_rate, 6) AS flash_population_rate, round(flash, 6) AS flash_reweighted_rate, uncovered = 0 AND abs(flash - pop_rate) < 1e-9 AS weights_check_ok,
round(arb, 6) AS arbiter_reweighted_rate, round(raw, 6) AS arbiter_raw_rate, ci_low, ci_high FROM st JOIN pop USING (subject_model, run, style) JOIN i USING (subject_model, run, style)"""
)
def gap_audit(spark, sf_dir):
    sample, f = audit_sample(spark, sf_dir)
    rates = ["flash_population_rate", "flash_reweighted_rate", "arbiter_reweighted_rate", "arbiter_raw_rate", "ci_low", "ci_high"]
    return rounded(validation.gap_audit(sample, f, PAIR, ["stratum", "hint_style"], "hint_style", reps=AUDIT_BOOT, seed=7), *rates)


@query(
    WITH_R
    + AUDIT
    + """, o AS (SELECT * FROM st JOIN pop USING (subject_model, run, style) WHERE style = 'overall'), e AS (SELECT *, row_number() OVER (ORDER BY subject_model, run) AS k FROM o),
a AS (SELECT * FROM e WHERE k = 1), b AS (SELECT * FROM e WHERE k = 2),
x AS (SELECT p.value - q.value AS d, CASE WHEN q.value <> 0 THEN p.value / q.value END AS q FROM v p JOIN v q USING (rep) WHERE p.style = 'overall' AND q.style = 'overall'
  AND (p.subject_model, p.run) = (SELECT (subject_model, run) FROM a) AND (q.subject_model, q.run) = (SELECT (subject_model, run) FROM b)),
y AS (SELECT quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi, quantile_cont(q, 0.025) AS qlo, quantile_cont(q, 0.975) AS qhi FROM x)
SELECT a.subject_model || '|' || a.run AS first, b.subject_model || '|' || b.run AS second, round(a.pop_rate - b.pop_rate, 6) AS flash_population_gap, round(a.pop_rate / b.pop_rate, 6) AS flash_population_ratio, round(a.arb - b.arb, 6) AS arbiter_gap,
round(lo, 6) AS gap_low, round(hi, 6) AS gap_high, round(a.arb / b.arb, 6) AS arbiter_ratio, round(qlo, 6) AS ratio_low, round(qhi, 6) AS ratio_high, lo > 0 OR hi < 0 AS gap_survives FROM a, b, y"""
)
def cross_model_gap(spark, sf_dir):
    sample, f = audit_sample(spark, sf_dir)
    out = validation.cross_model_gap(sample, f, PAIR, ["stratum", "hint_style"], reps=AUDIT_BOOT, seed=7)
    return rounded(out, *[c for c, t in out.dtypes if t == "double"])
