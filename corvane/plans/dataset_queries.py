"""Queries of the question sets' readers over rows of their layouts made from the orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.plans.adapters import table
from corvane.plans.core_queries import query
from corvane.sources import datasets

#: Forms of an option: {x} the letter, {n} a number of the row.
FORMS = ("{x}){n}", " {x} ) {n} apples ", "{x}){x}){n}", "{x})B)q{n}", "{n}", "{x})  ")
#: Of each option's place, the form by the row's number; the last two forms are rare.
FORM_AT = "CASE WHEN (k + {i}) % 29 = 0 THEN 4 WHEN (k + {i}) % 31 = 0 THEN 5 ELSE (k // {d}) % 4 END"
CORRECT = "CASE WHEN k % 37 = 0 THEN 'F' WHEN k % 41 = 0 THEN NULL ELSE ' ' || substr('abcde', CAST(k % 5 + 1 AS INT), 1) END"


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").alias("original_index"))


def _expr(sql: str) -> Column:
    return F.expr(sql.replace("//", "div"))


def aqua_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _numbers(spark, sf_dir)

    def option(i: int) -> Column:
        form = F.get(F.array(*map(F.lit, FORMS)), _expr(FORM_AT.format(i=i, d=i + 1)).cast("int"))
        return F.replace(F.replace(form, F.lit("{x}"), F.lit("ABCDE"[i])), F.lit("{n}"), (F.col("k") % (7 + i)).cast("string"))

    return d.select("original_index", F.concat(F.lit("How many of "), "k", F.lit("?")).alias("question"), F.array(*map(option, range(5))).alias("options"), _expr(CORRECT).alias("correct"))


def _option_sql(i: int) -> str:
    x, n = "ABCDE"[i], f"CAST(k % {7 + i} AS VARCHAR)"
    forms = (n, f"{n} || ' apples'", n, n if x == "B" else f"'B)q' || {n}", "NULL", "NULL")
    forms = tuple(f"'q' || {n}" if x == "B" and j == 3 else f for j, f in enumerate(forms))
    return f"CASE {FORM_AT.format(i=i, d=i + 1)} " + " ".join(f"WHEN {j} THEN {f}" for j, f in enumerate(forms)) + " END"


#: What the forms mean, from how they were made; options then shuffled by hash.
AQUA = f"""WITH d AS (SELECT o_orderkey AS k FROM orders), q AS (SELECT k, 'How many of ' || k || '?' AS question, [{', '.join(_option_sql(i) for i in range(5))}] AS ch, {CORRECT} AS c FROM d),
g AS (SELECT k, question, ch, k % 5 AS a FROM q WHERE len(list_filter(ch, lambda x: x IS NULL)) = 0 AND c IS NOT NULL AND c <> 'F'),
o AS (SELECT *, list_transform(list_sort(list_transform(range(0, 5), lambda i: [sha256(concat_ws(':', '6', k, i)), CAST(i AS VARCHAR)])), lambda x: CAST(x[2] AS INTEGER)) AS ord FROM g),
s AS (SELECT k, question, list_transform(ord, lambda i: ch[i + 1]) AS ch, array_to_string(ord, ',') AS ord, list_position(ord, CAST(a AS INTEGER)) - 1 AS a, substr('ABCDE', CAST(a + 1 AS BIGINT), 1) AS was FROM o)"""


@query(
    AQUA
    + """ SELECT k AS original_index, a AS answer_idx, substr('ABCDE', CAST(a + 1 AS BIGINT), 1) AS groundtruth, ord AS answers_order, was AS original_groundtruth,
question || chr(10) || chr(10) || array_to_string(list_transform(range(1, 6), lambda i: substr('ABCDE', CAST(i AS BIGINT), 1) || ') ' || ch[i]), chr(10)) AS prompt FROM s"""
)
def dataset_aqua(spark, sf_dir):
    out = datasets.aqua(aqua_rows(spark, sf_dir), seed=6, shuffle=True)
    f = F.col("additional_fields")
    return out.select("original_index", "answer_idx", "groundtruth", f["answers_order"].alias("answers_order"), f["original_groundtruth"].alias("original_groundtruth"), "prompt")


PRO_FIELDS = "CASE k % 3 WHEN 0 THEN 'law' WHEN 1 THEN 'physics' ELSE 'history' END"


@query(
    f"""WITH d AS (SELECT o_orderkey AS k, {PRO_FIELDS} AS category FROM orders), r AS (SELECT *, 4 + k % 7 AS width, list_filter(range(0, 10), lambda i: i < 4 + k % 7) AS real FROM d WHERE category <> 'history'),
c AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY sha256('9:' || k), k) AS place FROM r WHERE width = 7)
SELECT k AS original_index, category, CAST(k % 4 AS INTEGER) AS answer_idx, substr('ABCDEFGHIJ', CAST(k % 4 + 1 AS BIGINT), 1) AS groundtruth, array_to_string(list_transform(real, lambda i: 'o' || i), '|') AS choices FROM c WHERE place <= 20"""
)
def dataset_mmlu_pro(spark, sf_dir):
    k = F.col("k")
    real = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i < 4 + k % 7, F.concat(F.lit("o"), i.cast("string"))).otherwise(datasets.NO_OPTION))
    # a placeholder before each real option from the second on moves places
    spread = F.flatten(F.transform(real, lambda o: F.array(o, F.lit(datasets.NO_OPTION))))
    raw = _numbers(spark, sf_dir).select(k.alias("question_id"), F.lit("q").alias("question"), spread.alias("options"), (2 * (k % 4)).alias("answer_index"), _expr(PRO_FIELDS).alias("category"), F.lit(" src ").alias("src"))
    out = datasets.mmlu_pro(raw, without=["history"], per_category=20, options=7, seed=9)
    return out.select("original_index", F.col("additional_fields")["category"].alias("category"), "answer_idx", "groundtruth", F.array_join("choices", "|").alias("choices"))
