"""Queries of models by folds: vocabularies, features, and the areas of a text probe and of a linear probe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import tails, text
from corvane.operators import batches, models
from corvane.plans.adapters import ROLLOUTS, rollouts, table
from corvane.plans.core_queries import STOP, STOP_SQL, base, query, rounded

FOLDS = ["0", "1", "2"]
MAX_FEATURES, MIN_DF = 300, 3


def _folds(rows: DataFrame, key: str) -> DataFrame:
    """Each row once a fold: a third of the keys is a fold's test, a fifth of the others its validation."""
    k = F.col(key)
    fold = F.explode(F.array(*map(F.lit, FOLDS))).alias("fold")
    role = F.when(k % 3 == F.col("fold").cast("int"), "test").when(k % 5 == 0, "val").otherwise("train")
    return rows.select("*", fold).withColumn("role", role)


def text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, y, words, fold, role) of the labelled documents."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    words = F.coalesce(text.normalised_words(F.col("text"), STOP), F.array().cast("array<string>"))
    return _folds(d.select("doc_id", F.col("quality").alias("y"), words.alias("words")), "doc_id")


def vocabulary(rows: DataFrame) -> DataFrame:
    return models.fit_tfidf(rows, "words", "doc_id", FOLDS, max_features=MAX_FEATURES, min_df=MIN_DF)


VOCABULARY = f"""WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), lambda w: length(w) >= 3 AND w NOT IN {STOP_SQL}) AS w FROM documents JOIN labels USING (doc_id)),
g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM d), tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY ALL),
f AS (SELECT unnest([0, 1, 2]) AS fold), ro AS (SELECT fold, doc_id, CASE WHEN doc_id % 3 = fold THEN 'test' WHEN doc_id % 5 = 0 THEN 'val' ELSE 'train' END AS role FROM d, f),
s AS (SELECT fold, term, count(*) AS df, sum(tf) AS n FROM tf JOIN ro USING (doc_id) WHERE role = 'train' GROUP BY ALL HAVING count(*) >= {MIN_DF}),
top AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY n DESC, term) AS k FROM s), sz AS (SELECT fold, count(*) AS rows FROM ro WHERE role = 'train' GROUP BY ALL),
v AS (SELECT CAST(fold AS VARCHAR) AS fold, term, CAST(row_number() OVER (PARTITION BY fold ORDER BY term) - 1 AS INTEGER) AS place, df, ln((1 + rows) / (1 + df)::DOUBLE) + 1 AS idf FROM top JOIN sz USING (fold) WHERE k <= {MAX_FEATURES})"""


@query(VOCABULARY + " SELECT fold, term, place, df, round(idf, 6) AS idf FROM v")
def tfidf_vocabulary(spark, sf_dir):
    return rounded(vocabulary(text_rows(spark, sf_dir)), "idf")


@query(
    VOCABULARY
    + """, x AS (SELECT v.fold, doc_id, place, (1 + ln(tf)) * idf AS x FROM tf JOIN v USING (term)), y AS (SELECT fold, doc_id, place, x / sqrt(sum(x * x) OVER (PARTITION BY fold, doc_id)) AS x FROM x),
z AS (SELECT fold, doc_id, count(*) AS n_terms, round(sum(x), 5) AS total, round(sum(x * place), 3) AS placed FROM y GROUP BY ALL)
SELECT CAST(ro.fold AS VARCHAR) AS fold, ro.doc_id, role, coalesce(n_terms, 0) AS n_terms, coalesce(total, 0) AS total, coalesce(placed, 0) AS placed FROM ro LEFT JOIN z ON CAST(ro.fold AS VARCHAR) = z.fold AND ro.doc_id = z.doc_id"""
)
def tfidf_features(spark, sf_dir):
    rows = text_rows(spark, sf_dir)
    x = models.transform_tfidf(rows, vocabulary(rows), "words", "doc_id")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    placed = F.zip_with("idx", "val", lambda i, v: i * v)
    return x.select("fold", "doc_id", "role", F.size("idx").cast("long").alias("n_terms"), F.round(total(F.col("val")), 5).alias("total"), F.round(total(placed), 3).alias("placed"))


def text_probe(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, models.Models]:
    rows = text_rows(spark, sf_dir)
    x = models.transform_tfidf(rows, vocabulary(rows), "words", "doc_id")
    return x, models.fit_logistic(x, FOLDS, MAX_FEATURES)


@query()
def probe_tfidf(spark, sf_dir):
    """(fold, role, n_pos, n_neg, auroc): quality of documents by their words."""
    x, fitted = text_probe(spark, sf_dir)
    return rounded(models.evaluate(fitted.predict(x, ["role", "y"]), ["val", "test"]), "auroc")


def vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, y, fold, role, idx, val): the embeddings, standardised by each fold's training rows."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null and label is not null")
    rows = e.select("vec_id", (F.col("label") % 2).alias("y"), F.col("embedding").cast("array<double>").alias("v"))
    return models.standardise(_folds(rows, "vec_id"), "v")


@query()
def probe_linear(spark, sf_dir):
    """(fold, role, n_pos, n_neg, auroc): a linear probe of the embeddings for the parity of their label."""
    x = vector_rows(spark, sf_dir)
    size = (x.agg(F.max(F.array_max("idx")).alias("d")).first()["d"] or 0) + 1
    fitted = models.fit_logistic(x, FOLDS, size)
    return rounded(models.evaluate(fitted.predict(x, ["role", "y"]), ["val", "test"]), "auroc")


@query()
def probe_ensemble(spark, sf_dir):
    """(doc_id, score, n_folds): the mean score of the folds' text probes for every labelled document."""
    x, fitted = text_probe(spark, sf_dir)
    return rounded(models.ensemble(fitted.predict(x, ["doc_id"]), "doc_id"), "score")


# ---------------------------------------------------------------- batches and posterior intervals

MOST_TOKENS, MOST_ROWS, BUCKETS = 20_000, 8, 8


@query(
    f"""WITH RECURSIVE r AS ({ROLLOUTS}), o AS (SELECT rollout_id, trace_token_len AS len, row_number() OVER (ORDER BY sha256('5:' || rollout_id), rollout_id) - 1 AS place FROM r),
s AS (SELECT *, place // {MOST_ROWS * BUCKETS} AS chunk FROM o), t AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY len, place) AS k FROM s),
w AS (SELECT chunk, k, rollout_id, len, CAST(0 AS BIGINT) AS batch, CAST(1 AS BIGINT) AS n FROM t WHERE k = 1 UNION ALL
SELECT t.chunk, t.k, t.rollout_id, t.len, CASE WHEN w.n + 1 > {MOST_ROWS} OR (w.n + 1) * t.len > {MOST_TOKENS} THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.n + 1 > {MOST_ROWS} OR (w.n + 1) * t.len > {MOST_TOKENS} THEN 1 ELSE w.n + 1 END
FROM w JOIN t ON t.chunk = w.chunk AND t.k = w.k + 1)
SELECT rollout_id, chunk, batch, count(*) OVER b AS batch_rows, CAST(count(*) OVER b * max(len) OVER b AS BIGINT) AS padded FROM w WINDOW b AS (PARTITION BY chunk, batch)"""
)
def token_batches(spark, sf_dir):
    r = rollouts(spark, sf_dir).select("rollout_id", "trace_token_len")
    return batches.token_batches(r, "rollout_id", "trace_token_len", most_tokens=MOST_TOKENS, most_rows=MOST_ROWS, buckets=BUCKETS, seed=5).drop("trace_token_len")


def alpha_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = base(spark, sf_dir).where("exclude_reason is null")
    return clean.groupBy("subject_model", "dataset", "hint_style", "n_options").agg(F.count("*").alias("n"), F.count_if("to_hint").alias("k"), F.count_if(F.col("changed") & ~F.col("to_hint")).alias("other"))


@query()
def posterior_intervals(spark, sf_dir):
    """(cell, n, k, other, p_low, p_high, x_low, x_high): Jeffreys bounds of the share that follows the cue, and of the noise it leaves, by draws of both posteriors."""
    # few rows with much work each: dealt by number, which adaptive execution leaves alone
    g = alpha_counts(spark, sf_dir).repartition(4 * spark.sparkContext.defaultParallelism, "subject_model", "dataset", "hint_style")
    low, high = tails.jeffreys_interval(F.col("k"), F.col("n"))
    x = tails.ratio_interval(F.col("n"), F.col("k"), F.col("other"), F.col("n_options"), F.concat_ws("|", "subject_model", "dataset", "hint_style"))
    g = g.withColumns({"p_low": low, "p_high": high, "x": x})
    return rounded(g.withColumns({"x_low": F.col("x.low"), "x_high": F.col("x.high")}).drop("x", "n_options"), "p_low", "p_high", "x_low", "x_high")
