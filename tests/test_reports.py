"""Tests of counts and seeds against plain versions, where SQL has no form."""

import zlib

import numpy as np
from corvane.functions import tails, text
from corvane.operators import report
from corvane.plans import registry
from pyspark.sql import functions as F


def test_wald_equals_the_row_by_row_form(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in ("x", "y"):
        for _ in range(200):
            support = sorted(rng.choice(list("ABCDE"), int(rng.integers(1, 5)), replace=False).tolist())
            rows.append((g, support, str(rng.choice(support))))
    df = spark.createDataFrame(rows, "g string, s array<string>, c string")
    got = {r["g"]: r for r in tails.wald_uniform(df, "s", "c", ["g"]).collect()}
    for g in ("x", "y"):
        mine = [(s, c) for h, s, c in rows if h == g]
        share = np.array([[1 / len(s) if x in s else 0 for x in "ABCDE"] for s, _ in mine])
        gap = sum(np.array([c == x for x in "ABCDE"], float) for _, c in mine) - share.sum(axis=0)
        spread = np.diag(share.sum(axis=0)) - share.T @ share
        assert got[g]["df"] == np.linalg.matrix_rank(spread, tol=1e-6)
        assert np.isclose(got[g]["stat"], gap @ np.linalg.pinv(spread, rcond=1e-10) @ gap)


def test_shared_support_gives_pearson(spark):
    df = spark.createDataFrame([("g", list("ABC"), c) for c in "AAAABBCCCCCCC"], "g string, s array<string>, c string")
    wald = tails.wald_uniform(df, "s", "c", ["g"]).first()
    plain = tails.pearson_uniform(df.groupBy("g", "c").count(), "count", ["g"], 3).first()
    assert np.isclose(wald["stat"], plain["stat"]) and wald["df"] == plain["df"] == 2 and np.isclose(wald["p"], plain["p"])


def test_tails_at_their_ends(spark):
    row = spark.range(1).select(
        tails.chi2_tail(F.lit(0.0), F.lit(3)).alias("zero"),
        tails.chi2_tail(F.lit(5000.0), F.lit(3)).alias("far"),
        tails.chi2_tail(F.lit(3.841458820694124), F.lit(1)).alias("five"),
        tails.binomial_tail(F.lit(0), F.lit(9), F.lit(0.5)).alias("all"),
        tails.binomial_tail(F.lit(10), F.lit(9), F.lit(0.5)).alias("none"),
        tails.binomial_tail(F.lit(9), F.lit(9), F.lit(0.5)).alias("last"),
        tails.upper_gamma(F.lit(0.0), F.lit(1.0)).alias("bad"),
    ).first()
    assert row["zero"] == 1 and row["far"] < 1e-300 and abs(row["five"] - 0.05) < 1e-9
    assert row["all"] == 1 and row["none"] == 0 and abs(row["last"] - 0.5**9) < 1e-12 and row["bad"] is None


def test_seeds_equal_zlib(spark, sf_dir):
    for r in registry.queries()["stable_seed"](spark, sf_dir).limit(50).join(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey").collect():
        assert r["seed"] == zlib.crc32(f"7|{r['o_orderkey']}|{r['o_orderstatus']}".encode()) & 0x7FFFFFFF


def test_contradictions(spark):
    rows = [("A", "blue.", ["Blue", "red"], False), ("A", " RED ", ["Blue", "red"], True), ("A", "red", ["red", "red"], False), ("a", "", ["x"], False), ("B", "green", ["x", "y"], False)]
    df = spark.createDataFrame(rows, "letter string, said string, choices array<string>, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", text.contradicts(F.col("letter"), F.col("said"), F.col("choices"))).collect())


def test_sets_of_other_rows_have_no_difference(spark):
    a = spark.createDataFrame([(1, "positive", 0, 0.9), (2, "negative", 1, 0.2)], "id long, case string, label int, p_unfaithful double")
    out = {r["view"]: r for r in report.delta_auroc(a, a.where("id = 1"), "id").collect()}
    assert out["pooled"]["n_unmatched"] == 1 and out["pooled"]["delta_auroc"] is None
