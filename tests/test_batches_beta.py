"""Token-budget batches against the sequential form, beta quantiles against plain bisection."""

import math
import random

import numpy as np
import pytest
from corvane.functions import tails
from corvane.operators import batches
from pyspark.sql import functions as F


def sequential(lengths, most_tokens, most_rows, chunk):
    out = []
    for c in range(0, len(lengths), chunk):
        part = sorted(range(c, min(c + chunk, len(lengths))), key=lambda i: lengths[i])
        now = []
        for i in part:
            if now and (len(now) + 1 > most_rows or max(lengths[j] for j in [*now, i]) * (len(now) + 1) > most_tokens):
                out.append(now)
                now = []
            now.append(i)
        out.append(now)
    return {frozenset(b) for b in out if b}


@pytest.mark.parametrize("seed", range(3))
def test_batches_equal_the_sequential_form(spark, seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 5, rng.randint(1, 400), 5000]) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(lengths)), "k long, n long").repartition(6)
    got = {}
    for r in batches.token_batches(df, "k", "n", most_tokens=900, most_rows=7, buckets=4, shuffle=False).collect():
        got.setdefault((r["chunk"], r["batch"]), []).append(r)
    assert {frozenset(r["k"] for r in b) for b in got.values()} == sequential(lengths, 900, 7, 28)
    for b in got.values():
        assert {(r["batch_rows"], r["padded"]) for r in b} == {(len(b), len(b) * max(r["n"] for r in b))} and len(b) <= 7 and (len(b) == 1 or b[0]["padded"] <= 900)


def test_shuffled_batches_depend_on_the_seed_alone(spark):
    df = spark.createDataFrame([(f"r{i}", i % 90 if i % 7 else None) for i in range(300)], "k string, n long")
    run = lambda d, s: sorted((r["k"], r["chunk"], r["batch"], r["padded"]) for r in batches.token_batches(d, "k", "n", most_tokens=300, most_rows=8, buckets=3, seed=s).collect())
    one = run(df.repartition(7), 1)
    assert one == run(df.coalesce(1), 1) != run(df, 2) and len(one) == 300
    places = sorted(r["p"] for r in batches.shuffled_place(df, "k", 3, "p").collect())
    assert places == list(range(300))
    assert batches.token_batches(df.where("false"), "k", "n", most_tokens=1, most_rows=1).collect() == []
    with pytest.raises(ValueError):
        batches.token_batches(df, "k", "n", most_tokens=0, most_rows=1)


def test_rows_are_dealt_by_cell_and_by_chunk_without_hashes(spark):
    df = spark.createDataFrame([(f"r{i}", i % 90) for i in range(300)], "k string, n long")
    made = batches.token_batches(df, "k", "n", most_tokens=300, most_rows=8, buckets=3, seed=1)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "FlatMapGroups" not in plan and made.columns == ["k", "n", "chunk", "batch", "batch_rows", "padded"]
    below = [x.split("_h#")[0] for x in plan.split("RepartitionByExpression")[1:]]
    assert len(below) == 2 and "sha2" not in plan.split("RepartitionByExpression")[-1].split("Project")[0]
    many = batches.token_batches(spark.range(30_000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 7).alias("n")), "k", "n", most_tokens=40, most_rows=5, buckets=2).collect()
    sizes = {}
    for r in many:
        sizes.setdefault((r["chunk"], r["batch"]), []).append(r)
    assert len(many) == 30_000 and all(len(b) == b[0]["batch_rows"] and b[0]["padded"] == len(b) * max(r["n"] for r in b) for b in sizes.values())
    assert {c: sum(len(b) for (d, _), b in sizes.items() if d == c) for c in (0, 2999)} == {0: 10, 2999: 10}


def test_prefix_lengths(spark):
    rows = spark.range(2000).select((F.col("id") % 50).alias("n"), batches.prefix_lengths(F.col("id") % 50, 0.3, F.lit(1), F.col("id")).alias("p")).collect()
    assert all(max(1, math.ceil(0.3 * r["n"] - 1e-9)) <= r["p"] <= max(1, r["n"]) for r in rows)
    assert {r["p"] for r in rows if r["n"] == 10} == set(range(3, 11))


def plain_tail(a, b, x):
    """I_x(a, b) of halves of odd numbers, from the arcsine law by adding 1 to one parameter after the other."""
    out, p, q = 2 / math.pi * math.asin(math.sqrt(x)), 0.5, 0.5
    edge = lambda c: math.exp(p * math.log(x) + q * math.log1p(-x) + math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q)) / c
    while q < b:
        out, q = out + edge(q), q + 1
    while p < a:
        out, p = out - edge(p), p + 1
    return out


def test_beta_tail_and_quantile_equal_plain_forms(spark):
    cases = [(a, b, u) for a, b in ((0.5, 0.5), (0.5, 30.5), (3.5, 1.5), (12.5, 88.5), (250.5, 1.5), (1.0, 1.0), (40.0, 60.0), (4000.5, 6000.5)) for u in (1e-6, 0.025, 0.4, 0.975)]
    df = spark.createDataFrame(cases, "a double, b double, u double")
    out = df.withColumn("x", tails.beta_quantile(F.col("u"), F.col("a"), F.col("b")))
    for r in out.withColumn("back", tails.beta_tail(F.col("a"), F.col("b"), F.col("x"))).collect():
        assert abs(r["back"] - r["u"]) < 1e-11, r
        if r["a"] % 1 and r["x"] < 1:
            assert abs(plain_tail(r["a"], r["b"], r["x"]) - r["u"]) < 1e-9, r
    uniform = [r["x"] for r in out.where("a = 1 and b = 1").orderBy("u").collect()]
    assert all(abs(x - u) < 1e-11 for x, u in zip(uniform, (1e-6, 0.025, 0.4, 0.975), strict=True))
    arcsine = {r["u"]: r["x"] for r in out.where("a = 0.5 and b = 0.5").collect()}
    assert all(abs(x - math.sin(math.pi * u / 2) ** 2) < 1e-9 for u, x in arcsine.items())


def test_quantiles_of_whole_parameters_equal_bisection_of_binomial_sums(spark):
    def tail(a, b, x):
        return math.fsum(math.comb(a + b - 1, j) * x**j * (1 - x) ** (a + b - 1 - j) for j in range(a, a + b))

    cases = [(a, b, u) for a, b in ((1, 1), (3, 7), (1, 12), (25, 2), (40, 60), (90, 5)) for u in (1e-5, 0.025, 0.31, 0.5, 0.975)]
    df = spark.createDataFrame(cases, "a int, b int, u double")
    for r in df.withColumn("x", tails.beta_quantile(F.col("u"), F.col("a"), F.col("b"))).collect():
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if tail(r["a"], r["b"], mid) < r["u"] else (lo, mid)
        assert abs(r["x"] - lo) < 1e-9 and abs(tails._beta_quantiles(np.array([r["u"]]), r["a"], r["b"])[0] - lo) < 1e-9, r


def test_beta_at_its_ends(spark):
    row = spark.range(1).select(
        tails.beta_tail(F.lit(2.0), F.lit(3.0), F.lit(0.0)).alias("zero"), tails.beta_tail(F.lit(2.0), F.lit(3.0), F.lit(1.5)).alias("one"), tails.beta_tail(F.lit(0.0), F.lit(3.0), F.lit(0.5)).alias("bad"),
        tails.beta_quantile(F.lit(0.0), F.lit(2.0), F.lit(3.0)).alias("low"), tails.beta_quantile(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("high"), tails.beta_quantile(F.lit(1.5), F.lit(2.0), F.lit(3.0)).alias("out"),
    ).first()
    assert tuple(row) == (0.0, 1.0, None, 0.0, 1.0, None)


def test_ratio_interval(spark):
    rows = [(100, 40, 20, 4, "a"), (100, 40, 0, 4, "b"), (100, 0, 5, 4, "c"), (0, 0, 0, 4, "d"), (50, 3, 40, 5, "e")]
    df = spark.createDataFrame(rows, "n long, k long, o long, m int, key string")
    got = {r["key"]: r["x"] for r in df.select("key", tails.ratio_interval(F.col("n"), F.col("k"), F.col("o"), F.col("m"), F.col("key"), 1000).alias("x")).collect()}
    assert got["c"] is None and got["d"] is None and got["e"]["high"] == 1.0 and got["b"]["high"] > 0
    rng = np.random.default_rng(0)
    x = np.minimum(1, rng.beta(20.5, 80.5, 200_000) / (2 * rng.beta(40.5, 60.5, 200_000)))
    assert abs(got["a"]["low"] - np.percentile(x, 2.5)) < 0.01 and abs(got["a"]["high"] - np.percentile(x, 97.5)) < 0.02
