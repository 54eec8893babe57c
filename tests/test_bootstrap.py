"""The bootstrap by blocks of weights against draws made one by one."""

import math
from collections import defaultdict

import numpy as np
import pytest
from corvane.operators import bootstrap, manifest, validation
from corvane.plans import bootstrap_queries
from corvane.plans.adapters import rollouts
from pyspark.sql import functions as F

M = 0xFFFFFFFF


def mix(x):
    x = (x ^ x >> 16) * bootstrap.MIX_1 & M
    x = (x ^ x >> 15) * bootstrap.MIX_2 & M
    return x ^ x >> 16


def draws(seed, stratum, n, rep):
    """The units of one replicate, draw by draw, in plain whole numbers."""
    one, two = map(int, bootstrap.stratum_keys(seed, stratum))
    one, two = mix(one ^ rep), mix(two + rep & M)
    at = lambda a, b, j, m: (mix(j ^ a) ^ mix(j + b & M)) * m >> 32
    out = []
    blocks = defaultdict(int)
    for j in range(n):
        blocks[at(one, two, j, n) // bootstrap.BLOCK] += 1
    for block, c in sorted(blocks.items()):
        size, own = min(bootstrap.BLOCK, n - block * bootstrap.BLOCK), 2 * block + 1
        a, b = mix(one ^ own), mix(two + own & M)
        out += [block * bootstrap.BLOCK + at(a, b, j, size) for j in range(c)]
    return out


@pytest.fixture(scope="module")
def made(spark):
    sizes = {"x": 2500, "y": 30, "z": 1}
    rng = np.random.default_rng(2)
    rows = []
    for s, n in sizes.items():
        for q in range(n):
            for g in ("a", "b", "c"):
                if rng.random() < 0.6:
                    rows.append((s, q, g, float(rng.integers(0, 5)), float(rng.integers(0, 9))))
    rows.append(("y", 3, "hot", 1.0, None))
    units = spark.createDataFrame([(s, q) for s, n in sizes.items() for q in range(n)], "stratum string, qno long")
    return sizes, rows, units, spark.createDataFrame(rows, "stratum string, qno long, grp string, num double, den double")


def test_sums_equal_single_draws(made):
    sizes, rows, units, stats = made
    got = {(r["grp"], r["rep"]): (r["num"], r["den"]) for r in bootstrap.replicate_sums(units, stats.repartition(5), ["num", "den"], reps=6, seed=9).collect()}
    assert len(got) == 4 * 6
    for rep in range(6):
        want = defaultdict(lambda: [0.0, 0.0])
        taken = {s: np.bincount(draws(9, s, n, rep), minlength=n) for s, n in sizes.items()}
        assert all(t.sum() == sizes[s] for s, t in taken.items())
        for s, q, g, a, b in rows:
            want[g][0] += a * taken[s][q]
            want[g][1] += (b or 0) * taken[s][q]
        assert all(got[g, rep] == tuple(want[g]) for g in "abc") and got["hot", rep] == (float(taken["y"][3]), 0.0)


def test_draws_spread_as_a_multinomial(made):
    one, two = bootstrap.rep_keys(1, "s", np.arange(2000))
    w = np.array([np.bincount(bootstrap.drawn(a, b, np.arange(50, dtype=np.uint32), 50).astype(int), minlength=50) for a, b in zip(one, two, strict=True)])
    assert abs(w.mean() - 1) < 1e-12 and abs(w.var() - (1 - 1 / 50)) < 0.03
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1] + 1 / 49) < 0.08 and abs(np.corrcoef(w[:-1, 0], w[1:, 0])[0, 1]) < 0.08


def test_all_questions_are_numbered_and_no_draws_are_broadcast(spark, sf_dir):
    r = manifest.with_manifest_columns(rollouts(spark, sf_dir))
    q = bootstrap.numbered(r.select("dataset", "original_index").distinct())
    got = {(x["dataset"], x["original_index"]): x["qno"] for x in q.collect()}
    assert len(got) == r.select("dataset", "original_index").distinct().count()
    for d in {k for k, _ in got}:
        assert [got[d, i] for k, i in sorted(got) if k == d] == list(range(sum(k == d for k, _ in got)))
    units, rows = bootstrap_queries.counted(r, [])
    sums = bootstrap.replicate_sums(units, bootstrap.with_groups(rows, []), ["num", "den"])
    assert sums.count() == bootstrap.N_BOOT == 10_000
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "mapInArrow" in plan.lower() or "MapInArrow" in plan
    assert "explode" not in plan.split("MapInArrow")[0]


def test_intervals_need_half_of_the_replicates(spark):
    rows = [("some", float(k) if k < 6 else None) for k in range(10)] + [("few", 1.0 if k < 4 else None) for k in range(10)]
    df = spark.createDataFrame(rows, "g string, value double")
    got = {r["g"]: r for r in bootstrap.interval(df, ["g"]).collect()}
    assert got["few"]["ci_low"] is None and got["few"]["undefined_reps"] == 6 and math.isclose(got["some"]["ci_low"], 0.125) and got["some"]["n_defined"] == 6
    p = {r["g"]: r["p"] for r in bootstrap.p_value(df, ["g"]).collect()}
    assert p["few"] is None and math.isclose(p["some"], 2 / 6)


def test_a_group_without_denominator_is_undefined(spark):
    units = spark.createDataFrame([("s", 0), ("s", 1)], "stratum string, qno long")
    rows = spark.createDataFrame([("s", 0, "a", 1, 2), ("s", 1, "b|\"", 0, 0), ("s", 0, None, 3, 3)], "stratum string, qno long, k string, num long, den long")
    got = {r["k"]: r for r in bootstrap.ratio_table(units, rows, ["k"], reps=200).collect()}
    assert got["a"]["point"] == 0.5 and got["b|\""]["point"] is None and got["b|\""]["undefined_reps"] == 200 and got[None]["ci_low"] == 1.0
    assert 20 < got["a"]["undefined_reps"] < 90  # a quarter of the replicates draw the other question twice


def test_sign_contrast(spark):
    units = spark.createDataFrame([("s", k) for k in range(3)], "stratum string, qno long")
    rows = [("s", 0, 5, "g", 3, 1, 3), ("s", 1, 5, "g", 3, 1, 3), ("s", 2, 5, "g", 3, 1, 3)]
    schema = "stratum string, qno long, n_options int, k string, modelled long, measured long, den long"
    v = bootstrap.sign_contrast(units, spark.createDataFrame(rows, schema), ["k"], reps=50).collect()
    assert len(v) == 50 and all(r["value"] == 0.0 for r in v)  # 3 / 3 - 1, exactly
    for odd in ([("s", 0, 2, "g", 1, 1, 1)], [("s", 0, 4, "g", 1 << 60, 0, 1)]):
        with pytest.raises(ValueError):
            bootstrap.sign_contrast(units, spark.createDataFrame(odd, schema), ["k"], reps=5)


def test_gap_of_few_pairs(spark, sf_dir):
    sample, frame = bootstrap_queries.audit_sample(spark, sf_dir)
    pair, cell = ["subject_model", "run"], ["stratum", "hint_style"]
    one = sample.where("subject_model = 'A' and run = 'run_F'")
    assert validation.cross_model_gap(one, frame, pair, cell, reps=20).count() == 0
    with pytest.raises(ValueError):
        validation.cross_model_gap(sample, frame, pair, cell, primary="no|one", reps=20)
    rates = validation.audit_rates(one.withColumn("arbiter_label", F.lit(-1)), frame, pair, cell, "hint_style").collect()
    assert all(r["arbiter_reweighted_rate"] is None and r["arbiter_raw_rate"] is None for r in rates)


def test_level_one_holds_a_row_a_block_and_piece_of_replicates(spark):
    """Counts grow with the blocks alone: no piece of draws has counts of its own."""
    sizes = spark.createDataFrame([("big", 3_000_000), ("small", 5)], "stratum string, n long")
    got = bootstrap._draws(sizes, 60, 3).groupBy("stratum").agg(F.count("*").alias("rows"), F.max(F.length("counts")).alias("bytes")).collect()
    assert {r["stratum"]: (r["rows"], r["bytes"]) for r in got} == {"big": (2930 * 2, 100), "small": (2, 100)}


@pytest.mark.parametrize("n", [1, 1024, 1025, 70_000])
def test_hashes_in_place_name_the_same_draws(n):
    reps = np.arange(3, 6)
    counts = bootstrap.block_counts(9, "x", n, reps)
    blocks = -(-n // bootstrap.BLOCK)
    stats = np.random.default_rng(n).integers(0, 9, (bootstrap.BLOCK, 2)) * np.array([1.0, 0.37])
    every = bootstrap.block_counts(9, "x", n, np.arange(6))[:, -1]
    sums = bootstrap.block_sums(9, "x", n, blocks - 1, every, stats)
    for k, rep in enumerate(reps):
        units = np.array(draws(9, "x", n, int(rep)))
        assert (np.bincount(units // bootstrap.BLOCK, minlength=blocks) == counts[k]).all()
        last = units[units >= (blocks - 1) * bootstrap.BLOCK] - (blocks - 1) * bootstrap.BLOCK
        assert np.allclose(sums[rep], stats[last].sum(axis=0), rtol=1e-12)
