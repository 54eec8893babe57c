"""Models by folds against plain numpy fits, and their parts on odd rows."""

import numpy as np
import pytest
from corvane.operators import models
from pyspark.sql import functions as F


def area(y, s):
    y, s = np.asarray(y), np.asarray(s)
    p, n = s[y == 1], s[y == 0]
    return None if not len(p) or not len(n) else float(((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n)))


def plain_fit(x, y, role, *, looks, steps, patience, rate, l2):
    """One fold in dense numpy: full-batch Adam, stopped by the validation area."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    t, v = role == "train", role == "val"
    n0, n1 = (y[t] == 0).sum(), (y[t] == 1).sum()
    cw = np.where(y == 1, (n0 + n1) / (2 * n1), (n0 + n1) / (2 * n0)) / (n0 + n1)
    w, m, u, taken = np.zeros(x1.shape[1]), 0, 0, 0
    best, top, left = w.copy(), -1, patience
    for _ in range(looks):
        for _ in range(steps):
            g = x1[t].T @ ((1 / (1 + np.exp(-x1[t] @ w)) - y[t]) * cw[t]) + l2 * np.append(w[:-1], 0)
            taken += 1
            m, u = 0.9 * m + 0.1 * g, 0.999 * u + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9**taken)) / (np.sqrt(u / (1 - 0.999**taken)) + 1e-8)
        a = area(y[v], 1 / (1 + np.exp(-x1[v] @ w)))
        if a > top + 1e-9:
            best, top, left = w.copy(), a, patience
        else:
            left -= 1
            if not left:
                break
    return best, top


@pytest.fixture(scope="module")
def folds(spark):
    rng = np.random.default_rng(4)
    data, rows = {}, []
    for f in ("a", "b"):
        x = rng.standard_normal((240, 8)) * (rng.random((240, 8)) < 0.5)
        y = (x @ rng.standard_normal(8) + rng.standard_normal(240) > 0.3).astype(int)
        role = np.array(["train", "val", "test", "train"] * 60)
        data[f] = (x, y, role)
        rows += [(f, str(r), int(b), np.flatnonzero(v).tolist(), v[v != 0].tolist(), i) for i, (v, b, r) in enumerate(zip(x, y, role, strict=True))]
    rows += [("a", "train", None, [0], [9.0], 900), ("zzz", "train", 1, [0], [9.0], 901), ("a", "other", 1, [0], [9.0], 902), ("a", "test", 1, [], [], 903)]
    return data, spark.createDataFrame(rows, "fold string, role string, y int, idx array<int>, val array<double>, key long").repartition(5)


def test_all_folds_equal_plain_fits(spark, folds):
    data, df = folds
    options = {"looks": 4, "steps": 5, "patience": 2, "rate": 0.1, "l2": 1e-3}
    fitted = models.fit_logistic(df, ["a", "b", "none"], 8, **options)
    for i, f in enumerate("ab"):
        w, top = plain_fit(*data[f], **options)
        assert np.abs(fitted.w[i] - w).max() < 1e-9 and abs(fitted.area[i] - top) < 1e-12
    assert not fitted.w[2].any() and fitted.area[2] is None and fitted.steps[2] == 0
    p = fitted.predict(df, ["key", "role", "y"])
    got = {(r["fold"], r["role"]): r["auroc"] for r in models.evaluate(p, ["val", "test"]).collect()}
    for i, f in enumerate("ab"):
        x, y, role = data[f]
        s = np.hstack([x, np.ones((len(x), 1))]) @ fitted.w[i]
        if f == "b":
            assert abs(got[f, "test"] - area(y[role == "test"], s[role == "test"])) < 1e-12
        assert got[f, "test"] > 0.75 and abs(got[f, "val"] - fitted.area[i]) < 1e-12
    assert p.where("fold = 'zzz'").count() == 0 and p.where("key = 903").count() == 1
    mean = {r["key"]: (r["score"], r["n_folds"]) for r in models.ensemble(p.where("key < 240"), "key").collect()}
    assert len(mean) == 240 and all(n == 2 for _, n in mean.values())


def test_validation_of_one_class_stops_nothing(folds):
    _, df = folds
    one = df.where("role <> 'val' or y = 1")
    fitted = models.fit_logistic(one, ["a"], 8, looks=2, steps=3, patience=1)
    assert fitted.area == [None] and fitted.steps == [6]


def test_grams(spark):
    df = spark.createDataFrame([(["x", "y", "z"],), (["x"],), ([],)], "w array<string>")
    assert [r["g"] for r in df.coalesce(1).select(models.grams(F.col("w"), 3).alias("g")).collect()] == [["x", "y", "z", "x y", "y z", "x y z"], ["x"], []]


def test_vocabulary_reads_training_rows_alone_and_breaks_ties_by_name(spark):
    rows = [("f", "train", k, w.split()) for k, w in enumerate(["b a", "a b", "c a", "c d d d", "d"])] + [("f", "test", 9, ["e"] * 9), ("f", "val", 10, ["e", "e"])]
    df = spark.createDataFrame(rows, "fold string, role string, key long, w array<string>")
    v = {r["term"]: r for r in models.fit_tfidf(df, "w", "key", ["f"], max_features=3, min_df=2, n=1).collect()}
    assert sorted(v) == ["a", "b", "d"] and [v[t]["place"] for t in "abd"] == [0, 1, 2] and v["d"]["df"] == 2  # d: four times in two rows; b before c
    assert abs(v["a"]["idf"] - (np.log(6 / 4) + 1)) < 1e-12
    x = {r["key"]: r for r in models.transform_tfidf(df, models.fit_tfidf(df, "w", "key", ["f"], max_features=3, min_df=2, n=1), "w", "key", n=1).collect()}
    assert x[9]["idx"] == [] and x[3]["idx"] == [2] and abs(x[3]["val"][0] - 1) < 1e-12 and abs(np.linalg.norm(x[0]["val"]) - 1) < 1e-12 and "w" not in x[0].asDict()


def test_standardised_by_training_rows(spark):
    rng = np.random.default_rng(1)
    v = np.hstack([rng.standard_normal((60, 2)) * 1e-3 + 1e6, np.full((60, 1), 7.0)])
    role = ["train"] * 40 + ["val"] * 20
    df = spark.createDataFrame([("f", r, i, x.tolist()) for i, (r, x) in enumerate(zip(role, v, strict=True))], "fold string, role string, key long, v array<double>").repartition(7)
    got = {r["key"]: r["val"] for r in models.standardise(df, "v").collect()}
    sd = v[:40].std(axis=0)
    sd[2] = 1
    assert np.allclose([got[i] for i in range(60)], (v - v[:40].mean(axis=0)) / sd, atol=1e-4)


def test_rows_stay_where_they_are_and_words_are_read_once_a_pass(spark):
    rows = [(f, "train" if k % 2 else "val", k, [*"abc"[: k % 4], None, "d"], k % 2) for k in range(40) for f in "xy"]
    df = spark.createDataFrame(rows, "fold string, role string, key long, w array<string>, y int").repartition(3)
    vocabulary = models.fit_tfidf(df, "w", "key", ["x", "y"], max_features=5, min_df=2)
    plan = vocabulary._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Generate" not in plan.split("MapInArrow")[1]  # both folds in one pass, no row a word
    x = models.transform_tfidf(df, vocabulary, "w", "key")
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and not any(n in plan for n in ("Join", "Aggregate", "Generate", "Window"))
    for f in "xy":
        assert [r["term"] for r in vocabulary.where(F.col("fold") == f).orderBy("place").collect()] == ["a", "a b", "a d", "b", "d"]
    got = x.where("key = 2 and fold = 'y'").first()
    assert got["idx"] == [0, 1, 3, 4] and got["role"] == "val" and x.count() == 80 and abs(np.linalg.norm(got["val"]) - 1) < 1e-12


def test_a_step_is_a_job_of_one_stage(spark, folds):
    _, df = folds
    sc = spark.sparkContext
    blocks = models._packed(df.where("fold = 'a' and y is not null"), {"a": 0}).cache()
    blocks.count()
    stages = {}
    for name, run in (("count", blocks.count), ("step", lambda: models._sums(blocks, lambda y, fold, row, place, value: np.array([[len(y), value.sum()]]), (1, 2)))):
        sc.setJobGroup(name, name)
        total = run()
        stages[name] = [len(sc.statusTracker().getJobInfo(j).stageIds) for j in sc.statusTracker().getJobIdsForGroup(name)]
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(stages["step"]) == 1 and stages["step"] == stages["count"]  # no shuffle of its own
    assert total[0, 0] == 242 and np.isclose(total[0, 1], folds[0]["a"][0].sum() + 9.0)
    many = models._sums(blocks.repartition(7), lambda y, *rest: np.full((1, models.COLLECTED), len(y)), (1, models.COLLECTED))
    assert (many == 242).all()
