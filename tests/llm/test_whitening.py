"""Whitening against numpy's eigenvectors, on ties, nulls, hot vectors and odd dimensions."""

from fractions import Fraction

import numpy as np
import pytest
from corvane.llm import whitening
from corvane.llm.common import table
from corvane.llm.queries import op11_whitening

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
SCHEMA = "vec_id long, embedding array<float>, x string, component string, n string"


def plain(vectors, components=16):
    """(x, fit list, eigenvalues, eigenvectors) by numpy."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], float)
    u = np.unique(x, axis=0)
    values, turned = np.linalg.eigh(np.cov(u.T, bias=True))
    return x, u, values[::-1][:components], turned[:, ::-1][:, :components]


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "clash", "clash", "clash") for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def matrix(rows, ids, k):
    by = {(r["vec_id"], r["component"]): r for r in rows}
    return np.array([[by[i, c + 1]["whitened"] for c in range(k)] for i in ids])


def test_the_table_equals_numpy(spark, sf_dir):
    got = op11_whitening(spark, sf_dir)
    assert got.columns[:7] == COLUMNS and [t for _, t in got.dtypes[:7]] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    rows = got.collect()
    given = sorted((r["vec_id"], r["embedding"]) for r in table(spark, sf_dir, "embeddings").collect())
    x, u, values, turned = plain([v for _, v in given])
    assert len(rows) == 16 * len(given) and {r["n"] for r in rows} == {len(u)} and max(r["identity_error"] for r in rows) < 1e-10
    w = matrix(rows, [i for i, _ in given], 16)
    want = (x - u.mean(axis=0)) @ turned / np.sqrt(values)
    assert np.abs(w - want * np.sign((w * want).sum(axis=0))).max() < 1e-8
    total, sums = np.trace(np.cov(u.T, bias=True)), u.astype(np.int64).sum(axis=0)
    exact = {i: int(((len(u) * v - sums) ** 2).sum()) for (i, _), v in zip(given, x.astype(np.int64), strict=True)}
    for r in rows:
        assert r["deviation"] == exact[r["vec_id"]] and abs(r["explained"] - values[r["component"] - 1] / total) < 1e-12


def test_more_dimensions_than_three_blocks(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((400, 150)) * np.linspace(3, 0.2, 150)
    rows = whitening.whiten(frame(spark, v.astype(np.float32)), components=5).collect()
    x, u, values, turned = plain(v.astype(np.float32), 5)
    w, want = matrix(rows, range(400), 5), (x - u.mean(axis=0)) @ turned / np.sqrt(values)
    assert np.abs(w - want * np.sign((w * want).sum(axis=0))).max() < 1e-7


def test_lobpcg_certifies_or_raises():
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((200, 200)))[0]
    values = np.concatenate([[9, 7, 7, 5], np.linspace(4, 0, 196)])
    a = (q * values) @ q.T
    got, vectors, _ = whitening.lobpcg(lambda b: a @ b, 200, 6)
    assert np.allclose(got, values[:6], atol=1e-11) and np.linalg.norm(a @ vectors - vectors * got, axis=0).max() < 3e-11
    assert np.allclose(vectors.T @ vectors, np.eye(6), atol=1e-12)
    with pytest.raises(RuntimeError):
        whitening.lobpcg(lambda b: a @ b, 200, 6, rounds=2)


def test_odd_rows_are_left_out_and_repeats_returned(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((30, 4)).tolist()
    hot = [[0.5, -0.5, 0.25, 1.0]] * 60  # a third and more of all rows
    odd = [None, [], [1.0, None, 2.0, 3.0], [float("nan"), 1, 1, 1], [1, float("inf"), 1, 1], [1.0, 2.0], [1, 1, -float("inf"), 1]]
    vectors = base + hot + odd
    ids = [None if k == 3 else k for k in range(len(base + hot))] + list(range(1000, 1000 + len(odd)))
    rows = whitening.whiten(frame(spark, vectors, ids).repartition(5)).collect()
    assert {r["n"] for r in rows} == {31} and len(rows) == 4 * 90
    assert {r["vec_id"] for r in rows} == set(ids[:90])
    copies = {(r["component"], r["whitened"], r["deviation"]) for r in rows if r["vec_id"] is not None and 30 <= r["vec_id"] < 90}
    assert len(copies) == 4
    x, u, values, turned = plain(base + hot[:1])
    w, want = matrix(rows, range(30, 90), 4), (x[[30] * 60] - u.mean(axis=0)) @ turned[:, :4] / np.sqrt(values[:4])
    assert np.abs(np.abs(w) - np.abs(want)).max() < 1e-9


def test_components_without_variance_do_not_exist(spark):
    flat = [[float(k), 2.0, float(k), 0.0] for k in range(6)]
    rows = whitening.whiten(frame(spark, flat)).collect()
    assert {r["component"] for r in rows} == {1} and max(r["identity_error"] for r in rows) < 1e-10 and abs(rows[0]["explained"] - 1) < 1e-12
    for few in ([[1.0, 2.0]], [[1.0, 2.0]] * 5, [], [None, []]):
        assert whitening.whiten(frame(spark, few)).collect() == []


def test_deviations_are_exact_where_doubles_and_longs_are_not(spark):
    vectors = [[1e9, 3.0], [-1e9, 2.0], [7.0, 1e-9], [1e300, 5.0]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    rows = {(r["vec_id"], r["component"]): r for r in whitening.whiten(df).collect()}
    x = [[max(-(1 << 52), min(1 << 52, int(np.floor(64 * c)))) + 1_000_000 for c in v] for v in vectors]
    sums = [sum(c) for c in zip(*x, strict=True)]
    for i, v in enumerate(x):
        exact = sum((4 * a - s) ** 2 for a, s in zip(v, sums, strict=True))
        assert int(rows[i, 1]["deviation_exact"]) == exact and rows[i, 1]["deviation"] == (exact if exact < 1 << 63 else None)
    middle = whitening.Centre(4, sums)
    assert middle.deviations(np.array(x, np.int64)) == [sum((4 * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    assert np.allclose(middle.rows(np.array(x, np.int64)), [[float(Fraction(4 * a - s, 4)) for a, s in zip(v, sums, strict=True)] for v in x], rtol=1e-15)
