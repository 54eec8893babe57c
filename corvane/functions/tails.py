"""Tail probabilities as columns: incomplete gamma, chi-square, binomial; and the tests built on them."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators import joins


def log_gamma(a: Column) -> Column:
    """The logarithm of the gamma function of a positive number: Stirling's series ten places up, stepped back down."""
    z = a + 10
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    product = a
    for k in range(1, 10):
        product = product * (a + k)
    return series - F.log(product)


def upper_gamma(a: Column, x: Column) -> Column:
    """The regularised upper incomplete gamma function; 1 where x is not positive, null where a is not.

    Below a + 1 one minus the lower function's power series, above it the continued fraction.
    """
    a, x = a.cast("double"), x.cast("double")
    scale = F.exp(a * F.log(x) - x - log_gamma(a))
    one = F.lit(1.0)
    steps = F.sequence(F.lit(1), F.ceil(a).cast("int") + 200)
    lower = F.aggregate(
        steps,
        F.struct((one / a).alias("term"), (one / a).alias("total")),
        lambda s, n: F.struct((s["term"] * x / (a + n)).alias("term"), (s["total"] + s["term"] * x / (a + n)).alias("total")),
        lambda s: s["total"],
    )
    first = one / (x + 1 - a)

    def fraction(s: Column, n: Column) -> Column:
        over = -n * (n - a)
        under = x + 1 - a + 2 * n
        d = one / (over * s["d"] + under)
        c = under + over / s["c"]
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    upper = F.aggregate(steps, F.struct(F.lit(1e300).alias("c"), first.alias("d"), first.alias("h")), fraction, lambda s: s["h"])
    value = F.when(x < a + 1, F.greatest(F.lit(0.0), 1 - scale * lower)).otherwise(scale * upper)
    return F.when(a > 0, F.when(x <= 0, one).otherwise(value))


def _bind(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def beta_tail(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b): 0 up to x = 0, 1 from 1 on, null where a or b is not positive.

    The continued fraction, on the side of the mean where it converges fast; as many terms as the parameters' size needs.
    """
    a, b, x = (c.cast("double") for c in (a, b, x))
    inside = F.struct(a.alias("a"), b.alias("b"), x.alias("x"))

    def value(s: Column) -> Column:
        a, b, x = s["a"], s["b"], s["x"]
        low = x < (a + 1) / (a + b + 2)
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
        side = F.when(low, F.struct(a.alias("p"), b.alias("q"), x.alias("z"))).otherwise(F.struct(b.alias("p"), a.alias("q"), (1 - x).alias("z")))
        part = _bind(side, lambda t: front * _beta_fraction(t["p"], t["q"], t["z"]) / t["p"])
        return F.when(low, part).otherwise(1 - part)

    known = (a > 0) & (b > 0) & x.isNotNull()
    return F.when(known, F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(_bind(inside, value)))


def _beta_fraction(p: Column, q: Column, z: Column) -> Column:
    """1 / (1 + d1 / (1 + d2 / (1 + ...))) of the incomplete beta function, worked off from its far end."""
    terms = (40 + 3 * F.ceil(F.sqrt(F.greatest(p, q)))).cast("int")

    def step(tail: Column, k: Column) -> Column:
        n = (terms - k + 1).cast("double")  # pairs of coefficients, last first
        even = n * (q - n) * z / ((p + 2 * n - 1) * (p + 2 * n))
        odd = -(p + n - 1) * (p + q + n - 1) * z / ((p + 2 * n - 2) * (p + 2 * n - 1))
        return 1 + odd / (1 + even / tail)

    return 1 / F.aggregate(F.sequence(F.lit(1), terms), F.lit(1.0), step)


def beta_quantile(share: Column, a: Column, b: Column) -> Column:
    """The x at which I_x(a, b) is ``share``: Newton's steps inside a bracket that every step narrows; null where a or b is not positive or share outside [0, 1]."""
    given = F.struct(share.cast("double").alias("u"), a.cast("double").alias("a"), b.cast("double").alias("b"))

    def solved(g: Column) -> Column:
        u, a, b = g["u"], g["a"], g["b"]
        norm = log_gamma(a + b) - log_gamma(a) - log_gamma(b)
        start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), (a / (a + b)).alias("x"), F.lit(False).alias("done"))

        def step(s: Column, _: Column) -> Column:
            def moved(f: Column) -> Column:
                lo, hi = F.when(f < 0, s["x"]).otherwise(s["lo"]), F.when(f < 0, s["hi"]).otherwise(s["x"])
                slope = F.exp(norm + (a - 1) * F.log(s["x"]) + (b - 1) * F.log(1 - s["x"]))
                newton = s["x"] - F.try_divide(f, slope)
                inner = F.coalesce((newton > lo) & (newton < hi), F.lit(False))
                x = F.when(inner, newton).otherwise((lo + hi) / 2)
                return F.struct(lo.alias("lo"), hi.alias("hi"), x.alias("x"), (F.abs(x - s["x"]) <= 1e-15 * s["x"]).alias("done"))

            def judged(f: Column) -> Column:
                # beyond this the tail's own rounding decides
                there = F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"), s["x"].alias("x"), F.lit(True).alias("done"))
                return F.when(F.abs(f) <= 2e-12 * u, there).otherwise(moved(f))

            return F.when(s["done"], s).otherwise(_bind(beta_tail(a, b, s["x"]) - u, judged))

        return F.aggregate(F.sequence(F.lit(1), F.lit(120)), start, step, lambda s: s["x"])

    known = (a > 0) & (b > 0) & share.between(0.0, 1.0)
    return F.when(known, F.when(share == 0, 0.0).when(share == 1, 1.0).otherwise(_bind(given, solved)))


def jeffreys_interval(k: Column, n: Column, level: float = 0.95) -> tuple[Column, Column]:
    """The bounds of a share of k in n under Jeffreys' prior; null where n is 0."""
    tail = (1 - level) / 2
    low, high = (F.when(n > 0, beta_quantile(F.lit(t), k + 0.5, n - k + 0.5)) for t in (tail, 1 - tail))
    return low, high


def _beta_quantiles(u: np.ndarray, a: float, b: float) -> np.ndarray:
    """``beta_quantile`` of many shares under one pair of parameters, by halving."""
    norm = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)

    def tail(x: np.ndarray) -> np.ndarray:
        low = x < (a + 1) / (a + b + 2)
        p, q, z = np.where(low, a, b), np.where(low, b, a), np.where(low, x, 1 - x)
        end = np.ones_like(x)
        for n in range(40 + 3 * math.ceil(math.sqrt(max(a, b))), 0, -1):
            even = n * (q - n) * z / ((p + 2 * n - 1) * (p + 2 * n))
            end = 1 - (p + n - 1) * (p + q + n - 1) * z / ((p + 2 * n - 2) * (p + 2 * n - 1)) / (1 + even / end)
        part = np.exp(norm + a * np.log(x) + b * np.log1p(-x)) / (p * end)
        return np.where(low, part, 1 - part)

    lo, hi = np.zeros_like(u), np.ones_like(u)
    for _ in range(44):
        mid = (lo + hi) / 2
        under = tail(mid) < u
        lo, hi = np.where(under, mid, lo), np.where(under, hi, mid)
    return (lo + hi) / 2


def ratio_interval(n: Column, k: Column, other: Column, options: Column, key: Column, draws: int = 2000, level: float = 0.95) -> Column:
    """(low, high) of min(1, q / ((options - 2) p)), p the share of k and q that of ``other`` in n, from draws of both Jeffreys posteriors.

    Draws are the posteriors' quantiles at numbers that ``key`` seeds, so that they depend on nothing else.  Null
    where n or k is 0 or options are two or fewer; with ``other`` 0 the upper bound is still above 0.
    """
    tail = 100 * (1 - level) / 2

    @F.pandas_udf("low double, high double")
    def drawn(n: pd.Series, k: pd.Series, other: pd.Series, options: pd.Series, key: pd.Series) -> pd.DataFrame:
        rows = []
        for n_, k_, o_, m_, name in zip(n, k, other, options, key, strict=True):
            if not (n_ > 0 and k_ > 0 and m_ > 2):
                rows.append((None, None))
                continue
            rng = np.random.default_rng(int.from_bytes(hashlib.sha256(str(name).encode()).digest()[:8], "big"))
            p, q = (_beta_quantiles(rng.random(draws), c + 0.5, n_ - c + 0.5) for c in (k_, o_))
            x = np.minimum(1.0, q / ((m_ - 2) * p))
            rows.append((float(np.percentile(x, tail)), float(np.percentile(x, 100 - tail))))
        return pd.DataFrame(rows, columns=["low", "high"])

    made = drawn(n, k, other, options, key)
    return F.when((n > 0) & (k > 0) & (options > 2), made)


def chi2_tail(x: Column, df: Column) -> Column:
    """The probability that a chi-square variable of ``df`` degrees exceeds x."""
    return upper_gamma(df / F.lit(2.0), x / F.lit(2.0))


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """The probability of k or more successes of n, from the side of k that has fewer terms to lose."""
    k, n = k.cast("long"), n.cast("long")

    def term(j: Column) -> Column:
        lg = lambda c: log_gamma(c.cast("double") + 1)
        return F.exp(lg(n) - lg(j) - lg(n - j) + j * F.log(p) + (n - j) * F.log(1 - p))

    def total(start: Column, steps: Column, ratio) -> Column:
        return F.aggregate(
            steps,
            F.struct(term(start).alias("term"), term(start).alias("total")),
            lambda s, j: F.struct((s["term"] * ratio(j)).alias("term"), (s["total"] + s["term"] * ratio(j)).alias("total")),
            lambda s: s["total"],
        )

    none = F.array().cast("array<bigint>")
    upwards = total(k, F.when(k < n, F.sequence(k, n - 1)).otherwise(none), lambda j: (n - j) / (j + 1) * p / (1 - p))
    downwards = total(k - 1, F.when(k > 1, F.sequence(k - 1, F.lit(1).cast("long"), F.lit(-1).cast("long"))).otherwise(none), lambda j: j / (n - j + 1) * (1 - p) / p)
    return F.when(k <= 0, 1.0).when(k > n, 0.0).when(k > n * p, F.least(F.lit(1.0), upwards)).otherwise(F.greatest(F.lit(0.0), 1 - downwards))


def pearson(cells: DataFrame, observed: str, expected: str, keys: list[str]) -> DataFrame:
    """(keys, stat, df, p) of one row per category, with its observed and its expected count.

    Counts must have the same total in each group and expectations must be positive: anything else fails the job.
    """
    gap = F.col(observed) - F.col(expected)
    bad = F.when(F.min(expected) <= 0, F.lit("an expected count is not positive")).when(F.abs(F.sum(observed) - F.sum(expected)) > 1e-6 * F.greatest(F.lit(1.0), F.sum(expected)), F.lit("observed and expected totals differ"))
    g = cells.groupBy(*keys).agg(F.sum(F.try_divide(gap * gap, F.col(expected))).alias("stat"), (F.count("*") - 1).alias("df"), bad.alias("_bad"))
    g = joins.required(g, F.col("_bad").isNull(), F.col("_bad")).drop("_bad")
    return g.withColumn("p", chi2_tail(F.col("stat"), F.col("df")))


def pearson_uniform(cells: DataFrame, observed: str, keys: list[str], categories: int) -> DataFrame:
    """``pearson`` against equal shares; ``cells`` need not hold categories that nobody chose."""
    o = F.col(observed)
    g = cells.groupBy(*keys).agg(F.sum(o).alias("n"), F.sum(o * o).alias("_squares"))
    g = g.withColumn("stat", F.col("_squares") * categories / F.col("n") - F.col("n")).withColumn("df", F.lit(categories - 1).cast("long"))
    return g.withColumn("p", chi2_tail(F.col("stat"), F.col("df"))).drop("_squares")


def wald_uniform(rows: DataFrame, support: str, picked: str, keys: list[str]) -> DataFrame:
    """(keys, stat, df): whether each row picked evenly inside its own ``support`` (an array of categories).

    Rows are counted by support first, of which there are few; the quadratic form of a group's counts sees those
    counts only.  A row that picked outside its support raises.
    """
    inside = F.when(F.array_contains(support, F.col(picked)), F.col(picked)).otherwise(F.raise_error(F.lit("a pick outside its support")))
    counts = rows.groupBy(*keys, F.array_sort(support).alias("_support"), inside.alias("_picked")).agg(F.count("*").alias("_n"))

    def form(part: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        names = sorted({c for s in part["_support"] for c in s})
        place = {c: i for i, c in enumerate(names)}
        observed, expected, cross = np.zeros(len(names)), np.zeros(len(names)), np.zeros((len(names),) * 2)
        for s, c, n in zip(part["_support"], part["_picked"], part["_n"], strict=True):
            share = np.zeros(len(names))
            share[[place[x] for x in s]] = 1 / len(s)
            observed[place[c]] += n
            expected += n * share
            cross += n * np.outer(share, share)
        spread = np.diag(expected) - cross
        rank = int(np.linalg.matrix_rank(spread, tol=1e-9 * max(1.0, np.abs(spread).max())))
        gap = observed - expected
        stat = float(gap @ np.linalg.pinv(spread, rcond=1e-10, hermitian=True) @ gap)
        return pd.DataFrame([[*part[keys].iloc[0], stat, rank]], columns=[*keys, "stat", "df"])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", stat double, df long"
    return counts.groupBy(*keys).applyInPandas(form, schema).withColumn("p", chi2_tail(F.col("stat"), F.col("df")))
