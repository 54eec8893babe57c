"""Whitening of embeddings along their leading principal components, found by LOBPCG.

*Entries.*  Each entry c becomes the long x = floor(64 c) + 1000000; the fit list is each distinct x vector once.

*Centring.*  With S the sums of the n fitted vectors, S = n m + r in whole numbers per dimension, so that a centred
entry is (x - m) - r / n: the difference is exact and no large mean is subtracted from doubles.

*Components.*  LOBPCG on the covariance V, which is never formed: V times a block of directions is a sum over the
centred rows, made in tasks and added up by Spark.  Each round puts the iterate, its residual and the previous
direction block together, takes V times this orthonormal block in one pass, and solves the small Rayleigh-Ritz
problem on the driver.  It ends when residuals |V u - e u| of all components, from a pass over the rows of their own,
are at most ``TOLERANCE`` of the largest eigenvalue.  Only blocks of dimension x at most three block widths reach the
driver; their size does not depend on the number of rows.

*Whitening.*  One pass gives every row its projections over sqrt(e), and the exact sum of (n x - S)^2.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Directions iterated besides those asked for, which speed up the last ones.
GUARD = 8
TOLERANCE = 1e-12
ROUNDS = 500
#: Eigenvalues below this share of the trace are noise of rounding: no component.
NULL_SHARE = 1e-12
#: Entries are held within this bound, so that they are exact as doubles.
LARGEST = float(1 << 52)
_HALF = 1 << 26


@dataclass
class Centre:
    """The exact sums of the fit list, as whole and remaining parts of the mean."""

    n: int
    sums: list[int]

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> list[int]:
        return [s % self.n for s in self.sums]

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - np.array([r / self.n for r in self.rest])

    def deviations(self, x: np.ndarray) -> list[int]:
        """The exact sums over dimensions of (n x - S)^2."""
        y, rest, n = x - self.whole, self.rest, self.n
        most = int(np.abs(y).max(initial=0))
        kind = np.int64 if most * max(most, max(rest, default=0)) * len(rest) < 1 << 62 else object
        y, r = y.astype(kind), np.array(rest, kind)
        squares, mixed, last = (y * y).sum(axis=1), y @ r, sum(v * v for v in rest)
        return [n * n * int(a) - 2 * n * int(b) + last for a, b in zip(squares, mixed, strict=True)]


def entries(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``vectors`` with x array<long>: rows whose vector is null or holds null or non-finite entries are left out."""
    v = F.col(column)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    bound = lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c.cast("double") * SCALE))
    return vectors.where(v.isNotNull() & fine).withColumn("x", F.transform(v, lambda c: F.floor(bound(c)).cast("long") + SHIFT))


def fit_list(rows: DataFrame) -> tuple[DataFrame, int]:
    """The distinct x vectors of the commonest dimension (of equally common ones, the larger), and that dimension."""
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("c"))
    top = sizes.agg(F.max_by("d", F.struct("c", "d")).alias("d")).first()
    d = top["d"] or 0
    return written(rows.where(F.size("x") == d).select("x").distinct(), "fit"), d


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    flat = x.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0), np.int64)


def summed(fit: DataFrame, part: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all fitted vectors of ``part`` of a matrix of them, a vector of ``size`` doubles.

    Each task adds up its own rows; the tasks' sums are added by place in Spark, so that ``size`` numbers reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(_matrix(batch))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["place", "value"])

    found = fit.mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(size)
    for r in found:
        out[r["place"]] = r["value"]
    return out


def centre(fit: DataFrame, d: int) -> Centre:
    """The number and the exact sums of the fitted vectors: entries are added as high and low halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                n += len(x)
                high += (x // _HALF).sum(axis=0)
                low += (x % _HALF).sum(axis=0)
        exact = [Decimal(int(h) * _HALF + int(b)) for h, b in zip(high, low, strict=True)]
        values = pa.array([Decimal(n), *exact], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), values], names=["place", "value"])

    found = fit.mapInArrow(run, "place int, value decimal(38,0)").groupBy("place").agg(F.sum("value").cast("string").alias("value")).collect()
    by_place = {r["place"]: int(r["value"]) for r in found}
    return Centre(by_place.get(-1, 0), [by_place.get(k, 0) for k in range(d)])


def _orthonormal(*blocks: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the blocks' columns; what adds next to nothing to those before is left out."""
    basis = np.zeros((blocks[0].shape[0], 0))
    for block in blocks:
        for _ in range(2):
            block = block - basis @ (basis.T @ block)
            size = np.linalg.norm(block, axis=0)
            block = block[:, size > 0] / size[size > 0]
        u, s, _ = np.linalg.svd(block - basis @ (basis.T @ block), full_matrices=False)
        u = u[:, s > 1e-8]
        u = u - basis @ (basis.T @ u)
        basis = np.hstack([basis, np.linalg.qr(u)[0]])[:, : basis.shape[0]]
    return basis


def lobpcg(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, *, guard: int = GUARD, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, int]:
    """(eigenvalues falling, unit eigenvectors in columns, rounds) of the symmetric matrix that ``product`` multiplies by.

    The residuals of the k leading ones, from a product of their own, are at most ``tolerance`` of the largest
    eigenvalue; if they are not after ``rounds`` rounds, this is an error.
    """
    k = min(k, d)
    width = min(k + guard, d)
    x = np.linalg.qr(np.random.default_rng(11).standard_normal((d, width)))[0]
    residual = direction = np.zeros((d, 0))
    for turn in range(1, rounds + 1):
        basis = _orthonormal(x, residual, direction)
        image = product(basis)
        small = basis.T @ image
        values, turned = np.linalg.eigh((small + small.T) / 2)
        values, turned = values[::-1][:width], turned[:, ::-1][:, :width]
        new = basis @ turned
        residual = image @ turned - new * values
        direction = new - x @ (x.T @ new)
        x = new
        scale = max(values[0], 0.0)
        if np.linalg.norm(residual[:, :k], axis=0).max() <= tolerance * scale or scale == 0:
            x = x / np.linalg.norm(x, axis=0)
            certified = product(x[:, :k]) - x[:, :k] * values[:k]
            if np.linalg.norm(certified, axis=0).max() <= 2 * tolerance * scale or scale == 0:
                return values[:k], x[:, :k], turn
    raise RuntimeError(f"residuals were not certified in {rounds} rounds")


@dataclass
class Whitener:
    """What is fitted: the centre, the components in columns, their eigenvalues, the trace and how far from the identity."""

    centre: Centre
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    rounds: int

    @property
    def dimension(self) -> int:
        return len(self.centre.sums)

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centre.rows(x) @ self.vectors / np.sqrt(self.values)


def fit(rows: DataFrame, components: int = COMPONENTS, **options) -> Whitener | None:
    """Fits on ``rows`` (x); None where no row has entries."""
    listed, d = fit_list(rows)
    if d == 0:
        return None
    middle = centre(listed, d)

    def product(block: np.ndarray) -> np.ndarray:
        # V times the block: centred rows by the block first, then by the rows again
        one = lambda x: ((c := middle.rows(x)).T @ (c @ block)).ravel()
        return summed(listed, one, block.size).reshape(block.shape) / middle.n

    trace = float(summed(listed, lambda x: np.array([(middle.rows(x) ** 2).sum()]), 1)[0]) / middle.n
    if trace == 0:
        return Whitener(middle, np.zeros((d, 0)), np.zeros(0), 0.0, 0.0, 0)
    values, vectors, turns = lobpcg(product, d, components, **options)
    keep = values > NULL_SHARE * trace
    values, vectors = values[keep], vectors[:, keep]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), range(vectors.shape[1])])
    done = Whitener(middle, vectors * sign, values, trace, 0.0, turns)
    k = len(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = done.project(x)
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    sums = summed(listed, moments, k + k * k) / middle.n
    mean, second = sums[:k], sums[k:].reshape(k, k)
    done.identity_error = float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max(initial=0))
    return done


def whiten(vectors: DataFrame, *, components: int = COMPONENTS, column: str = "embedding", key: str = "vec_id", **options) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact, eigenvalue) of each row and component.

    Left out: rows whose vector is null, empty or holds null or non-finite entries, and rows of another dimension than
    the commonest (of equally common ones, the larger).  Entries beyond 2^52 / 64 are held there.  Repeated rows and
    vectors are fitted once and returned each; a null key stays null; other columns are not read, whatever their names.
    Components without variance (fewer distinct vectors than components, constant dimensions) do not exist, so an
    empty table, or one of a single distinct vector, gives no rows.  Equal eigenvalues give some orthonormal choice of
    their components, the same for all rows.  ``deviation`` is null where it is beyond a long; ``deviation_exact``
    holds it up to 38 digits.
    """
    plain = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).alias("_v"))
    rows = entries(plain, "_v").where(F.size("x") > 0).select("vec_id", "x")
    done = fit(rows, components, **options)
    schema = "vec_id long, deviation decimal(38,0), whitened array<double>"
    if done is None:
        done, rows = Whitener(Centre(1, [0]), np.zeros((1, 0)), np.zeros(0), 1.0, 0.0, 0), rows.where("false")
    middle, largest = done.centre, 10**38

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                exact = [Decimal(v) if v < largest else None for v in middle.deviations(x)]
                w = pa.array(list(done.project(x)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(exact, pa.decimal128(38, 0)), w], names=["vec_id", "deviation", "whitened"])

    made = rows.where(F.size("x") == done.dimension).mapInArrow(run, schema)
    shares = F.array(*[F.lit(float(v) / done.trace) for v in done.values]) if len(done.values) else F.array().cast("array<double>")
    eigen = F.array(*[F.lit(float(v)) for v in done.values]) if len(done.values) else F.array().cast("array<double>")
    each = made.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return each.select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(middle.n).cast("long").alias("n"), F.expr("try_cast(deviation AS long)").alias("deviation"), "whitened",
        F.get(shares, F.col("k")).alias("explained"), F.lit(done.identity_error).alias("identity_error"), F.col("deviation").alias("deviation_exact"), F.get(eigen, F.col("k")).alias("eigenvalue"),
    )
