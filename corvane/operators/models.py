"""Models fitted on every fold at once: TF-IDF features with a vocabulary of the training rows, and logistic regression.

The folds' rows lie in one table.  A pass over it gives the gradients of all folds: tasks add up their rows, packed once,
with the weights of all folds, and few sums of folds x (features + 1) numbers reach the driver, a bound that does not
depend on the rows: Spark adds up those of many tasks first.  Each fold stops where the area under the curve of its validation rows no longer grows.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions import stats

MAX_FEATURES, MIN_DF, GRAMS = 20_000, 5, 2
#: Adam's step and decays, the penalty of squared weights, steps between looks at the validation rows, looks without gain.
RATE, DECAYS, L2 = 0.1, (0.9, 0.999), 1e-4
STEPS, PATIENCE, LOOKS = 10, 2, 10
#: Terms that a task counts before it hands them on; rows that Python works off at a time; numbers that a pass may send to the driver.
HELD_TERMS, PACKED, COLLECTED = 100_000, 2000, 1 << 21


def grams(words: Column, n: int = GRAMS) -> Column:
    """All runs of 1 to n words, joined by spaces."""

    def of(k: int) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.array_join(F.slice(words, i + 1, F.lit(k)), " "))
        return F.when(F.size(words) >= k, runs).otherwise(F.array().cast("array<string>"))

    return F.concat(words, *[of(k) for k in range(2, n + 1)])


def list_grams(words: list[str | None], n: int = GRAMS) -> list[str]:
    """The same of a list; nulls are no words."""
    words = [w for w in words if w is not None]
    out = list(words)
    for k in range(2, n + 1):
        out += map(" ".join, zip(*(words[i:] for i in range(k)), strict=False))
    return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, PACKED):
            yield batch.slice(k, PACKED)


def _rows_of_grams(batch: pa.RecordBatch, words: str, n: int) -> Iterator[tuple[list[str | None], list[str]]]:
    """(folds, grams) of each run of rows with the same words, which a row's folds are: they are read once."""
    column = batch.column(words)
    ends = column.offsets.to_numpy()
    values, ends = column.values.slice(ends[0], ends[-1] - ends[0]).to_numpy(zero_copy_only=False), ends - ends[0]
    folds: list[str | None] = []
    for i, fold in enumerate(batch.column("fold").to_pylist()):
        if folds and not (column[i].is_valid and column[i].equals(column[i - 1])):
            yield folds, list_grams(values[ends[i - 1] : ends[i]], n)
            folds = []
        folds.append(fold)
    if folds:
        yield folds, list_grams(values[ends[-2] : ends[-1]], n)


def _tallies(rows: DataFrame, words: str, folds: list[str], n: int) -> DataFrame:
    """(term, at, df, n): how many rows of the folds whose place in ``at`` is "1" hold a term and how often they do.

    A term comes in a few pieces: each task adds up what it reads, ``HELD_TERMS`` terms at a time.
    """
    places = {f: k for k, f in enumerate(folds)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def close() -> Iterator[pa.RecordBatch]:
            for at, (df, more) in held.items():
                for times in set(at) - {0}:  # a fold with several rows of the same words counts each
                    where = "".join("1" if k == times else "0" for k in at)
                    counts = np.fromiter(df.values(), np.int64, len(df))
                    extra = np.fromiter((more[t] for t in df) if more else (0 for _ in df), np.int64, len(df))
                    columns = [pa.array(df.keys(), pa.string()), pa.array([where] * len(df), pa.string()), pa.array(counts * times), pa.array((counts + extra) * times)]
                    yield pa.RecordBatch.from_arrays(columns, names=["term", "at", "df", "n"])
            held.clear()

        for batch in _parts(batches):
            for found_in, found in _rows_of_grams(batch, words, n):
                at = [0] * len(folds)
                for f in found_in:
                    at[places[f]] += 1
                df, more = held.setdefault(tuple(at), (Counter(), Counter()))
                own = Counter(found)
                df.update(own.keys())
                if len(own) < len(found):
                    more.update({t: c - 1 for t, c in own.items() if c > 1})
                if sum(len(kept) for kept, _ in held.values()) > HELD_TERMS:
                    yield from close()
        yield from close()

    return rows.select("fold", words).mapInArrow(run, "term string, at string, df long, n long")


def fit_tfidf(rows: DataFrame, words: str, key: str, folds: list[str], *, max_features: int = MAX_FEATURES, min_df: int = MIN_DF, n: int = GRAMS) -> DataFrame:
    """(fold, term, place, df, idf): each fold's vocabulary, of its training rows alone.

    ``rows``: (fold, role, key, words), a key once a fold.  Of the terms in at least ``min_df`` rows the ``max_features`` most
    frequent are kept, of equals the first by name, and are numbered by name.  Rows don't move: tasks hand on terms with
    their counts, which are shuffled once for all folds, and each task keeps a bounded first part of a fold's sorted terms.
    """
    train = rows.where(F.col("fold").isin(folds) & (F.col("role") == "train"))
    of = lambda c, k: F.sum(F.when(F.substring("at", k + 1, 1) == "1", F.col(c)).otherwise(0))
    by_term = _tallies(train, words, folds, n).groupBy("term").agg(*[of(c, k).alias(f"{c}{k}") for k in range(len(folds)) for c in ("df", "n")])
    each = [F.struct(F.lit(f).alias("fold"), F.col(f"df{k}").alias("df"), F.col(f"n{k}").alias("n")) for k, f in enumerate(folds)]
    seen = by_term.select("term", F.explode(F.filter(F.array(*each), lambda x: x["df"] >= F.greatest(F.lit(min_df), F.lit(1)))).alias("x")).select("term", "x.*")
    top = seen.withColumn("_k", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("n"), "term"))).where(F.col("_k") <= max_features)
    sizes = train.groupBy("fold").agg(F.count("*").alias("rows"))
    place = F.row_number().over(Window.partitionBy("fold").orderBy("term")) - 1  # max_features rows a fold
    idf = F.log((1 + F.col("rows")) / (1 + F.col("df"))) + 1
    return top.join(F.broadcast(sizes), "fold").select("fold", "term", place.alias("place"), "df", idf.alias("idf"))


def transform_tfidf(rows: DataFrame, vocabulary: DataFrame, words: str, key: str, *, n: int = GRAMS) -> DataFrame:
    """``rows`` without words, with idx array<int> and val array<double>: (1 + ln tf) idf, scaled to length one; empty where no term is known.

    The vocabulary, folds x max_features rows at most, is collected once and sent to the rows, which don't move.
    """
    known: dict[str, dict[str, tuple[int, float]]] = {}
    for r in vocabulary.select("fold", "term", "place", "idf").collect():
        known.setdefault(r["fold"], {})[r["term"]] = (r["place"], r["idf"])
    terms = {t for own in known.values() for t in own}
    rest = [c for c in rows.columns if c != words]
    schema = T.StructType([*rows.select(*rest).schema.fields, T.StructField("idx", T.ArrayType(T.IntegerType())), T.StructField("val", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            entries, sizes = [], []
            for folds, found in _rows_of_grams(batch, words, n):
                counts = Counter([t for t in found if t in terms])
                for fold in folds:
                    own = known.get(fold, {})
                    here = sorted((*own[t], c) for t, c in counts.items() if t in own)
                    entries += here
                    sizes.append(len(here))
            place, idf, tf = np.array(entries, np.float64).reshape(-1, 3).T
            row, x = np.repeat(np.arange(len(sizes)), sizes), (1 + np.log(tf)) * idf
            x = x / np.sqrt(np.bincount(row, weights=x * x, minlength=len(sizes)))[row]
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (place.astype(np.int32), x)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *lists], names=[*rest, "idx", "val"])

    return rows.mapInArrow(run, schema)


def standardise(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` (fold, role, column array<double>) with idx and val: entries less the mean over the deviation of the fold's training rows.

    Means and deviations come from one pass, merged over tasks; an entry that never differs is only centred.
    """
    entries = rows.where("role = 'train'").select("fold", F.posexplode(column).alias("k", "x"))
    moments = entries.groupBy("fold", "k").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    by_fold = moments.groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("k", "mean", "sd"))).alias("m"))  # one entry a dimension
    scaled = F.transform(column, lambda x, i: (x - F.get("m", i)["mean"]) / F.when(F.get("m", i)["sd"] > 0, F.get("m", i)["sd"]).otherwise(1.0))
    return rows.join(F.broadcast(by_fold), "fold").withColumns({"idx": F.transform(column, lambda x, i: i), "val": scaled}).drop(column, "m")


def _flat(batch: pa.RecordBatch, order: dict[str, int]) -> tuple[np.ndarray, ...]:
    """Of a batch: (fold of each row, row of each entry, place of each entry, its value)."""
    lists = batch.column("idx")
    row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    fold = np.array([order[f] for f in batch.column("fold").to_pylist()], np.int64)
    return fold, row, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), batch.column("val").flatten().to_numpy(zero_copy_only=False)


def scores(w: np.ndarray, fold: np.ndarray, row: np.ndarray, place: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The probability of each row; ``w`` is folds x (features + 1), the last of each fold the intercept."""
    z = np.bincount(row, weights=value * w[fold[row], place], minlength=len(fold)) + w[fold, -1]
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def gradient(w: np.ndarray, y: np.ndarray, weight: np.ndarray, fold: np.ndarray, row: np.ndarray, place: np.ndarray, value: np.ndarray) -> np.ndarray:
    off = (scores(w, fold, row, place, value) - y) * weight[fold, y.astype(np.int64)]
    size = w.shape[1]
    g = np.bincount(fold[row] * size + place, weights=value * off[row], minlength=w.size)
    return (g + np.bincount(fold * size + size - 1, weights=off, minlength=w.size)).reshape(w.shape)


@dataclass
class Adam:
    """Full-batch steps of all folds; the intercepts carry no penalty."""

    w: np.ndarray
    rate: float = RATE
    l2: float = L2
    taken: int = 0
    m: np.ndarray = field(init=False)
    v: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.m, self.v = np.zeros_like(self.w), np.zeros_like(self.w)

    def step(self, g: np.ndarray, open_folds: np.ndarray) -> None:
        g = g + self.l2 * np.hstack([self.w[:, :-1], np.zeros((len(self.w), 1))])
        self.taken += 1
        (a, b), t = DECAYS, self.taken
        self.m, self.v = a * self.m + (1 - a) * g, b * self.v + (1 - b) * g * g
        move = self.rate * (self.m / (1 - a**t)) / (np.sqrt(self.v / (1 - b**t)) + 1e-8)
        self.w = np.where(open_folds[:, None], self.w - move, self.w)


@dataclass
class Models:
    folds: list[str]
    w: np.ndarray
    #: Of each fold, the best validation area and the number of steps that gave it.
    area: list[float | None]
    steps: list[int]

    def predict(self, features: DataFrame, keep: list[str]) -> DataFrame:
        """(fold, keep..., score) of each row of ``features`` (fold, idx, val); rows of unknown folds are left out."""
        order, w = {f: i for i, f in enumerate(self.folds)}, self.w
        plain = features.where(F.col("fold").isin(self.folds)).select("fold", *keep, "idx", "val")
        schema = plain.select("fold", *keep).schema.add("score", "double")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                s = scores(w, *_flat(batch, order))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("fold", *keep)), pa.array(s)], names=["fold", *keep, "score"])

        return plain.mapInArrow(run, schema)


def _packed(rows: DataFrame, order: dict[str, int]) -> RDD:
    """``rows`` (fold, y, idx, val) as pickled arrays of ``PACKED`` rows each, (y, *_flat), so that no pass reads Arrow lists again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            made = pickle.dumps((part.column("y").to_numpy().astype(float), *_flat(part, order)), protocol=5)
            yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["block"])

    return rows.select("fold", "y", "idx", "val").mapInArrow(run, "block binary").rdd.map(lambda r: bytes(r["block"]))


def _sums(blocks: RDD, make: Callable[..., np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of ``make`` over blocks: a job of one stage, unless so many tasks have sums that Spark first adds them up in parts."""

    def run(parts: Iterator[bytes]) -> Iterator[np.ndarray]:
        total = np.zeros(shape)
        for part in parts:
            total += make(*pickle.loads(part))
        yield total

    made, tasks = blocks.mapPartitions(run), blocks.getNumPartitions()
    if tasks * shape[0] * shape[1] <= COLLECTED:
        return sum(made.collect(), np.zeros(shape))
    return made.treeReduce(np.add)


def class_weights(n0: float, n1: float) -> tuple[float, float]:
    """Weights of the classes under which both weigh the same and all rows weigh 1 on average; of a single class, 1."""
    if not n0 or not n1:
        return 1.0, 1.0
    return (n0 + n1) / (2 * n0), (n0 + n1) / (2 * n1)


def fit_logistic(features: DataFrame, folds: list[str], size: int, *, balanced: bool = True, looks: int = LOOKS, steps: int = STEPS, patience: int = PATIENCE, rate: float = RATE, l2: float = L2) -> Models:
    """Logistic regressions of all folds on ``features`` (fold, role, y 0/1, idx, val), idx below ``size``.

    Rows of role "train" give gradients, those of role "val" the areas that stop a fold; other roles, null labels and
    other folds are not read.  A fold without validation rows of both classes runs all its steps.  A fold without training rows
    stays at zero.  The weights kept are those of the best look.
    """
    order = {f: i for i, f in enumerate(folds)}
    used = features.where(F.col("fold").isin(folds) & F.col("role").isin("train", "val") & F.col("y").isin(0, 1)).select("fold", "role", F.col("y").cast("int").alias("y"), "idx", "val")
    used = used.persist(StorageLevel.MEMORY_AND_DISK)
    train, val = used.where("role = 'train'"), used.where("role = 'val'")
    counts = {(r["fold"], r["y"]): r["n"] for r in train.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = ([counts.get((f, y), 0) for f in folds] for y in (0, 1))
    weight = np.array([class_weights(a, b) if balanced else (1.0, 1.0) for a, b in zip(n0, n1, strict=True)])
    weight = weight / np.maximum(np.array(n0) + np.array(n1), 1)[:, None]
    fit = Adam(np.zeros((len(folds), size + 1)), rate, l2)
    best, area, took = fit.w.copy(), np.full(len(folds), -1.0), [0] * len(folds)
    left = np.full(len(folds), patience)
    live = np.array(n0) + np.array(n1) > 0
    blocks = _packed(train, order).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for _ in range(looks):
            for _ in range(steps):
                w = fit.w
                fit.step(_sums(blocks, lambda y, *rest, w=w: gradient(w, y, weight, *rest), fit.w.shape), live & (left > 0))
            now = Models(folds, fit.w, [], [])
            seen = {r["fold"]: r["auroc"] for r in stats.auroc(now.predict(val, ["y"]), "y", "score", ["fold"]).collect()}
            for i, f in enumerate(folds):
                if not live[i] or left[i] <= 0:
                    continue
                a = seen.get(f)
                if a is None or a > area[i] + 1e-9:
                    best[i], took[i], left[i] = fit.w[i], fit.taken, patience
                    area[i] = -1.0 if a is None else a
                else:
                    left[i] -= 1
            if not (live & (left > 0)).any():
                break
    finally:
        blocks.unpersist()
        used.unpersist()
    return Models(folds, best, [float(a) if a >= 0 else None for a in area], took)


def evaluate(predictions: DataFrame, roles: list[str]) -> DataFrame:
    """(fold, role, n_pos, n_neg, auroc) of ``predictions`` (fold, role, y, score) in the roles named."""
    return stats.auroc(predictions.where(F.col("role").isin(roles) & F.col("y").isin(0, 1)), "y", "score", ["fold", "role"])


def ensemble(predictions: DataFrame, key: str) -> DataFrame:
    """(key, score, n_folds): the mean of the folds' scores."""
    return predictions.groupBy(key).agg(F.avg("score").alias("score"), F.count("*").alias("n_folds"))
