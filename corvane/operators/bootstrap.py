"""Bootstrap of units within strata by blocks of weights: no row stands for a single draw.

A replicate draws, in each stratum, as many units as it has, with replacement.  The draws are named by hashes, in two
levels.  Level one deals a replicate's draws over blocks of ``BLOCK`` units and keeps only their numbers, a vector of
replicates for each block.  Level two makes the weights inside a block, replicates x units, and multiplies them with
all statistics of all groups of the block at once; a task adds up what its blocks give, and Spark adds up the tasks.
All statistics therefore share the same weights, and the shuffles hold replicates x blocks and replicates x groups.
The work is replicates x units draws, each hashed once in either level, on small arrays in place.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Replicates of the reference.
N_BOOT = 10_000
#: Units of a block; replicates of a piece of level-one work, and numbers of draws that it may hold; replicates of a row of sums.
BLOCK = 1024
REP_CHUNK, COUNTS_HELD, SUM_CHUNK = 50, 1 << 22, 500
#: Draws that are hashed at a time in level one, 2^16 at most, and in level two: few enough for a core's cache.
HELD, WEIGHED = 1 << 16, 1 << 17
#: Constants of the 32-bit mixer.
MIX_1, MIX_2 = 0x7FEB352D, 0x846CA68B
_ONE = np.uint32(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 32-bit mixer of uint32 numbers: shifts of 16, 15, 16 with a multiplication after the first two."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(MIX_1)
    x = x ^ (x >> np.uint32(15))
    x = x * np.uint32(MIX_2)
    return x ^ (x >> np.uint32(16))


def stratum_keys(seed: int, stratum: str) -> tuple[np.uint32, np.uint32]:
    digest = hashlib.sha256(f"{seed}:{stratum}".encode()).hexdigest()
    return np.uint32(int(digest[:8], 16)), np.uint32(int(digest[8:16], 16))


def rep_keys(seed: int, stratum: str, reps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one, two = stratum_keys(seed, stratum)
    reps = reps.astype(np.uint32)
    return mix(one ^ reps), mix(two + reps)


def drawn(one: np.ndarray, two: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Numbers below n (under 2^32) for draws ``place`` under a pair of keys; the sum of two permutations."""
    hashed = mix(place ^ one) ^ mix(place + two)
    return (hashed.astype(np.uint64) * np.uint64(n)) >> np.uint64(32)


def _shifted(x: np.ndarray, spare: np.ndarray) -> None:
    """The mixer's first and last step, in place."""
    np.right_shift(x, 16, out=spare)
    np.bitwise_xor(x, spare, out=x)


def _stirred(x: np.ndarray, spare: np.ndarray) -> None:
    """The mixer's steps between, in place."""
    np.multiply(x, np.uint32(MIX_1), out=x)
    np.right_shift(x, 15, out=spare)
    np.bitwise_xor(x, spare, out=x)
    np.multiply(x, np.uint32(MIX_2), out=x)


def _hashes(place: np.ndarray, one: np.ndarray, two: np.ndarray, buffers: np.ndarray) -> np.ndarray:
    """(keys, places): mix(place ^ one) ^ mix(place + two) but for the last shift, for places below 2^16.

    The shift of the first sum's start is worked into its key; the last shift of both may be done once, on the result.
    """
    x, y, spare = (b[: len(one) * len(place)].reshape(len(one), len(place)) for b in buffers)
    np.bitwise_xor(place, (one ^ (one >> np.uint32(16)))[:, None], out=x)
    _stirred(x, spare)
    np.add(place, two[:, None], out=y)
    _shifted(y, spare)
    _stirred(y, spare)
    np.bitwise_xor(x, y, out=x)
    return x


def block_counts(seed: int, stratum: str, n: int, reps: np.ndarray) -> np.ndarray:
    """(replicates, blocks): how many of a replicate's n draws fall in each block."""
    blocks = -(-n // BLOCK)
    one, two = rep_keys(seed, stratum, reps)
    out = np.zeros((len(reps), blocks), np.int64)
    rows, width = max(1, HELD // n), min(n, HELD)
    buffers, place = np.empty((3, rows * width), np.uint32), np.arange(width, dtype=np.uint32)
    # many blocks: as many draws are counted at a time, so that counting costs no more than drawing
    at = np.empty(rows * width * max(1, blocks // HELD), np.uint64)
    for r in range(0, len(reps), rows):
        some, filled = slice(r, r + rows), 0
        k = len(one[some])
        for first in range(0, n, width):
            now = place[: min(width, n - first)]
            # first is a multiple of 2^16, or 0
            x = _hashes(now, one[some] ^ np.uint32(first), two[some] + np.uint32(first), buffers)
            _shifted(x, buffers[2][: x.size].reshape(x.shape))
            part = at[filled : filled + x.size].reshape(x.shape)
            np.multiply(x, np.uint64(n), out=part, dtype=np.uint64)
            np.right_shift(part, 32 + BLOCK.bit_length() - 1, out=part)
            if k > 1:
                part += (np.arange(k, dtype=np.uint64) * np.uint64(blocks))[:, None]
            filled += x.size
            if filled + x.size > len(at) or first + width >= n:
                out[some] += np.bincount(at[:filled].view(np.int64), minlength=k * blocks).reshape(k, blocks)
                filled = 0
    return out


def block_sums(seed: int, stratum: str, n: int, block: int, counts: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """(replicates, columns): weights of the block's units times their statistics, ``counts`` draws a replicate, under 2^16."""
    size = min(BLOCK, n - block * BLOCK)
    one, two = rep_keys(seed, stratum, np.arange(len(counts)))
    own = np.uint32((2 * block + 1) & 0xFFFFFFFF)
    one, two = mix(one ^ own), mix(two + own)
    out, most = np.zeros((len(counts), stats.shape[1])), int(counts.max(initial=0))
    stats = stats[:size]
    # whole numbers whose sums stay below 2^24 are added up exactly by halves of doubles
    small = np.abs(stats).max(initial=0) * most < 1 << 24 and (stats == np.rint(stats)).all()
    stats = stats.astype(np.float32 if small else np.float64)
    order = np.argsort(counts, kind="stable")  # replicates with about as many draws lie together
    rows = max(1, WEIGHED // max(1, most))
    buffers, place, starts = np.empty((3, rows * most), np.uint32), np.arange(most, dtype=np.uint32), np.arange(rows)[:, None] * (size + 1)
    at = np.empty(rows * most, np.int64)
    for r in range(0, len(order), rows):
        some = order[r : r + rows]
        c = counts[some]
        low, high = int(c[0]), int(c[-1])
        if not high:
            continue
        x = _hashes(place[:high], one[some], two[some], buffers)
        if size == BLOCK:  # the highest bits, which the last shift leaves as they are
            np.right_shift(x, 32 - (BLOCK.bit_length() - 1), out=x)
        else:
            _shifted(x, buffers[2][: x.size].reshape(x.shape))
            x = (x.astype(np.uint64) * np.uint64(size)) >> np.uint64(32)
        if high > low:
            x[:, low:][place[low:high] >= c[:, None]] = size
        part = at[: x.size].reshape(x.shape)
        np.add(x, starts[: len(some)], out=part, casting="unsafe")
        weights = np.bincount(part.ravel(), minlength=len(some) * (size + 1)).reshape(len(some), size + 1)[:, :size]
        out[some] = weights.astype(stats.dtype) @ stats
    return out


def numbered(questions: DataFrame) -> DataFrame:
    """``questions`` (dataset, original_index, ...) with qno, each one's place in its dataset from 0.

    A dataset's questions may be many, so places come from counts of cells of indices plus places within a cell.
    """
    q = questions.withColumn("cell", F.floor(F.col("original_index") / 1024))
    upto = Window.partitionBy("dataset").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = q.groupBy("dataset", "cell").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(upto), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("dataset", "cell").orderBy("original_index")) - 1
    q = q.withColumn("place", place).join(cells.drop("c"), ["dataset", "cell"])
    return q.withColumn("qno", (F.col("before") + F.col("place")).cast("long")).drop("cell", "place", "before")


def _tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def _draws(sizes: DataFrame, reps: int, seed: int) -> DataFrame:
    """(stratum, n, block, rep, counts): level one over strata ``sizes`` (stratum, n); counts are 16-bit numbers of replicates from rep on."""
    step = F.greatest(F.lit(1), F.least(F.lit(REP_CHUNK), F.floor(F.lit(COUNTS_HELD) / F.ceil(F.col("n") / BLOCK)))).cast("long")
    work = sizes.where("n > 0").withColumn("step", step)
    work = work.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"), F.col("step"))))
    work = work.repartition(_tasks(sizes), "stratum", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, n, rep, step in zip(*(batch.column(c).to_pylist() for c in ("stratum", "n", "rep", "step")), strict=True):
                counts = block_counts(seed, s, n, np.arange(rep, min(rep + step, reps)))
                if counts.max() >= 1 << 16:
                    raise ValueError(f"{s}: a block of replicates from {rep} on has too many draws")
                for b in range(0, counts.shape[1], 4096):
                    made = np.ascontiguousarray(counts[:, b : b + 4096].T.astype(np.uint16))
                    k = len(made)
                    ends = np.arange(k + 1, dtype=np.int32) * (2 * made.shape[1])
                    packed = pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(ends), pa.py_buffer(made)])
                    columns = [pa.array([s] * k, pa.string()), pa.array([n] * k, pa.int64()), pa.array(range(b, b + k), pa.int64()), pa.array([rep] * k, pa.int64()), packed]
                    yield pa.RecordBatch.from_arrays(columns, names=["stratum", "n", "block", "rep", "counts"])

    return work.mapInArrow(run, "stratum string, n long, block long, rep long, counts binary")


def replicate_sums(units: DataFrame, stats: DataFrame, names: list[str], *, reps: int = N_BOOT, seed: int = 42) -> DataFrame:
    """(grp, rep, names...): the sums of each group's statistics over the units that a replicate draws.

    ``units``: (stratum string, qno), each unit once, qno from 0 to the stratum's size, which is under 2^32.
    ``stats``: (stratum, qno, grp string, not null, names...), any number of rows a unit; nulls count as 0.  Every group of
    ``stats`` has a row for each replicate.  A task holds replicates x groups sums and one block of units; sums of
    whole numbers below 2^53 are exact, so that they don't depend on how rows are dealt.
    """
    sizes = units.groupBy("stratum").agg(F.count("*").alias("n"))
    counts = _draws(sizes, reps, seed)
    width, own = len(names), [f"_{k}" for k in range(len(names))]
    block = F.shiftright("qno", BLOCK.bit_length() - 1)
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(o) for c, o in zip(names, own, strict=True)]
    rows = stats.select("stratum", block.alias("block"), F.lit(1).alias("kind"), (F.col("qno") - block * BLOCK).alias("at"), F.lit(0).cast("long").alias("rep"), F.lit(None).cast("binary").alias("counts"), "grp", *values)
    given = counts.select("stratum", "block", F.lit(0).alias("kind"), F.col("n").alias("at"), "rep", "counts", F.lit(None).cast("string").alias("grp"), *[F.lit(0.0).alias(o) for o in own])
    both = given.unionByName(rows).repartition(_tasks(units), "stratum", "block").sortWithinPartitions("stratum", "block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str | None, int] = {}
        total: list[np.ndarray] = []
        now: tuple | None = None
        counts, n, held = np.zeros(reps, np.int64), 0, []

        def close() -> None:
            if not held:
                return
            group, at, values = (np.concatenate(x) for x in zip(*held, strict=True))
            here, group = np.unique(group, return_inverse=True)
            cell = at * len(here) + group
            table = np.stack([np.bincount(cell, weights=values[:, k], minlength=BLOCK * len(here)) for k in range(width)], axis=1)
            sums = block_sums(seed, now[0], n, now[1], counts, table.reshape(BLOCK, len(here) * width)).reshape(reps, len(here), width)
            for k, g in enumerate(here):
                total[g] += sums[:, k]

        for batch in batches:
            if not batch.num_rows:
                continue
            of = dict(zip(batch.schema.names, batch.columns, strict=True))
            strata, grp = of["stratum"].dictionary_encode(), of["grp"].dictionary_encode()
            names_here = [*grp.dictionary.to_pylist(), None]
            for g in names_here[:-1]:
                if g not in numbers:
                    numbers[g] = len(total)
                    total.append(np.zeros((reps, width)))
            codes = grp.indices.fill_null(len(names_here) - 1).to_numpy()
            known = np.array([numbers.get(g, -1) for g in names_here])
            stratum, block, kind, at, rep = strata.indices.to_numpy(), *(of[c].to_numpy() for c in ("block", "kind", "at", "rep"))
            values = np.stack([of[o].to_numpy() for o in own], axis=1)
            new = np.flatnonzero((stratum[1:] != stratum[:-1]) | (block[1:] != block[:-1])) + 1
            for a, b in zip([0, *new], [*new, batch.num_rows], strict=True):
                key = (strata.dictionary[int(stratum[a])].as_py(), int(block[a]))
                if key != now:
                    if now is not None:
                        close()
                    now, n, held = key, 0, []
                    counts = np.zeros(reps, np.int64)
                first = a + int((kind[a:b] == 0).sum())
                for i, c in enumerate(of["counts"].slice(a, first - a).to_pylist(), a):
                    n = int(at[i])
                    counts[rep[i] : rep[i] + len(c) // 2] = np.frombuffer(c, np.uint16)
                if first < b:
                    held.append((known[codes[first:b]], at[first:b], values[first:b]))
        if now is not None:
            close()
        for g, k in numbers.items():
            for r in range(0, reps, SUM_CHUNK):
                packed = pa.array([total[k][r : r + SUM_CHUNK].tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.string()), pa.array([r], pa.int32()), packed], names=["grp", "rep", "sums"])

    def added(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float64).reshape(-1, width) for x in table["sums"].to_pylist())
        first, k = table["rep"][0].as_py(), len(total)
        columns = [pa.array([table["grp"][0].as_py()] * k, pa.string()), pa.array(range(first, first + k), pa.int32()), *[pa.array(np.ascontiguousarray(total[:, i])) for i in range(width)]]
        return pa.table(columns, names=["grp", "rep", *names])

    made = both.mapInArrow(run, "grp string, rep int, sums binary")
    return made.groupBy("grp", "rep").applyInArrow(added, "grp string, rep int, " + ", ".join(f"`{c}` double" for c in names))


def with_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with grp, a text of the keys' values that ``split_groups`` takes apart."""
    return df.withColumn("grp", F.to_json(F.array(*[F.col(k).cast("string") for k in keys])) if keys else F.lit("[]"))


def split_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    parts = F.from_json("grp", "array<string>")
    return df.withColumns({k: F.get(parts, F.lit(i)) for i, k in enumerate(keys)}).drop("grp")


def ratio(num: str = "num", den: str = "den") -> Column:
    """A replicate's ratio, null where its denominator is not positive."""
    return F.when(F.col(den) > 0, F.col(num) / F.col(den))


def interval(replicates: DataFrame, keys: list[str] = [], level: float = 0.95) -> DataFrame:  # noqa: B006
    """(keys, n_defined, undefined_reps, ci_low, ci_high): percentile bounds of ``value``, null if under half of the replicates are defined."""
    tail = (1 - level) / 2
    enough = F.count("value") >= F.lit(0.5) * F.count("*")
    return replicates.groupBy(*keys).agg(
        F.count("value").alias("n_defined"),
        F.count_if(F.col("value").isNull()).alias("undefined_reps"),
        F.when(enough, F.percentile("value", F.lit(tail))).alias("ci_low"),
        F.when(enough, F.percentile("value", F.lit(1 - tail))).alias("ci_high"),
    )


def p_value(replicates: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(keys, p): two-sided over the defined ``value``s, zero counted in both tails; null if under half are defined."""
    below, above = F.avg((F.col("value") <= 0).cast("double")), F.avg((F.col("value") >= 0).cast("double"))
    enough = F.count("value") >= F.lit(0.5) * F.count("*")
    return replicates.groupBy(*keys).agg(F.when(enough, F.least(F.lit(1.0), 2 * F.least(below, above))).alias("p"))


def ratio_table(units: DataFrame, rows: DataFrame, keys: list[str], *, reps: int = N_BOOT, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(keys, num, den, point, n_defined, undefined_reps, ci_low, ci_high) of sum(num) / sum(den) in each group.

    ``rows``: (stratum, qno, keys, num, den).
    """
    grouped = with_groups(rows, keys).groupBy("stratum", "qno", "grp").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    sums = replicate_sums(units, grouped, ["num", "den"], reps=reps, seed=seed).withColumn("value", ratio())
    point = grouped.groupBy("grp").agg(F.sum("num").alias("num"), F.sum("den").alias("den")).withColumn("point", ratio())
    return split_groups(point.join(interval(sums, ["grp"], level), "grp"), keys)


def sign_contrast(units: DataFrame, rows: DataFrame, keys: list[str], *, reps: int = N_BOOT, seed: int = 42) -> DataFrame:
    """(keys, rep, value): the sign-exact contrast of modelled over measured counts, null where ``den`` is not positive.

    ``rows``: (stratum, qno, n_options, keys, modelled, measured, den), whole counts.  modelled / (n_options - 2) minus
    measured is scaled by the least common multiple of all n_options - 2, so that replicates are whole numbers and
    a difference of zero is zero.  Options of two or fewer, and sums that doubles can't hold exactly, are errors.
    """
    kinds = [r["d"] for r in rows.select((F.col("n_options") - 2).alias("d")).distinct().limit(1000).collect()]  # numbers of options are few
    if not kinds:
        return split_groups(replicate_sums(units, with_groups(rows, keys).withColumn("value", F.lit(0)), ["value", "den"], reps=reps, seed=seed), keys).select(*keys, "rep", "value")
    if any(d is None or d <= 0 for d in kinds):
        raise ValueError("a contrast needs more than two options")
    scale = math.lcm(*map(int, kinds))
    scaled = F.sum(F.col("modelled") * (F.lit(scale) / (F.col("n_options") - 2)).cast("long") - F.col("measured") * scale)
    per = with_groups(rows, keys).groupBy("stratum", "qno", "grp").agg(scaled.alias("value"), F.sum("den").alias("den"))
    most = per.agg(F.max(F.abs("value")).alias("m")).first()["m"] or 0
    if most * units.count() >= 1 << 53:
        raise ValueError("the contrast's sums are beyond exact doubles")
    sums = replicate_sums(units, per, ["value", "den"], reps=reps, seed=seed)
    return split_groups(sums.withColumn("value", F.when(F.col("den") > 0, F.col("value"))), keys).select(*keys, "rep", "value")
