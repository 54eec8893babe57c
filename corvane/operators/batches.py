"""Batches under a budget of padded tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hexadecimal digits of a hash that name its cell: 4,096 cells.
DIGITS = 3


def shuffled_place(rows: DataFrame, key: str, seed: int, name: str = "place") -> DataFrame:
    """``rows`` with each one's place from 0 in the order of a hash of (seed, key); no task sorts more than a cell of hashes.

    A key that repeats shares its hash; its rows are ordered by nothing else, so keys should be unique.
    """
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key)), 256)
    rows = rows.withColumn("_c", F.conv(F.substring(h, 1, DIGITS), 16, 10).cast("int"))
    cells = rows.groupBy("_c").agg(F.count("*").alias("_n"))
    cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a cell
    place = F.row_number().over(Window.partitionBy("_c").orderBy("_h", key)) - 1
    # rows are dealt by their cell alone and hashed again there: the hash is longer than most rows
    placed = rows.repartition("_c").withColumn("_h", h).withColumn("_p", place).join(F.broadcast(cells), "_c")
    return placed.withColumn(name, F.col("_before") + F.col("_p")).drop("_h", "_c", "_n", "_p", "_before")


def pack(lengths: list[int], most_tokens: int, most_rows: int) -> list[int]:
    """The batch number of each of some sorted lengths: a batch grows while rows x longest stays within the budget."""
    out, batch, first = [], 0, 0
    for i, length in enumerate(lengths):
        rows = i - first + 1
        if rows > 1 and (rows > most_rows or rows * length > most_tokens):
            batch, first = batch + 1, i
        out.append(batch)
    return out


def token_batches(rows: DataFrame, key: str, length: str, *, most_tokens: int, most_rows: int, buckets: int = 64, seed: int = 0, shuffle: bool = True) -> DataFrame:
    """``rows`` with chunk, batch, batch_rows and padded: batches of like lengths, of ``most_rows`` rows and ``most_tokens`` padded tokens at most.

    Rows are put in a seeded order (by key without ``shuffle``), cut into chunks of ``most_rows`` x ``buckets``, and each chunk, whose
    size is thereby bounded, is sorted by length (ties keep their order) and filled greedily in one task.  A row over
    the budget is a batch of its own; a null length counts as 0.  (chunk, batch) names a batch.
    """
    if min(most_tokens, most_rows, buckets) < 1:
        raise ValueError("budgets must be at least 1")
    placed = shuffled_place(rows, key, seed, "_place") if shuffle else _in_order(rows, key)
    kept = rows.columns
    chunk = F.floor(F.col("_place") / (most_rows * buckets)).cast("long")
    dealt = placed.select(*kept, "_place").repartition(chunk)  # what follows from a row is made behind the shuffle
    dealt = dealt.withColumns({"chunk": chunk, "_len": F.coalesce(F.col(length).cast("long"), F.lit(0))}).sortWithinPartitions("chunk", "_len", "_place")

    def filled(part: pa.RecordBatch) -> pa.RecordBatch:
        """Whole chunks, sorted: a batch's rows lie together, the longest last."""
        chunk, lengths = part.column("chunk").to_numpy(), part.column("_len").to_numpy()
        ends = [*(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1), len(chunk)]
        batch = np.array([b for first, end in zip([0, *ends], ends, strict=False) for b in pack(lengths[first:end].tolist(), most_tokens, most_rows)], np.int64)
        new = np.concatenate([[True], (chunk[1:] != chunk[:-1]) | (batch[1:] != batch[:-1])])
        own = np.cumsum(new) - 1
        n = np.bincount(own)
        longest = lengths[np.cumsum(n) - 1]
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *map(pa.array, (chunk, batch, n[own], (n * longest)[own]))], names=[*kept, "chunk", "batch", "batch_rows", "padded"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if batch.num_rows:
                chunk = batch.column("chunk").to_numpy()
                last = int(np.searchsorted(chunk, chunk[-1]))  # the last chunk may go on in the next batch
                if last:
                    yield filled(batch.slice(0, last))
                held = batch.slice(last)
        if held is not None:
            yield filled(held)

    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, T.LongType()) for c in ("chunk", "batch", "batch_rows", "padded")]])
    return dealt.mapInArrow(run, schema)


def _in_order(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with _place in the order of ``key``: ranges of keys are sorted apart and numbered with the sizes of those before."""
    sorted_rows = rows.orderBy(key)
    numbered = sorted_rows.withColumn("_m", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_m", 33))
    parts = numbered.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a task
    placed = numbered.join(F.broadcast(parts), "_part")
    return placed.withColumn("_place", F.col("_before") + F.col("_m") - F.col("_first")).drop("_m", "_part", "_n", "_first", "_before")


def prefix_lengths(length: Column, least_share: float, *parts: Column) -> Column:
    """A random prefix length between ceil(least_share x length) and length, 1 at least, from a hash of the parts."""
    u = F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 13), 16, 10).cast("double") / float(1 << 52)
    low = F.greatest(F.lit(1), F.ceil(F.lit(least_share) * length - 1e-9)).cast("long")
    return F.greatest(F.lit(1), low + F.floor(u * (length - low + 1))).cast("long")
