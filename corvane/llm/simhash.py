"""Near-duplicates by SimHash, linked by a range join on segment popcounts.

*Fingerprints.*  A document is lower-cased (A-Z), cut into words, and its shingles of
``shingle`` words, repeats included, are hashed with XXH64 (seed 42); a bit of the fingerprint is set if
it is set in over half the hashes.

*Links.*  Equal fingerprints are one point.  A point is embedded as the popcounts of its 32 two-bit
segments, which change by at most the Hamming distance in Manhattan distance.  Two points within 3 bits
are within Manhattan distance 1 in one half of the segments (3 = 1 + 2, and so on): per half, a
point goes into the grid cell of its own 16 counts as a resident, and as a visitor into the at
most 16 cells one count higher, so every such pair meets exactly in a cell.  Pairs that meet are verified on
the exact bits.  A cell is first split into blocks of ``block`` points by hash, and pairs of blocks
are the units of work, so a cell of any size is worked on in bounded memory; what leaves a block pair is
one edge per point to its local component's smallest point, never all pairs.

*Classes.*  The edges go through distributed connected components.

Edge cases: null and empty texts have the fingerprint zero and link like any other; repeated
rows are returned each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import connected_components, keep_named, small_batches, text_batches, written

SHINGLE = 3
DISTANCE = 3
BLOCK = 2048
_PAIRS = 0x55555555


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, unsigned."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
    hashes = np.array([xxhash.xxh64_intdigest(p, 42) for p in parts], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros(64, np.int64)
    for i in range(0, len(bits), 250):
        sums += np.add.reduce(bits[i : i + 250], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(sums * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, th, fp), one row per row of ``docs``: the text's hash, and the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            fps = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(fps.view(np.int64))], names=["doc_id", "th", "fp"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(run, f"doc_id {kind}, th long, fp long")


def _cells(points: DataFrame, block: int) -> DataFrame:
    """(half, cell, visits, fp): where each point meets others.

    A half's 16 counts are the 16 two-bit fields of a cell number.
    """
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)

    def counts(x: Column) -> Column:
        return x.bitwiseAND(F.lit(_PAIRS)) + F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(_PAIRS))

    both = F.array(*[F.struct(F.lit(i).alias("half"), counts(x).alias("cell")) for i, x in enumerate((low, high))])
    halves = points.select("fp", F.explode(both).alias("h"))
    own = F.array(F.struct(F.col("h.cell").alias("cell"), F.lit(False).alias("visits")))
    steps = F.array(*[F.lit(1 << k).cast("long") for k in range(0, 32, 2)])
    open_steps = F.filter(steps, lambda one: F.col("h.cell").bitwiseAND(one * 2) == 0)
    raised = F.transform(open_steps, lambda one: F.struct((F.col("h.cell") + one).alias("cell"), F.lit(True).alias("visits")))
    return halves.select("fp", F.col("h.half").alias("half"), F.explode(F.concat(own, raised)).alias("x")).select("half", "x.cell", "x.visits", "fp")


def _local_edges(fps: np.ndarray, visits: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (point, smallest point of its component) among the points of a cell's block pair."""
    n = len(fps)
    left = np.ones(n, bool)
    a, b = [], []
    for i in range(n):
        if not left[i]:
            continue
        left[i] = False
        front, members = np.array([i]), []
        while len(front):
            members.append(front)
            rest = np.flatnonzero(left)
            if not len(rest):
                break
            near = np.zeros(len(rest), bool)
            for k in range(0, len(front), 256):
                part = front[k : k + 256]
                close = np.bitwise_count(fps[part][:, None] ^ fps[rest][None, :]) <= distance
                close &= ~(visits[part][:, None] & visits[rest][None, :])
                near |= close.any(axis=0)
            front = rest[near]
            left[front] = False
        group = np.concatenate(members)
        if len(group) > 1:
            signed = fps[group].view(np.int64)
            a.append(signed)
            b.append(np.full(len(group), signed.min()))
    none = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def links(points: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect just the points (fp, distinct) joined by chains of links.

    ``distance`` is 3 at most: the grid guarantees no more.
    """
    if distance > 3:
        raise ValueError("the grid finds distances up to 3")
    small_batches(points.sparkSession)
    placed = written(_cells(points, block), "cells")
    key = ["half", "cell"]
    size = placed.groupBy(*key).agg(F.count("*").alias("n"), F.max(~F.col("visits")).alias("home")).where("n > 1 and home")
    size = size.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    met = placed.join(size.drop("home", "n"), key)
    mine = F.pmod(F.xxhash64("fp", F.lit("block")), F.col("blocks")).cast("int")
    met = met.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(*key, F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp", "visits")
    packed = met.groupBy(*key, "i", "j").agg(
        F.collect_list(F.when(~F.col("visits"), F.col("fp"))).alias("home"), F.collect_list(F.when(F.col("visits"), F.col("fp"))).alias("visitors")
    )
    packed = packed.where("size(home) > 0 and size(home) + size(visitors) > 1").select("home", "visitors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, visitors = batch.column(0), batch.column(1)
            hv, ho = home.values.to_numpy(zero_copy_only=False).view(np.uint64), home.offsets.to_numpy()
            vv, vo = visitors.values.to_numpy(zero_copy_only=False).view(np.uint64), visitors.offsets.to_numpy()
            a, b = [], []
            # cells of two points are most of them: one comparison for all
            nh, nv = np.diff(ho), np.diff(vo)
            two = nh + nv == 2
            x = hv[ho[:-1][two]]
            y = np.where(nh[two] == 2, hv[np.minimum(ho[:-1][two] + 1, len(hv) - 1)], vv[np.minimum(vo[:-1][two], len(vv) - 1)] if len(vv) else 0)
            near = np.bitwise_count(x ^ y) <= distance
            sx, sy = x[near].view(np.int64), y[near].view(np.int64)
            a.append(np.maximum(sx, sy))
            b.append(np.minimum(sx, sy))
            for k in np.flatnonzero(~two):
                h, v = hv[ho[k] : ho[k + 1]], vv[vo[k] : vo[k + 1]]
                p, q = _local_edges(np.concatenate([h, v]), np.repeat([False, True], [len(h), len(v)]), distance)
                a.append(p)
                b.append(q)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return packed.mapInArrow(run, "a long, b long").where("a <> b")


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, th, fingerprint, component_id, keeper): one row per row of ``docs``.

    ``keeper``: this row, or a row like it, is its class's first: smallest doc_id, then smallest text hash; null
    doc_ids come last.
    """
    prints = written(fingerprints(docs, shingle), "prints")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    points = written(prints.groupBy("fp").agg(F.min(own).alias("first")), "points")
    roots = written(connected_components(links(points.select("fp"), distance)), "roots")
    classes = points.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("first").alias("first"))
    ids = written(classes.drop("first").join(smallest, "root").select("fp", F.col("first").alias("head")), "classes")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    keeper = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("th") == F.col("head.th"))
    return prints.join(ids, "fp").select("doc_id", "th", hexed.alias("fingerprint"), F.col("head.doc_id").alias("component_id"), keeper.alias("keeper"))


def keep_one(docs: DataFrame, *, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row left of each class of near-duplicates, all columns kept."""
    found = near_duplicates(docs.select("doc_id", "text"), shingle=shingle, distance=distance).where("keeper")
    return keep_named(docs, found)
