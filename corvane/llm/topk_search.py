"""Exact top-k inner products, pruned by segment means and deviations from coarse to fine.

Vectors are scaled to integers, floor(scale * x).  Cut into segments of width w, a query q and a candidate c satisfy

    <q, c>  <=  sum over segments of  w * mean_q * mean_c + w * dev_q * dev_c

(Cauchy-Schwarz on what is left after the means), which is the lower bound of their squared distance by
the same statistics, (|q|^2 + |c|^2 - bound) / 2, and grows tighter from one segment to ever smaller ones.
Rows are packed into blocks of a bounded number of rows, held as bytes; for each pair of a candidate and a query block
the bounds are computed level by level (a coarse level that a few of the queries show to leave nearly all is passed over), and
exact integer products for the survivors of the finest level, against the k-th best score that the query has found so far: in a
first pass over about one in ``FIRST`` blocks, an exact score and hence safe everywhere, then among the candidates that its task
has met.  Block pairs are the product of the partitions of the two tables, which tasks read again rather than have them copied
by a shuffle or broadcast; a task meets one partition of either, so tasks grow in number with the input, not in size, and return
k rows for each of their queries, ranked again over all tasks.

Edge cases: vectors that are null, empty, or hold a null or non-finite component take no part; queries and candidates of
different lengths have no score; ties go to the smaller id; a query never finds its own
row's id, hence no row that repeats its id; repeated candidates of one id count once each; an empty table gives an empty result;
scores outside the 64-bit range are set to its ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import small_batches, written

SCALE = 256
#: Segment widths as parts of a vector, coarse to fine.
PARTS = (1, 4, 16, 32)
#: Rows of a block of candidates and of queries, and blocks of a partition.
ROWS, QUERIES, BLOCKS = 4096, 1024, 16
#: Query blocks whose statistics a task keeps.
HELD = 64
#: One in so many blocks of candidates is met first, for bars.
FIRST = 64
#: A coarse level that leaves more than this share of the pairs of some of the queries is passed over.
IDLE = 0.95
#: Where more than this share of pairs is left, a matrix product is cheaper than products pair by pair.
DENSE = 0.005
PACKED = "number long, first boolean, dim int, kind string, ids binary, v binary, start binary"
ARROW = {"number": pa.int64(), "first": pa.bool_(), "dim": pa.int32(), "kind": pa.string(), "ids": pa.binary(), "v": pa.binary(), "start": pa.binary()}


def _segments(m: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of about ``parts`` segments, each times the root of the segment's width."""
    edges = np.unique(np.linspace(0, m.shape[1], min(parts, m.shape[1]) + 1).astype(int))
    widths = np.diff(edges)
    of_segment = np.repeat(np.eye(len(widths)), widths, axis=0)
    sums = m @ of_segment
    return sums / np.sqrt(widths), np.sqrt(np.maximum(m**2 @ of_segment - sums**2 / widths, 0))


class _Side:
    """Vectors of one block with what their bounds need, worked out once for all blocks that they meet."""

    def __init__(self, m: np.ndarray, parts: tuple[int, ...]):
        self.m, self.parts = m, parts
        self.norm, self.top = np.linalg.norm(m, axis=1).max(initial=0), np.abs(m).max(initial=0)
        self.stats, self.as_kind = [np.hstack(_segments(m, p)) for p in parts], {}

    def of(self, kind: type) -> tuple[np.ndarray, list[np.ndarray]]:
        if kind not in self.as_kind:
            self.as_kind = {kind: (self.m.astype(kind), [x.astype(kind) for x in self.stats])}
        return self.as_kind[kind]


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row-wise integer products, whatever their size, clipped to 64 bits."""
    if max(np.abs(q).max(initial=0.0), np.abs(c).max(initial=0.0)) < 2**25:
        return np.einsum("ij,ij->i", q.astype(np.int64), c.astype(np.int64))
    return np.array([max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(a, b, strict=True)))) for a, b in zip(q, c, strict=True)], np.int64)


def _scores(q: np.ndarray, c: np.ndarray, live: np.ndarray, bar: np.ndarray, k: int, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of the pairs in ``live`` that reach ``bar``, and where that is unknown the k-th best of ``live``.

    A matrix product if pairs are many and it is exact (``whole``), else pair by pair.
    """
    if not whole or np.count_nonzero(live) <= DENSE * live.size:
        i, j = np.nonzero(live)
        new = np.concatenate([_exact(q[i[s : s + 50_000]], c[j[s : s + 50_000]]) for s in range(0, len(i), 50_000)] or [np.empty(0, np.int64)])
        reach = new >= bar[i]
        return i[reach], j[reach], new[reach]
    scores = q @ c.T
    open_rows = np.flatnonzero(np.isneginf(bar))
    if len(open_rows) and live.shape[1] >= k:
        bar = bar.copy()
        bar[open_rows] = np.partition(np.where(live[open_rows], scores[open_rows], -np.inf), -k, axis=1)[:, -k]
    places = np.flatnonzero(live & (scores >= bar.astype(scores.dtype)[:, None]))
    i, j = np.divmod(places, live.shape[1])
    return i, j, scores.ravel()[places].astype(np.int64)


def search_block(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, **more):
    """(query, candidate, score) arrays of each query's k best candidates within one block; for ``more`` see ``merge_block``."""
    parts = more.pop("parts", PARTS)
    place, found, score = merge_block(qid, _Side(q, parts), cid, _Side(c, parts), k, **more)
    return qid[place], found, score


def merge_block(
    qid: np.ndarray, asking: _Side, cid: np.ndarray, among: _Side, k: int, chunk: int = 2048, start: np.ndarray | None = None, tally: list[int] | None = None,
    best: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None,
):
    """(query's place in ``qid``, candidate, score) arrays of each query's k best candidates of this block and in ``best``.

    ``start``: for each query, a score that k candidates are known to reach; candidates below it may be left out.
    ``tally``: takes the numbers of pairs that were not pruned.
    ``best``: what this function returned for the same queries and other candidates.
    """
    most = asking.norm * among.norm
    # no sum of a product's terms leaves the integers that its type holds; nor does an entry
    single = max(most, asking.top, among.top) < 2**24
    whole, kind = most < 2**53, np.float32 if single else np.float64
    (q, stats_q), (c, stats_c) = asking.of(kind), among.of(kind)
    # rounding of the statistics, of their products and of the bar
    slack = (1.2e-7 * (2 * max(asking.parts) + 8) if single else 1e-7) * most + 1e-6
    rows, found, score = best or (np.empty(0, np.int64),) * 3
    bar = np.full(len(qid), -np.inf) if start is None else start.astype(float)
    # a score clipped or rounded to a double may lie above the exact one
    bar = bar - np.abs(np.nan_to_num(bar, neginf=0)) * 1e-15

    def ranked() -> np.ndarray:
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        full, last = rows[place == k - 1], score[place == k - 1]
        bar[full] = np.maximum(bar[full], last * (1 - 1e-15 * np.sign(last)))
        return place < k

    ranked()
    for a in range(0, len(cid), chunk):
        part = slice(a, a + chunk)
        need = np.ceil(bar)  # scores are whole
        live = np.ones((len(qid), len(cid[part])), bool)
        own = np.flatnonzero(np.isin(cid[part], qid))
        live[:, own] = qid[:, None] != cid[part][None, own]
        if np.isfinite(most) and np.isfinite(bar).any():
            least = (need - slack).astype(kind)[:, None]
            some = slice(None, None, 16)
            for level, (of_q, of_c) in enumerate(zip(stats_q, stats_c, strict=True)):
                if level < len(stats_q) - 1 and (of_q[some] @ of_c[part].T >= least[some]).mean() > IDLE:
                    continue
                live &= of_q @ of_c[part].T >= least
        left = int(np.count_nonzero(live))
        if tally is not None:
            tally.append(left)
        if left < live.size / 8:
            left_q, left_c = np.flatnonzero(live.any(axis=1)), np.flatnonzero(live.any(axis=0))
            i, j, new = _scores(q[left_q], c[part][left_c], live[np.ix_(left_q, left_c)], need[left_q], k, whole)
            i, j = left_q[i], left_c[j]
        else:
            i, j, new = _scores(q, c[part], live, need, k, whole)
        if not len(i):
            continue
        rows, score, found = np.concatenate([rows, i]), np.concatenate([score, new]), np.concatenate([found, cid[part][j]])
        # ~score orders from the highest score without leaving 64 bits
        order = np.lexsort((found, ~score, rows))
        rows, score, found = rows[order], score[order], found[order]
        kept = ranked()
        rows, score, found = rows[kept], score[kept], found[kept]
    return rows, found, score


def _packed(rows: DataFrame, per_block: int, scale: int, tag: str) -> DataFrame:
    """``PACKED``: blocks of ``per_block`` rows at most, of one dimension each, as bytes of whole numbers; ``rows``: (id, v, start)."""
    spark = rows.sparkSession
    total = rows.count()
    blocks = -(-total // per_block)
    number = max(1, -(-blocks // BLOCKS), min(spark.sparkContext.defaultParallelism, blocks))
    # by a hash of all, so that neither a block nor a partition is made of rows that lie together
    dealt = rows.repartition(number, F.xxhash64("id", "v")).withColumn("p", F.spark_partition_id())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for batch in batches:
            ids, vectors, start, p = batch.columns
            sizes = pc.list_value_length(vectors).to_numpy()
            for dim in np.unique(sizes):
                here = pa.array(np.flatnonzero(sizes == dim))
                x = np.floor(vectors.take(here).flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                top = np.abs(x).max()
                kind = "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<f8"
                of = p[0].as_py()
                block = (
                    (of << 32) + seq, (of * BLOCKS + seq) % FIRST == 0, int(dim), kind, ids.take(here).to_numpy().astype("<i8").tobytes(),
                    x.astype(kind).tobytes(), start.take(here).to_numpy(zero_copy_only=False).astype("<f8").tobytes(),
                )
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(block, ARROW.values(), strict=True)], names=list(ARROW))
                seq += 1

    small_batches(spark, per_block)
    return written(dealt.mapInArrow(pack, PACKED), tag)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, <id_col>, score): the k best candidates of every query row."""
    spark = vectors.sparkSession
    v = F.col(vector_col)
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(sound & F.col(id_col).isNotNull())
    plain = vectors.schema[vector_col].dataType.simpleString() in ("array<float>", "array<double>")
    rows = rows.select(F.col(id_col).cast("long").alias("id"), (v if plain else v.cast("array<double>")).alias("v"), F.lit(None).cast("double").alias("start"), is_query.alias("asks"))
    queries = rows.where("asks").drop("asks")
    candidates = _packed(rows.drop("asks"), ROWS, scale, "candidates")

    def unpack(batch: pa.RecordBatch, row: int, side: str) -> tuple[np.ndarray, ...]:
        of = lambda name: batch.column(f"{side}_{name}")[row]
        ids = np.frombuffer(of("ids").as_buffer(), "<i8")
        return ids, np.frombuffer(of("v").as_buffer(), of("kind").as_py()).reshape(len(ids), -1).astype(float), np.frombuffer(of("start").as_buffer(), "<f8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, sides = {}, {}  # the task's queries are one partition of their table
        for batch in batches:
            for row in range(batch.num_rows):
                of_q, of_c = (batch.column(f"{side}_number")[row].as_py() for side in "qc")
                if sides.get("c", (None,))[0] != of_c:
                    cid, cm, _ = unpack(batch, row, "c")
                    sides["c"] = of_c, cid, _Side(cm, PARTS)
                if of_q not in sides:
                    qid, qm, start = unpack(batch, row, "q")
                    if len(sides) > HELD:
                        sides.pop(next(x for x in sides if x != "c"))
                    sides[of_q] = qid, _Side(qm, PARTS), np.where(np.isnan(start), -np.inf, start)
                (qid, asking, start), (_, cid, among) = sides[of_q], sides["c"]
                best[of_q] = qid, merge_block(qid, asking, cid, among, k, start=start, best=best[of_q][1] if of_q in best else None)
        for qid, (place, found, score) in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(qid[place]), pa.array(found), pa.array(score)], names=["query_id", "id", "score"])

    def search(asking: DataFrame, among: DataFrame) -> DataFrame:
        """(query_id, id, score): k rows of each query and each partition of ``among``; queries have a ``start``."""
        named = lambda side, df: df.select(*[F.col(x).alias(f"{side}_{x}") for x in ("number", "dim", "kind", "ids", "v", "start")])
        q = named("q", _packed(asking, QUERIES, scale, "queries"))
        # every candidate meets every query: the queries are a stated set against all rows.  Not an equality, which
        # would send all blocks of a dimension to one partition
        pairs = named("c", among).hint("shuffle_replicate_nl").join(q, F.col("c_dim").between(F.col("q_dim"), F.col("q_dim")))
        small_batches(spark, 8)
        return pairs.select("q_number", "q_kind", "q_ids", "q_v", "q_start", "c_number", "c_kind", "c_ids", "c_v", "c_start").mapInArrow(run, "query_id long, id long, score long")

    def best_of(near: DataFrame) -> DataFrame:
        return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    bars = best_of(search(queries, candidates.where("first"))).where(F.col("rank") == k)
    bars = bars.select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("start"))
    # a query id that several rows have may have found more than k candidates: no bar for it
    alone = queries.groupBy("id").agg(F.count("*").alias("n")).where("n = 1").select("id").join(bars, "id")
    near = search(queries.drop("start").join(alone, "id", "left").select("id", "v", "start"), candidates)
    return best_of(near).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
