"""Near copies by the share of five-word shingles, found by MinHash and verified exactly.

*Sets.*  A text is lower-cased (A-Z) and cut into words; its set holds the 64-bit hashes of its shingles of
``shingle`` words, or one hash of all words where there are fewer.

*Candidates.*  ``BANDS`` x ``ROWS`` minima of the set under hashes; texts with a band of equal minima meet in a
bucket.  A pair of similarity 0.8 meets in none with a chance of 7e-5, a more similar one with less.

*Verification.*  In each bucket all are compared with its first, exactly on the sets; what is similar to the first
leaves all buckets, the first leaves this one, and the rest goes on.  First means what comes first among the rows to
keep.  What is left in shared buckets after ``ROUNDS`` such rounds, texts that share much yet too little, is joined
exactly by prefixes: shingles that one text alone holds can match nothing, and sets alike by 0.8 share one of the rarest
n - ceil(0.8 n) + 1 of each.  Two rows that are both kept and share a bucket were thus compared, or can't be alike.

Edge cases: null and empty texts are equal; repeated rows are one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import connected_components, join_unique, keep_named, small_batches, text_batches, text_hash, written

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 24, 5
ROUNDS = 3
#: Texts of one prefix shingle that meet in one block.
MEET = 512
#: Pairs of one text that are verified with one copy of it.
FAN = 256
#: Hashes of texts in shared buckets that are broadcast at most (8 bytes each); more are joined in a shuffle.
BROADCAST_TEXTS = 2_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(42).integers(1, 1 << 63, (2, BANDS * ROWS), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    import xxhash

    words = (text or "").encode().lower().split()
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    made: dict[bytes, int] = {w: xxhash.xxh64_intdigest(w, 42) for w in set(words)}
    h = np.array([made[w] for w in words], np.uint64)
    n = len(h) - shingle + 1
    out = np.zeros(n, np.uint64)
    for i in range(shingle):
        out = out * _STEP + h[i : i + n]
    out ^= out >> np.uint64(32)
    return np.unique(out)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One hash of the minima of each band."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 2048):
        x = hashes[None, i : i + 2048] * _SEEDS[0][:, None]
        x ^= x >> np.uint64(32)
        x *= _SEEDS[1][:, None]
        low = np.minimum(low, x.min(axis=1))
    key = np.zeros(BANDS, np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        key = (key ^ column) * _STEP
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _points(docs: DataFrame, shingle: int) -> DataFrame:
    """(th, first, keys): the distinct texts, the first row of each, the keys of its bands."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            keys = [band_keys(shingle_set(t, shingle)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "th", "keys"])

    found = docs.select("doc_id", "th", "text").mapInArrow(run, f"doc_id {kind}, th long, keys array<long>")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    return found.groupBy("th").agg(F.min(first).alias("first"), F.first("keys").alias("keys"))


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similar: float) -> DataFrame:
    """The pairs (a, b) of text hashes that are similar.  A text with very many pairs is dealt out in copies."""
    size = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).cast("int").alias("copies"))
    dealt = pairs.join(size, "a").withColumn("copy", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int")).drop("copies")
    left = texts.join(size.withColumnRenamed("a", "th"), "th").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    left = left.select(F.col("th").alias("a"), "copy", F.col("text").alias("ta"))
    both = dealt.join(texts.select(F.col("th").alias("b"), F.col("text").alias("tb")), "b").join(left, ["a", "copy"]).select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, held, same = None, None, []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if a != last:
                    last, held = a, shingle_set(ta, shingle)
                same.append(similarity(held, shingle_set(tb, shingle)) >= similar)
            yield batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _shared(rows: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one."""
    return rows.join(rows.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n"), ["band", "key"], "left_semi")


def prefix_pairs(texts: DataFrame, shingle: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """Pairs (a, b) of ``texts`` (th, text), a < b, among which all pairs alike by ``similar`` are.

    Shingles are ranked by the number of texts that hold them, rare ones first; a shingle of many texts
    is met block by block, and pairs whose sizes or places in the ranking rule the similarity out are not made.
    """
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            for th, text in zip(batch.column("th").to_pylist(), batch.column("text").to_pylist(), strict=True):
                h = shingle_set(text, shingle).view(np.int64)
                columns = [pa.array(np.full(len(h), th, np.int64)), pa.array(np.full(len(h), len(h), np.int64)), pa.array(h)]
                yield pa.RecordBatch.from_arrays(columns, names=["th", "n", "h"])

    held = written(texts.select("th", "text").mapInArrow(run, "th long, n long, h long"), "shingles")
    counts = written(held.groupBy("h").agg(F.count("*").alias("c")), "counts")
    shared = join_unique(held, counts.where("c > 1").withColumnRenamed("c", "df"), ["h"], counts).where("df is not null")
    ranked = shared.groupBy("th", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("s"))
    alone = F.col("n") - F.size("s")  # shingles of this text only come first
    first = F.greatest(F.lit(0), F.col("n") - F.ceil(F.lit(similar) * F.col("n") - 1e-9) + 1 - alone).cast("int")
    prefix = ranked.select("th", "n", alone.alias("alone"), F.posexplode(F.slice("s", F.lit(1), first)).alias("at", "x"))
    prefix = written(prefix.select("th", "n", (F.col("alone") + F.col("at")).alias("at"), F.col("x.h").alias("h")), "prefix")
    sizes = prefix.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    met = join_unique(prefix, sizes.withColumn("blocks", F.ceil(F.col("c") / MEET).cast("int")), ["h"], sizes).where("c is not null")
    own = F.pmod(F.xxhash64("th"), F.col("blocks")).cast("int")
    met = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("h", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "th", "n", "at")
    left, right = met.toDF("h", "lo", "hi", "a", "na", "pa"), met.toDF("h", "lo", "hi", "b", "nb", "pb")
    most = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    need = F.lit(similar / (1 + similar)) * (F.col("na") + F.col("nb")) - 1e-6
    sized = F.least("na", "nb") >= F.lit(similar) * F.greatest("na", "nb") - 1e-6
    return left.join(right, ["h", "lo", "hi"]).where(F.col("a") < F.col("b")).where(sized & (most >= need)).select("a", "b").distinct()


def similar_edges(docs: DataFrame, points: DataFrame, shingle: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """Edges (a, b) of verified similar texts, by hash: enough that no two rows both kept are similar."""
    left = written(_shared(points.select("th", "first", F.posexplode("keys").alias("band", "key"))), "buckets")
    met = left.select("th").distinct()
    met = F.broadcast(met) if met.count() <= BROADCAST_TEXTS else met
    texts = written(docs.select("th", "text").join(met, "th", "left_semi").dropDuplicates(["th"]), "texts")
    edges = []
    for _ in range(ROUNDS):
        if left.isEmpty():
            break
        heads = left.groupBy("band", "key").agg(F.min(F.struct("first", "th"))["th"].alias("a"))
        sizes = left.groupBy("band", "key").agg(F.count("*").alias("c"))
        rest = written(join_unique(left, heads, ["band", "key"], sizes).where("th <> a"), "rest")
        edges.append(written(_verified(rest.select("a", F.col("th").alias("b")).distinct(), texts, shingle, similar), "similar"))
        rest = rest.drop("a").join(edges[-1].select(F.col("b").alias("th")).distinct(), "th", "left_anti")
        left = written(_shared(rest), "buckets")
    if not left.isEmpty():
        pairs = prefix_pairs(texts.join(left.select("th").distinct(), "th", "left_semi"), shingle, similar)
        edges.append(written(_verified(pairs, texts, shingle, similar), "similar"))
    if not edges:
        return points.sparkSession.createDataFrame([], "a long, b long")
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out


def keep_one(docs: DataFrame, *, shingle: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """``docs`` with one row left of each class of near copies, the one of smallest doc_id, all columns kept."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), text_hash().alias("th"))
    points = written(_points(rows, shingle), "points")
    roots = connected_components(similar_edges(rows, points, shingle, similar))
    classes = points.join(roots, F.col("th") == F.col("node"), "left").select("th", "first", F.coalesce("root", "th").alias("root"))
    kept = classes.groupBy("root").agg(F.min(F.struct("first", "th")).alias("x"))
    return keep_named(docs, kept.select(F.col("x.first.doc_id").alias("doc_id"), F.col("x.th").alias("th")))
