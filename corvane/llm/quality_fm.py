"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A document's features are its hashed words (counts, scaled to length one), measures of structure
and its length.  The score is the logistic function of

    w0 + sum w_i x_i + 1/2 sum_f [ (sum v_if x_i)^2 - sum (v_if x_i)^2 ]

which is all pairwise interactions through rank-``rank`` factors in time linear in the features
(the sum-of-squares identity).  It is fitted by AdaGrad in numpy on the driver, on
``sample_rows`` labelled rows at most, those of smallest hash, which bounds the driver's memory whatever the input;
every document is scored, in Arrow batches.

The fit sees rows of ``labels`` whose doc_id isn't held out; labels, lang, source and doc_id are no features.

Edge cases: null and empty texts have no words and are scored by the rest; a null quality is no label; a null doc_id
isn't held out and has no label; repeated rows are scored each; without usable labels every score is 0.5; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import small_batches, text_batches

BUCKETS = 1 << 16
RANK = 6
SAMPLE_ROWS = 8000
EPOCHS = 6
_DIGIT, _UPPER = re.compile(rb"[0-9]"), re.compile(rb"[A-Z]")
MEASURES = 14
_known: dict[bytes, int] = {}


def _bucket(word: bytes) -> int:
    import xxhash

    if len(_known) > 400_000:
        _known.clear()
    b = _known[word] = xxhash.xxh64_intdigest(word, 11) % BUCKETS
    return b


def measures(raw: bytes, words: list[bytes], distinct: int, top: int) -> list[float]:
    """Structure of a text, each measure about 0 to 1, and its length."""
    n, size = max(1, len(words)), max(1, len(raw))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    symbols = sum(raw.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"<", b">", b"~", b"^"))
    stops = sum(raw.count(c) for c in (b".", b",", b";", b":"))
    near = sum(a == b for a, b in zip(words, words[1:], strict=False))
    letters = len(_UPPER.findall(raw))
    return [
        np.log1p(len(words)) / 10,
        np.log1p(len(raw)) / 12,
        min(1.0, size / n / 20),
        min(1.0, 4 * symbols / n),
        min(1.0, 2 * stops / n),
        min(1.0, 2 * raw.count(b"!") / n),
        min(1.0, 2 * raw.count(b"|") / n),
        min(1.0, 3 * letters / size),
        min(1.0, 10 * len(_DIGIT.findall(raw)) / size),
        distinct / n,
        top / n,
        min(1.0, 4 * near / n),
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, 20 * len(lines) / n),
    ]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(index, value) of a document's features; the measures come after the buckets."""
    raw = (text or "").encode()
    words = raw.split()
    known = _known
    cells = np.array([known[w] if w in known else _bucket(w) for w in words], np.int64)
    index, counts = np.unique(cells, return_counts=True)
    value = counts.astype(np.float64)
    value /= max(1.0, float(np.sqrt((value**2).sum())))
    m = measures(raw, words, len(index), int(counts.max(initial=0)))
    return np.concatenate([index, BUCKETS + np.arange(MEASURES)]), np.concatenate([value, m])


def raw_score(index: np.ndarray, value: np.ndarray, model: dict) -> float:
    v = model["v"][index] * value[:, None]
    return float(model["w0"] + model["w"][index] @ value + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum()))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], rank: int = RANK, epochs: int = EPOCHS, seed: int = 5) -> dict:
    """A machine fitted by AdaGrad with decay of weights and factors."""
    size = BUCKETS + MEASURES
    rng = np.random.default_rng(seed)
    model = {"w0": 0.0, "w": np.zeros(size), "v": rng.normal(0, 0.05, (size, rank))}
    g0, gw, gv = 1.0, np.ones(size), np.ones((size, rank))
    rate = 0.15
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            i, x = rows[k]
            v = model["v"][i]
            vx = v * x[:, None]
            total = vx.sum(axis=0)
            y = model["w0"] + model["w"][i] @ x + 0.5 * ((total**2).sum() - (vx**2).sum())
            slope = 1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[k]
            dw = slope * x + 1e-5 * model["w"][i]
            dv = slope * (x[:, None] * total - vx * x[:, None]) + 1e-4 * v
            g0 += slope**2
            gw[i] += dw**2
            gv[i] += dv**2
            model["w0"] -= rate * slope / np.sqrt(g0)
            model["w"][i] -= rate * dw / np.sqrt(gw[i])
            model["v"][i] -= 0.3 * rate * dv / np.sqrt(gv[i])
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> dict | None:
    """A machine fitted on a bounded sample of the rows that are not held out."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            made = [features(t) for t in batch.column("text").to_pylist()]
            arrays = [batch.column("doc_id"), batch.column("quality"), pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "quality", "index", "value"])

    # at most sample_rows doc_ids: few enough to broadcast, and one row of each, however often it repeats, to collect
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen.withColumn("quality", F.col("quality").cast("int"))), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))
    got = rows.select("doc_id", "quality", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, quality int, index array<int>, value array<float>").toArrow()
    if not got.num_rows:
        return None
    got = got.combine_chunks()
    order = np.argsort(np.array(got["doc_id"].to_pylist()), kind="stable")
    index, value = got["index"], got["value"]
    data = [(index[int(k)].values.to_numpy().astype(np.int64), value[int(k)].values.to_numpy().astype(np.float64)) for k in order]
    y = got["quality"].to_numpy()[order]
    return fit(data, [int(q > 0) for q in y])


def score_quality(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in text_batches(batches):
            y = [0.0 if machine is None else raw_score(*features(t), machine) for t in batch.column("text").to_pylist()]
            score = 1 / (1 + np.exp(-np.clip(np.array(y, float), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    scored = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
