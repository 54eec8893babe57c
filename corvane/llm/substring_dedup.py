"""Removing repeated passages: windows of words that occur earlier, found by recompression.

1. *Anchors.*  Each task rewrites its documents in rounds that name runs and pairs of words
   (``recompression``) and emits, for every window of ``width`` words, the anchor it picks, once per
   symbol occurrence.  Of the rows for one anchor a task emits one, and resolves itself what it can.
2. *Shared anchors.*  A window function over the anchors' names leaves those that two documents, or two
   places of one document, share.
3. *Windows.*  Each document meets the list of its own shared anchors again; the windows below
   them are named with 128 bits, and again a task emits one row per name, its first.
4. *Earlier occurrences.*  The first occurrence of each name is kept, all others are removed; a final pass
   unites the removed windows of a document and joins what is left.

A copy of a whole text is resolved by a hash of the text: all windows of a later copy are removed.
Because tasks resolve repeats among their own rows, a name that a third of all documents share
is at most one row per task in a shuffle, and no list is longer than one document.

Order is by doc_id, then by start; rows with the same doc_id and different texts are not earlier than one another
unless the start is smaller.

Edge cases: a null text has no words, nothing is removed, ``kept_sha256`` is that of the empty string;
texts of fewer than ``width`` words keep all; repeated rows (same doc_id and text) are equally early and
treated alike; a null doc_id comes before all others; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import drop_written, release, small_batches, text_batches, written
from corvane.llm.recompression import window_anchors, window_names

WIDTH = 20
#: Rows that a task holds before it resolves and emits them.
HOLD = 1_000_000
_FIRST = -(2**63)


def _tokens(text: str | None) -> list[int]:
    import xxhash

    return [xxhash.xxh64_intdigest(w, 7) for w in (text or "").encode().split()]


def _pieces(batches: Iterator[pa.RecordBatch], tokens: int = 300_000) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(rows, token names, each token's row number) of a few documents at a time."""
    rows, names, size = [], [], 0
    for batch in batches:
        for row in batch.to_pylist():
            t = np.array(_tokens(row["text"]), np.uint64)
            row["text"] = None
            rows.append(row)
            names.append(t)
            size += len(t)
            if size >= tokens:
                yield rows, np.concatenate(names), np.repeat(np.arange(len(rows)), [len(x) for x in names])
                rows, names, size = [], [], 0
    if rows:
        yield rows, np.concatenate(names), np.repeat(np.arange(len(rows)), [len(x) for x in names])


def _emit_anchors(width: int, hold: int):
    """Rows (anchor, doc, th, low, high, many, own): own rows are already known to share their anchor."""

    def resolve(held: list[pd.DataFrame]) -> pa.RecordBatch:
        f = pd.concat(held, ignore_index=True).sort_values(["anchor", "doc"], kind="stable")
        groups = f.groupby("anchor", sort=False)
        first = ~f.duplicated("anchor")
        low, high, many = groups["th"].transform("min"), groups["th"].transform("max"), groups["many"].transform("max")
        shared = (low != high) | many
        f = f.assign(low=low, high=high, many=many, own=False)
        once = ~f.duplicated(["anchor", "th"])
        out = pd.concat([f[first], f[shared & once].assign(own=True)])
        return pa.RecordBatch.from_pandas(out[["anchor", "doc", "th", "low", "high", "many", "own"]], preserve_index=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for rows, tokens, owner in _pieces(text_batches(batches)):
            starts, anchor, occurrence = window_anchors(tokens, owner, width)
            if not len(starts):
                continue
            _, at = np.unique(occurrence, return_index=True)
            f = pd.DataFrame({"anchor": anchor[at].view(np.int64), "row": owner[starts[at]]})
            f = f.groupby(["anchor", "row"], sort=False).size().rename("n").reset_index()
            doc, th = np.array([r["doc"] for r in rows], np.int64), np.array([r["th"] for r in rows], np.int64)
            held.append(pd.DataFrame({"anchor": f["anchor"], "doc": doc[f["row"]], "th": th[f["row"]], "many": f["n"] > 1}))
            size += len(f)
            if size >= hold:
                yield resolve(held)
                held, size = [], 0
        if held:
            yield resolve(held)

    return run


def _emit_windows(width: int, hold: int):
    """Rows (high, low, doc, th, start) of a task's first windows; of its later ones (doc, th, starts)."""
    names = ["high", "low", "doc", "th", "start", "starts"]

    def resolve(held: list[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        f = pd.concat(held, ignore_index=True).sort_values(["high", "low", "doc", "start"], kind="stable")
        top = f.groupby(["high", "low"], sort=False)[["doc", "start"]].transform("first")
        first = (f["doc"] == top["doc"]) & (f["start"] == top["start"])
        out = f[first]
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[c], pa.int64()) for c in names[:4]] + [pa.array(out["start"], pa.int32()), pa.nulls(len(out), pa.list_(pa.int32()))], names=names
        )
        later = f[~first].sort_values(["doc", "th", "start"])
        if len(later):
            heads = np.flatnonzero(~later.duplicated(["doc", "th"]).to_numpy())
            lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(later)), pa.int32()), pa.array(later["start"], pa.int32()))
            n = len(heads)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *[pa.array(later[c].to_numpy()[heads], pa.int64()) for c in ("doc", "th")], pa.nulls(n, pa.int32()), lists],
                names=names,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for rows, tokens, owner in _pieces(text_batches(batches)):
            starts, anchor, _ = window_anchors(tokens, owner, width)
            shared = [np.array(r["anchors"], np.int64) for r in rows]
            by_row = owner[starts]
            edges = np.searchsorted(by_row, np.arange(len(rows) + 1))
            keep = np.zeros(len(starts), bool)
            for k, own in enumerate(shared):
                keep[edges[k] : edges[k + 1]] = np.isin(anchor[edges[k] : edges[k + 1]].view(np.int64), own)
            if not keep.any():
                continue
            high, low = window_names(tokens, starts[keep], width)
            row = by_row[keep]
            doc, th = np.array([r["doc"] for r in rows], np.int64), np.array([r["th"] for r in rows], np.int64)
            begin = np.searchsorted(owner, np.arange(len(rows)))
            held.append(
                pd.DataFrame({"high": high.view(np.int64), "low": low.view(np.int64), "doc": doc[row], "th": th[row], "start": (starts[keep] - begin[row]).astype(np.int32)})
            )
            size += int(keep.sum())
            if size >= hold:
                yield from resolve(held)
                held, size = [], 0
        if held:
            yield from resolve(held)

    return run


def _finish(width: int, text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            n_words, n_removed, sha, kept = [], [], [], []
            for row in batch.to_pylist():
                words = (row["text"] or "").encode().split()
                n = len(words)
                gone = np.zeros(n + 1, np.int64)
                if row["copy"] and n >= width:
                    gone[0], gone[n] = 1, -1
                else:
                    for starts in row["lists"] or []:
                        at = np.array(starts, np.int64)
                        np.add.at(gone, at, 1)
                        np.add.at(gone, at + width, -1)
                covered = np.cumsum(gone)[:n] > 0
                left = b" ".join([words[i] for i in np.flatnonzero(~covered)]) if covered.any() else b" ".join(words)
                n_words.append(n)
                n_removed.append(int(covered.sum()))
                sha.append(hashlib.sha256(left).hexdigest())
                if text:
                    kept.append(left.decode())
            arrays = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha)]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(kept, pa.string())] * text, names=names + ["kept"] * text)

    return run


def remove_repeats(docs: DataFrame, *, width: int = WIDTH, hold: int = HOLD, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row per row of ``docs``; ``keep_text`` adds ``kept``."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = dict(docs.dtypes)["doc_id"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("doc"), F.xxhash64(text).alias("th"), text.alias("text")
    )
    whole = base.groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = base.select("doc", "th", F.sha2("text", 256).alias("sha")).join(whole, "sha").where("doc > first")
    copies = written(copies.select("doc", "th").distinct(), "copies")

    rows = base.select("doc", "th", "text").mapInArrow(
        _emit_anchors(width, hold), "anchor long, doc long, th long, low long, high long, many boolean, own boolean"
    )
    anchors = written(rows, "anchors")
    group = Window.partitionBy("anchor")
    shared = (F.min("low").over(group) != F.max("high").over(group)) | F.max("many").over(group)
    found = anchors.where("not own").withColumn("shared", shared).where("shared").select("doc", "th", "anchor")
    found = found.unionByName(anchors.where("own").select("doc", "th", "anchor"))
    per_doc = written(found.groupBy("doc", "th").agg(F.collect_set("anchor").alias("anchors")), "shared")
    drop_written(anchors)
    release(spark)

    with_anchors = base.select("doc", "th", "text").join(copies, ["doc", "th"], "left_anti").join(per_doc, ["doc", "th"])
    rows = with_anchors.mapInArrow(
        _emit_windows(width, hold), "high long, low long, doc long, th long, start int, starts array<int>"
    )
    windows = written(rows, "windows")
    drop_written(per_doc)
    release(spark)
    place = F.struct("doc", "start")
    one = windows.where("starts is null").withColumn("first", F.min(place).over(Window.partitionBy("high", "low")))
    one = one.where(place != F.col("first")).groupBy("doc", "th").agg(F.collect_list("start").alias("starts"))
    lists = one.unionByName(windows.where("starts is not null").select("doc", "th", "starts"))
    lists = written(lists.groupBy("doc", "th").agg(F.collect_list("starts").alias("lists")), "removed")
    drop_written(windows)
    release(spark)

    final = (
        base.join(lists, ["doc", "th"], "left")
        .join(copies.withColumn("copy", F.lit(True)), ["doc", "th"], "left")
        .select("doc_id", "text", "lists", "copy")
    )
    return final.mapInArrow(_finish(width, keep_text), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)
