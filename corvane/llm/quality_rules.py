"""Quality rules: shape rules, then a hashed n-gram likelihood ratio.

Every word and every pair of neighbouring words of a document is hashed to one of
``buckets`` cells.  Over *all* documents the cells are counted for the raw corpus and over all
trusted rows for the target.  With target counts t (scaled to the raw total), raw counts r
and a prior weight a, a cell's weight is log((t + a) / (r + a)): the log-likelihood ratio of
two multinomials smoothed by the same prior, so that a cell that neither has seen much says
little.  A document's own occurrence is taken off both counts (off t if the document is trusted), or else words that
no other document has would count for it or against it by its label.  Raw occurrences are weighted by language
(or another column, ``strata``), so that the raw corpus has the target's mix of languages and no document loses for
being written in a language of which few rows are trusted.  A document's score is the mean weight of its n-grams, and it is kept if no
shape rule fails and the score reaches ``threshold``.

DataFrame functions only.  The cell table has ``buckets`` cells whatever the input, which is what
bounds the broadcast of it, and is held as rows of 2^``PAGE_BITS`` cells each, where a place is looked up faster than a row of its own; the trusted ids are broadcast only after a count shows that
they are few, and joined by a shuffle otherwise.

Edge cases: a null text has no words, so every count is 0 and it fails the length rule;
a document without n-grams scores 0; repeated rows are scored and returned each; a null
doc_id is never trusted; a null language is one of its own; documents in languages without trusted rows, or without
their own column, are scored near 0, so that shape rules decide; an empty table gives an empty result; other columns pass through
``annotate_quality`` untouched as long as they don't begin with ``_q_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import SPACES, bind, one_space, written

BUCKETS = 1 << 20
PRIOR = 40.0
THRESHOLD = -0.075
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Weights are rounded to this part of one, so that sums are exact and reruns agree.
UNIT = 1_000_000
#: Raw occurrences are weighted in whole parts of this.
STRATUM_UNIT = 1024
#: So many low bits of a cell are its place in one row of the broadcast table.
PAGE_BITS = 10
#: Trusted ids that are broadcast at most (16 bytes each).
BROADCAST_IDS = 2_000_000


def but_first(items: Column) -> Column:
    return F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))


def but_last(items: Column) -> Column:
    return F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0)))


def joined_hashes(hashes: Column) -> Column:
    """The hashes of all neighbouring two: of words those of the pairs, of pairs those of 3-word windows."""
    return F.zip_with(but_last(hashes), but_first(hashes), lambda a, b: F.xxhash64(a, b))


def with_hashes(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_q_pieces``, the text between white-space characters, and ``_q_h``, the hashes of its words.

    Each column is made in a step of its own, so that none is worked out twice.
    """
    pieces = rows.withColumn("_q_pieces", F.split(one_space(F.col("text")), " "))
    return pieces.withColumn("_q_h", F.transform(F.array_remove("_q_pieces", ""), lambda w: F.xxhash64(w)))


def with_repeat_words(rows: DataFrame) -> DataFrame:
    """``rows``, which hold ``_q_h``, with n_repeat_words: words in a 3-word window that the text has twice or more.

    Windows are sorted by the upper bits of their hashes, whose lower bits make room for the place;
    neighbours whose whole hashes agree are repeats, and the union of their spans is measured place by place.
    """
    windows, order, bits = F.col("_q_t"), F.col("_q_order"), F.col("_q_bits")
    place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).cast("int")
    upper = lambda x: F.call_function("shiftright", x, bits)
    twins = lambda x, y: (upper(x) == upper(y)) & (F.get(windows, place(x)) == F.get(windows, place(y)))
    packed = F.transform(windows, lambda x, i: F.call_function("shiftleft", upper(x), bits).bitwiseOR(i.cast("long")))
    spans = F.aggregate(
        F.sort_array("_q_twins"),
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"].cast("long"),
    )
    return (
        rows.withColumn("_q_p", joined_hashes(F.col("_q_h")))
        .withColumn("_q_t", joined_hashes(F.col("_q_p")))
        .withColumn("_q_some", F.size(F.array_distinct("_q_t")) < F.size("_q_t"))
        .withColumn("_q_bits", F.length(F.bin(F.size("_q_t"))))
        .withColumn("_q_packed", F.when(F.col("_q_some"), packed).otherwise(F.array().cast("array<long>")))
        .withColumn("_q_order", F.sort_array("_q_packed"))
        .withColumn("_q_double", F.filter(order, lambda x, k: twins(x, F.get(order, k - 1)) | twins(x, F.get(order, k + 1))))
        .withColumn("_q_twins", F.transform("_q_double", place))
        .withColumn("n_repeat_words", spans)
        .drop("_q_p", "_q_t", "_q_some", "_q_bits", "_q_packed", "_q_order", "_q_double", "_q_twins")
    )


def with_shape(rows: DataFrame) -> DataFrame:
    """``rows`` with the measures of a document's shape, and ``_q_h`` in place of ``text``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    measured = with_hashes(rows).withColumns(
        {
            "n_words": F.size("_q_h").cast("long"),
            "word_chars": (F.length(text) - F.size("_q_pieces") + 1).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        }
    )
    return with_repeat_words(measured.drop("text", "_q_pieces"))


def ngram_cells(rows: DataFrame, keep: list[str], buckets: int) -> DataFrame:
    """(keep, cell): one row per word and per pair of words of each row's text."""
    hashes = with_hashes(rows.select(*keep, "text")).select(*keep, "_q_h")
    pairs = hashes.withColumn("_q_p", joined_hashes(F.col("_q_h")))
    grams = pairs.select(*keep, F.explode(F.concat("_q_h", "_q_p")).alias("_q_gram"))
    # of a power of two the remainder is the low bits, which are read faster
    cell = F.col("_q_gram").bitwiseAND(F.lit(buckets - 1)) if buckets & (buckets - 1) == 0 else F.pmod("_q_gram", F.lit(buckets))
    return grams.select(*keep, cell.cast("int").alias("cell"))


def flag_trusted(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``docs`` with ``_q_good``, 1 for rows whose doc_id is in ``trusted``, else 0."""
    ids = trusted.select(F.col("doc_id").alias("_q_trusted")).where("_q_trusted is not null").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    joined = docs.join(ids, F.col("doc_id") == F.col("_q_trusted"), "left")
    return joined.withColumn("_q_good", F.col("_q_trusted").isNotNull().cast("int")).drop("_q_trusted")


def stratum_weights(shaped: DataFrame) -> DataFrame:
    """(_q_s, _q_w): what a raw occurrence of each stratum counts, in parts of ``STRATUM_UNIT``."""
    size = F.col("n_words")
    sums = written(shaped.groupBy("_q_stratum").agg(F.sum(size).alias("r"), F.sum(size * F.col("_q_good")).alias("t")), "strata")
    totals = sums.agg(F.sum("r").alias("all_r"), F.sum("t").alias("all_t"))
    # as doubles: products of counts of words leave 64 bits
    weight = F.try_divide(F.col("t").cast("double") * F.col("all_r"), F.col("r").cast("double") * F.col("all_t"))
    strata = sums.crossJoin(F.broadcast(totals)).select(
        F.col("_q_stratum").alias("_q_s"), F.coalesce(F.floor(weight * STRATUM_UNIT + 0.5), F.lit(0)).cast("long").alias("_q_w")
    )
    return written(strata, "strata")  # a table of known size: broadcast by the session's own threshold


def cell_counts(weighed: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(cell, t, r, scale): of every cell that a document has, from counts over all rows."""
    counts = written(
        ngram_cells(weighed, ["_q_good", "_q_w"], buckets)
        .groupBy("cell")
        .agg(F.sum("_q_good").alias("t"), F.sum("_q_w").alias("r")),
        "cells",
    )
    totals = counts.agg(F.coalesce(F.try_divide(F.sum("r"), F.sum("t")), F.lit(0.0)).alias("scale"))
    return counts.crossJoin(F.broadcast(totals))


def cell_pages(counts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(page, ts, rs, scale): the counts of 2^``PAGE_BITS`` neighbouring cells as arrays, zeros for cells that no document has."""
    every = counts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("cell"))
    filled = every.join(counts, "cell", "left").groupBy(F.shiftright("cell", PAGE_BITS).alias("page")).agg(
        F.sort_array(F.collect_list(F.struct("cell", F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("r", F.lit(0)).alias("r")))).alias("of"),
        F.max("scale").alias("scale"),
    )
    return filled.select("page", F.col("of.t").alias("ts"), F.col("of.r").alias("rs"), "scale")


def annotate_quality(
    docs: DataFrame, trusted: DataFrame, *, strata: str | None = "lang", buckets: int = BUCKETS, prior: float = PRIOR, threshold: float = THRESHOLD
) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept.

    Input columns of those names are replaced.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
    own = [c for c in docs.columns if c.lower() not in made]
    stratum = F.col(f"`{strata}`").cast("string") if strata else F.lit("")
    # a row is known by its text and by its id and stratum: rows alike in these have the same verdict
    key = {"_q_a": F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), "_q_b": F.xxhash64(F.col("doc_id"), stratum)}
    rows = docs.select(*[F.col(f"`{c}`") for c in own]).withColumns(key)
    flagged = flag_trusted(rows.select("_q_a", "_q_b", "doc_id", "text", stratum.alias("_q_stratum")), trusted)
    shaped = written(with_shape(flagged).drop("doc_id", "_q_h"), "shape")
    weighed = flagged.join(stratum_weights(shaped), F.col("_q_stratum").eqNullSafe(F.col("_q_s"))).drop("_q_s")
    pages = F.broadcast(written(cell_pages(cell_counts(weighed, buckets), buckets), "pages"))
    place = F.col("cell").bitwiseAND((1 << PAGE_BITS) - 1)
    t = F.greatest(F.get("ts", place) - F.col("_q_good"), F.lit(0)) * F.col("scale")
    r = F.greatest(F.get("rs", place) - F.col("_q_w"), F.lit(0))
    # counts of the raw corpus are in parts of STRATUM_UNIT, and so is the scale
    weight = F.log((t + F.lit(prior * STRATUM_UNIT)) / (r + F.lit(prior * STRATUM_UNIT)))
    scores = (
        ngram_cells(weighed, ["_q_a", "_q_b", "_q_good", "_q_w"], buckets)
        .withColumn("page", F.shiftright("cell", PAGE_BITS))
        .join(pages, "page")
        .groupBy("_q_a", "_q_b")
        .agg(F.sum(F.floor(weight * UNIT + 0.5)).alias("_q_sum"), F.count("*").alias("_q_n"))
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    score = F.coalesce(F.col("_q_sum") / F.col("_q_n") / F.lit(UNIT), F.lit(0.0))
    found = (
        shaped.drop("_q_good", "_q_stratum")
        .dropDuplicates(["_q_a", "_q_b"])
        .join(scores, ["_q_a", "_q_b"], "left")
        .withColumn("base_failed", failed)
        .withColumn("score", score)
        .withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(F.col("score") >= threshold))
        .drop("_q_sum", "_q_n")
    )
    return rows.join(found, ["_q_a", "_q_b"]).drop("_q_a", "_q_b")
