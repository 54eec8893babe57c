"""How text filters overlap: what each removes in every order of application.

Five failure flags are worked out once per document.  SQL's CUBE over the flags and the part counts the documents of
every subset of filters: a grouping set's row whose selected flags are all false holds the survivors of just those
filters.  Each step of each order is then a pair of subsets, before and after, joined with the survivor table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import combinations, permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import SPACES, small_batches, text_batches, written

#: The filters' letters, in the order of the bits that name a subset.
FILTERS = "ABCDE"
MIN_WORDS = 200
#: Least share of distinct words and greatest share of capitals, in hundredths.
LEAST_DISTINCT, MOST_CAPITALS = 50, 3
SYMBOLS = re.compile(rb"[#$%&*|]")
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
#: Bytes of UTF-8 that go on with a code point.
CONTINUED = bytes(range(0x80, 0xC0))
_SPACE = re.compile(b"[" + SPACES.encode() + b"]")
#: Bytes of a text whose words are held at a time.
PIECE = 1 << 20

FLAGS = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("name", pa.binary()), *[(f, pa.bool_()) for f in "ABCD"]])
COUNTS = ("n", "good", "toxic")


def _pieces(text: bytes) -> Iterator[bytes]:
    """``text`` cut at white space into pieces of about PIECE bytes."""
    first = 0
    while first < len(text):
        cut = _SPACE.search(text, first + PIECE) if len(text) - first > PIECE else None
        last = cut.start() if cut else len(text)
        yield text[first:last]
        first = last


def text_flags(text: bytes) -> tuple[bool, bool, bool, bool]:
    """Whether a UTF-8 text fails A, B, C and D."""
    words, distinct = 0, set()
    for piece in _pieces(text):
        found = piece.split()  # of bytes: at space and the controls from tab to carriage return
        words += len(found)
        distinct.update(found)
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = len(text.translate(None, CONTINUED))
    return words < MIN_WORDS, 100 * len(distinct) < LEAST_DISTINCT * words, 100 * capitals > MOST_CAPITALS * points, SYMBOLS.search(text) is not None


def _flag_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_batches(batches):
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        flags = list(zip(*map(text_flags, texts), strict=True)) or [[]] * 4
        columns = [batch.column("doc_id"), batch.column("part"), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())]
        yield pa.RecordBatch.from_arrays([*columns, *[pa.array(f, pa.bool_()) for f in flags]], schema=FLAGS)


def flagged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, A..E boolean, n long): documents counted by id, part and failures.

    E compares whole texts by their sha256.  The smallest doc_id of each text comes from an aggregation that is
    partial before the shuffle, and meets the rows under (text, doc_id), so that a group of copies of any size is
    dealt over all tasks.
    """
    small_batches(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    rows = plain.mapInArrow(_flag_batches, "doc_id long, part string, name binary, A boolean, B boolean, C boolean, D boolean")
    rows = written(rows.groupBy("doc_id", "part", "name", *"ABCD").agg(F.count("*").alias("n")), "flags")
    first = rows.groupBy("name").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    least = first.select(F.col("name").alias("l_name"), F.col("doc_id").alias("l_id"), "first")
    same = (F.col("name") == F.col("l_name")) & F.col("doc_id").eqNullSafe(F.col("l_id"))
    return rows.join(least, same, "left").select("doc_id", "part", *"ABCD", F.col("first").isNull().alias("E"), "n")


def judged(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A..E, n, good, toxic): documents counted by part, failures and labels; at most 32 rows a part.

    A document is good or toxic if any label row of its doc_id says so.  Rows without a doc_id have no label and are
    kept out of the join, where they would share a key.
    """
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("quality").eqNullSafe(1).cast("long")).alias("good"), F.max(F.col("toxic").eqNullSafe(1).cast("long")).alias("toxic")
    )
    known = rows.where("doc_id is not null").join(said, "doc_id", "left").drop("doc_id")
    unknown = rows.where("doc_id is null").drop("doc_id").withColumns({"good": F.lit(None).cast("long"), "toxic": F.lit(None).cast("long")})
    both = known.unionByName(unknown)
    count = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c)
    return both.groupBy("part", *FILTERS).agg(F.sum("n").alias("n"), count("good"), count("toxic"))


def survivors(cells: DataFrame) -> DataFrame:
    """(part, chosen int, n, good, toxic): documents of each part that pass all filters of a subset (a number of bits).

    Subsets that nobody survives have no row.
    """
    bits = sum(((1 - F.grouping(f)) * (1 << k) for k, f in enumerate(FILTERS)), F.lit(0))
    cube = cells.cube("part", *FILTERS).agg(*[F.sum(c).alias(c) for c in COUNTS], bits.cast("int").alias("chosen"), F.grouping("part").alias("all_parts"))
    passes = [F.coalesce(~F.col(f), F.lit(True)) for f in FILTERS]  # a flag rolled up is null
    kept = cube.where("all_parts = 0")
    for p in passes:
        kept = kept.where(p)
    return kept.select("part", "chosen", *COUNTS)


def steps() -> list[tuple[str, int, str, int, int]]:
    """(filter_order, step, filter, subset before, subset after) of all orders: 600 rows."""
    rows = []
    for order in permutations(FILTERS):
        chosen = 0
        for k, f in enumerate(order, 1):
            after = chosen | 1 << FILTERS.index(f)
            rows.append(("".join(order), k, f, chosen, after))
            chosen = after
    return rows


def marginals() -> list[tuple[str, int, int, int]]:
    """(filter, subset without it, subset with it, number of orders that pass from one to the other): 80 rows."""
    rows = []
    for k, f in enumerate(FILTERS):
        others = [i for i in range(len(FILTERS)) if i != k]
        for size in range(len(FILTERS)):
            for group in combinations(others, size):
                before = sum(1 << i for i in group)
                rows.append((f, before, before | 1 << k, factorial(size) * factorial(len(FILTERS) - 1 - size)))
    return rows


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of each part.

    ``docs``: (doc_id, text, lang), other columns are ignored.  A null or empty text has no words: it fails A alone,
    and E if a smaller doc_id has an empty text too; a null lang is the empty part.  Texts are taken whole, their
    words a piece at a time.  Repeated rows of one doc_id count each; those of the smallest doc_id pass E.  A row without a doc_id
    stands after all others in E and has no label.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    alive = written(survivors(judged(flagged(docs), labels)), "survivors")
    parts = alive.where("chosen = 0").select("part", F.col("n").alias("whole"))

    def of(df: DataFrame, chosen: str, prefix: str) -> DataFrame:
        side = alive.select("part", F.col("chosen").alias(chosen), *[F.col(c).alias(f"{prefix}_{c}") for c in COUNTS])
        return df.join(side, ["part", chosen], "left").fillna(0, [f"{prefix}_{c}" for c in COUNTS])

    def with_pairs(pairs: DataFrame) -> DataFrame:
        # parts meet the fixed list of steps, 600 or 80 rows, which is sent to them
        pairs = parts.withColumn("_one", F.lit(1)).join(F.broadcast(pairs.withColumn("_one", F.lit(1))), "_one").drop("_one")
        return of(of(pairs, "before", "b"), "after", "a")

    every, whole = (1 << len(FILTERS)) - 1, F.col("before") == 0
    turns = with_pairs(spark.createDataFrame(marginals(), "filter string, before int, after int, orders int"))
    gone = F.col("b_n") - F.col("a_n")
    totals = turns.groupBy("part", "filter").agg(
        F.sum(gone * F.col("orders")).alias("shapley"),
        F.sum(F.when(whole, gone)).alias("fails"),
        F.sum(F.when(F.col("after") == every, gone)).alias("unique_fails"),
    )
    path = with_pairs(spark.createDataFrame(steps(), "filter_order string, step int, filter string, before int, after int"))
    lost = lambda c: (F.col(f"b_{c}") - F.col(f"a_{c}")).alias(f"{c}_lost")
    return path.join(totals, ["part", "filter"]).select(
        "part", "filter_order", "step", F.col("a_n").alias("kept"), gone.alias("removed"), (F.col("fails") - gone).alias("redundant"),
        "unique_fails", lost("good"), lost("toxic"), "shapley",
    )


#: The same rows from the definitions: each document is followed through every order.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT text, min(doc_id) AS least FROM t GROUP BY text),
said AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT t.part, coalesce(said.good, 0) AS good, coalesce(said.toxic, 0) AS toxic,
  CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 3 * length(t.text) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(t.text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN t.doc_id IS DISTINCT FROM m.least THEN 'E' ELSE '' END AS fails
  FROM t JOIN m ON t.text = m.text LEFT JOIN said ON t.doc_id = said.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a JOIN l b ON b.x <> a.x JOIN l c ON c.x NOT IN (a.x, b.x) JOIN l d ON d.x NOT IN (a.x, b.x, c.x)
  JOIN l e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, CAST(step AS INTEGER), 1) AS x, substr(filter_order, 1, CAST(step - 1 AS INTEGER)) AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
g AS (SELECT part, filter_order, step, x, contains(fails, x) AS hit, length(translate(fails, earlier, '')) < length(fails) AS gone, fails = x AS alone, n, good, toxic FROM c, s),
r AS (SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (WHERE NOT hit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (WHERE hit AND NOT gone), 0) AS removed,
  coalesce(sum(n) FILTER (WHERE hit AND gone), 0) AS redundant, coalesce(sum(n) FILTER (WHERE alone), 0) AS unique_fails,
  coalesce(sum(good) FILTER (WHERE hit AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE hit AND NOT gone), 0) AS toxic_lost FROM g GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r
"""
