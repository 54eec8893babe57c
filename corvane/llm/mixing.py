"""Mixing sources to target weights by entropy balancing.

*Targets.*  Sources in code-point order (null last) get the weights 5, 2, 1, repeating, and share
``share`` times the words of all documents; a target stops at ``cap`` times its source's size and
the excess is shared again by weight.  That is water-filling: targets are min(cap * size, level *
weight), and the level follows from running sums over sources sorted by cap * size / weight.

*Rates.*  Among all rates r in (0, cap) whose expected words meet the target, the ones of least
relative entropy to even rates are r = cap / (1 + exp(-tilt * size / scale)), exponentially tilted by a document's
words; the tilt of each source is the root of a convex dual's gradient.  ``steps`` Newton
steps, each one aggregation over (source, size) counts, solve all sources at once, kept inside
a shrinking bracket.  Sources whose target is cap times their size have the rate cap.

*Copies.*  A document is taken floor(r) or floor(r) + 1 times: once more if its place, which grows
with hash / (r - floor(r)), is below its source's bar.  The bar is found from histograms of the places,
level by level, so that a source's words miss its target by half a document at most rather
than by chance.

DataFrame functions only; what is collected is nothing, what is broadcast nothing.

Edge cases: a null text has size 0 and takes 0 words; a null source is a source of its own, the
last; a source without words has the target 0; repeated rows are documents of their
own (copies that share doc_id and text share the hash, hence the copies taken); an empty table gives an empty
result; other columns pass unless they begin with ``_m_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import WORD, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
STEPS = 11
#: Bits of a document's place in its source, and bits that one level of the histogram resolves.
PLACE_BITS, LEVEL_BITS = 36, 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, size); one row per source, also for null."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(w) for w in weights])
    per = per.withColumn("w", F.element_at(cycle, (place % len(weights)) + 1)).withColumn("top", cap * F.col("source_size"))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = Window.orderBy(F.col("top") / F.col("w"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    onward = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    # the sources from the first one that the level doesn't fill share that level
    per = per.withColumn("level", level).withColumn("open", F.col("top") / F.col("w") >= F.col("level"))
    final = F.min(F.when(F.col("open"), F.struct((F.col("top") / F.col("w")).alias("x"), F.col("level").alias("y")))).over(everything)
    target = F.coalesce(F.least(F.col("top"), F.col("w") * final["y"]), F.col("top"))
    return per.select("source", "source_size", target.cast("double").alias("target"))


def rate(tilt: Column, x: Column, cap: float) -> Column:
    return cap / (1 + F.exp(-F.least(F.lit(600.0), F.greatest(F.lit(-600.0), tilt * x))))


def tilts(grouped: DataFrame, goals: DataFrame, cap: float = CAP, steps: int = STEPS) -> DataFrame:
    """(source, tilt, scale): Newton's method on every source's dual, from (source, size, n).

    The rate of a document of x words is cap / (1 + exp(-tilt * x / scale)).  A step that leaves the
    bracket of the root is replaced by the bracket's middle.
    """
    same = F.col("g.source").eqNullSafe(F.col("s.source"))
    words = F.col("g.size") * F.col("g.n")
    state = grouped.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"))
    state = state.alias("g").join(goals.alias("s"), same).select("s.source", "scale", "target", "source_size")
    odds = F.coalesce(F.try_divide("target", cap * F.col("source_size") - F.col("target")), F.lit(1.0))
    start = F.least(F.lit(30.0), F.greatest(F.lit(-30.0), F.log(F.greatest(odds, F.lit(1e-12)))))
    state = written(state.select("*", start.alias("tilt"), F.lit(-700.0).alias("low"), F.lit(700.0).alias("high")), "tilt")
    for _ in range(steps):
        x = F.col("g.size") / F.greatest(F.col("s.scale"), F.lit(1e-9))
        r = rate(F.col("s.tilt"), x, cap)
        # the tilt and its bracket are the same on all rows of a source
        sums = (
            grouped.alias("g")
            .join(state.alias("s"), same)
            .groupBy(*[F.col(f"s.{c}") for c in ("source", "scale", "target", "source_size", "tilt", "low", "high")])
            .agg(F.sum(words * r).alias("got"), F.sum(words * x * r * (1 - r / cap)).alias("slope"))
        )
        low = F.when(F.col("got") < F.col("target"), F.col("tilt")).otherwise(F.col("low"))
        high = F.when(F.col("got") < F.col("target"), F.col("high")).otherwise(F.col("tilt"))
        # on the logarithm of what is taken, or of what is left out, the gradient is nearly straight
        out, goal = cap * F.col("source_size") - F.col("got"), cap * F.col("source_size") - F.col("target")
        by_out = F.log(F.try_divide(out, goal)) * F.try_divide(out, F.col("slope"))
        by_got = F.log(F.try_divide(F.col("target"), F.col("got"))) * F.try_divide(F.col("got"), F.col("slope"))
        step = F.col("tilt") + F.when(F.col("target") > goal, by_out).otherwise(by_got)
        inside = (step > F.col("low")) & (step < F.col("high"))
        moved = sums.withColumn("low", low).withColumn("high", high)
        moved = moved.withColumn("tilt", F.when(inside, step).otherwise((F.col("low") + F.col("high")) / 2))
        state = written(moved.select("source", "scale", "target", "source_size", "tilt", "low", "high"), "tilt")
    return state.select("source", "tilt", "scale")


def bars(rows: DataFrame, bits: int = PLACE_BITS, level_bits: int = LEVEL_BITS) -> DataFrame:
    """(source, bar) from (source, place, size, need): extra copies go to places below the bar.

    ``need``: the words that the extra copies of a source shall bring.  Each level sums the words of
    2^level_bits cells per source, which the next level divides.
    """
    state = None
    for shift in range(bits - level_bits, -1, -level_bits):
        cell = F.shiftright("place", shift)
        part = rows if state is None else rows.join(
            state.select(F.col("source").alias("_m_s"), F.col("cell").alias("_m_c"), F.col("left").alias("_m_left")),
            F.col("source").eqNullSafe(F.col("_m_s")) & (F.shiftright("place", shift + level_bits) == F.col("_m_c")),
        )
        left = F.max("need") if state is None else F.max("_m_left")
        cells = part.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("words"), left.alias("need"))
        run = Window.partitionBy("source").orderBy("cell")
        cells = cells.withColumn("upto", F.sum("words").over(run)).withColumn("last", F.max("cell").over(Window.partitionBy("source")))
        hit = cells.where("upto >= need or cell = last").withColumn("left", F.col("need") - (F.col("upto") - F.col("words")))
        state = written(hit.groupBy("source").agg(F.min(F.struct("cell", "left", "words")).alias("x")).select("source", "x.*"), "bar")
    nearer = F.abs(F.col("words") - F.col("left")) < F.abs(F.col("left"))
    return state.select("source", (F.col("cell") + nearer.cast("long")).alias("bar"))


def mix_sources(
    docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, steps: int = STEPS
) -> DataFrame:
    """(doc_id, _m_text, source, size, source_size, target, copies, taken), one row per row of ``docs``.

    ``_m_text`` is the hash of the text, which tells rows of one doc_id apart.
    """
    sizes = written(
        docs.select("doc_id", F.xxhash64("text").alias("_m_text"), "source", word_count(F.col("text")).alias("size")), "sizes"
    )
    goals = written(targets(sizes, weights, share, cap), "targets")
    grouped = written(sizes.groupBy("source", "size").agg(F.count("*").alias("n")), "grouped")
    params = goals.alias("t").join(tilts(grouped, goals, cap, steps).alias("s"), F.col("t.source").eqNullSafe(F.col("s.source")))
    params = written(params.select("t.*", "tilt", "scale"), "params")
    p = params.select(F.col("source").alias("_m_source"), "source_size", "target", "tilt", "scale")
    full = F.col("target") >= cap * F.col("source_size")
    x = F.col("size") / F.greatest(F.col("scale"), F.lit(1e-9))
    r = F.when(full, F.lit(cap)).otherwise(rate(F.col("tilt"), x, cap))
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "doc_id", "_m_text"), 11) + 1) / F.lit(float(1 << 53))
    rows = sizes.join(p, F.col("source").eqNullSafe(F.col("_m_source"))).withColumn("_m_rate", r)
    rows = rows.withColumn("_m_base", F.floor("_m_rate")).withColumn("_m_part", F.col("_m_rate") - F.col("_m_base"))
    odds = F.try_divide(unit, F.col("_m_part"))
    top = (1 << PLACE_BITS) - 1
    place = F.coalesce(F.floor(odds / (1 + odds) * top), F.lit(top)).cast("long")
    rows = written(rows.withColumn("place", place), "rates")
    still = rows.groupBy("source").agg((F.max("target") - F.sum(F.col("size") * F.col("_m_base"))).alias("need"))
    open_rows = rows.where(F.col("_m_base") < cap).select("source", "place", "size")
    still = written(still, "need").select(F.col("source").alias("_m_n"), "need")
    bar = bars(open_rows.join(still, F.col("source").eqNullSafe(F.col("_m_n"))).drop("_m_n"))
    bar = written(bar, "bar").select(F.col("source").alias("_m_b"), "bar")
    extra = (F.col("_m_base") < cap) & (F.col("place") < F.coalesce(F.col("bar"), F.lit(0)))
    copies = (F.col("_m_base") + extra.cast("long")).cast("long")
    out = rows.join(bar, F.col("source").eqNullSafe(F.col("_m_b")), "left").withColumn("copies", copies)
    return out.select("doc_id", "_m_text", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
