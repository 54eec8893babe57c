"""Closed-form statistics as columns, and rank statistics as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.96


def rate(num: Column, den: Column) -> Column:
    """num / den, null where den is 0."""
    return F.try_divide(num.cast("double"), den)


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """The bounds of the Wilson interval, within [0, 1]; null where n is 0."""
    p, zz = rate(k, n), z * z
    centre = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    some = n > 0
    return F.when(some, F.greatest(F.lit(0.0), centre - half)), F.when(some, F.least(F.lit(1.0), centre + half))


def kappa(yes_yes: Column, yes_no: Column, no_yes: Column, no_no: Column) -> Column:
    """Cohen's kappa of a (weighted) 2 x 2 table; 1 where chance agreement is total, null where it is empty."""
    n = (yes_yes + yes_no + no_yes + no_no).cast("double")
    po = (yes_yes + no_no) / n
    pe = ((yes_yes + yes_no) * (yes_yes + no_yes) + (no_yes + no_no) * (yes_no + no_no)) / (n * n)
    return F.when(n > 0, F.when(pe >= 1, F.lit(1.0)).otherwise((po - pe) / (1 - pe)))


def unit_hash(*parts: Column, sep: str = ":") -> Column:
    """A number in [0, 1) from the first 8 bytes of sha256 of the joined parts."""
    digits = F.substring(F.sha2(F.concat_ws(sep, *parts), 256), 1, 16)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 64)


def average_rank(df: DataFrame, value: str, keys: list[str] = [], name: str = "rank", ascending: bool = True) -> DataFrame:  # noqa: B006
    """``df`` with the rank of ``value`` among its group, ties sharing the mean of their places."""
    order = F.col(value).asc() if ascending else F.col(value).desc()
    group = [F.col(k) for k in keys]
    tied = F.count(F.lit(1)).over(Window.partitionBy(*group, value))
    return df.withColumn(name, F.rank().over(Window.partitionBy(*group).orderBy(order)) + (tied - 1) / F.lit(2.0))


def value_ranks(df: DataFrame, value: str, keys: list[str], extra: list[Column] = []) -> DataFrame:  # noqa: B006
    """One row per group and distinct value: n, the extra aggregates, rows below, and the shared average rank.

    Rows are aggregated before the window sees them, so a group's window holds its distinct values only.
    """
    cells = df.groupBy(*keys, value).agg(F.count("*").alias("n"), *extra)
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cells.withColumn("below", before).withColumn("avg_rank", F.col("below") + (F.col("n") + 1) / F.lit(2.0))


def benjamini_hochberg(df: DataFrame, p: str, keys: list[str] = [], name: str = "q") -> DataFrame:  # noqa: B006
    """``df`` with adjusted p-values per group; null p-values stay null and don't count."""
    group = [F.col(k) for k in keys] + [F.col(p).isNull()]
    m = F.count(p).over(Window.partitionBy(*group))
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.col(p)))
    df = df.withColumn("_raw", F.col(p) * m / place).withColumn("_place", place)
    upward = Window.partitionBy(*group).orderBy("_place").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return df.withColumn(name, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("_raw").over(upward)))).drop("_raw", "_place")


def auroc(df: DataFrame, label: str, score: str, keys: list[str]) -> DataFrame:
    """(keys, n_pos, n_neg, auroc): rank form, ties count half, null with one class only."""
    cells = value_ranks(df, score, keys, [F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos")])
    g = cells.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), (F.sum("n") - F.sum("pos")).alias("n_neg"), F.sum(F.col("avg_rank") * F.col("pos")).alias("ranks"))
    area = F.try_divide(F.col("ranks") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0, (F.col("n_pos") * F.col("n_neg")).cast("double"))
    return g.select(*keys, "n_pos", "n_neg", area.alias("auroc"))


def recall_at_fpr(df: DataFrame, label: str, score: str, fpr: float, keys: list[str]) -> DataFrame:
    """(keys, threshold, recall): the floor(fpr * negatives)-th highest negative score, and positives strictly above it."""
    # counted by score first, so that a group's window holds its distinct scores only
    cells = df.where(F.col(label) == 0).groupBy(*keys, score).agg(F.count("*").alias("_n"))
    higher = Window.partitionBy(*keys).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, -1)
    at = F.floor(F.sum("_n").over(Window.partitionBy(*keys)) * fpr)
    placed = cells.withColumn("_above", F.coalesce(F.sum("_n").over(higher), F.lit(0))).withColumn("_at", at)
    bar = placed.where("_above <= _at and _at < _above + _n").select(*keys, F.col(score).alias("threshold"))
    positives = df.where(F.col(label) == 1).join(bar, keys)
    return positives.groupBy(*keys, "threshold").agg(F.avg((F.col(score) > F.col("threshold")).cast("double")).alias("recall"))


def calibration_error(df: DataFrame, label: str, score: str, keys: list[str], bins: int = 10) -> DataFrame:
    """(keys, ece): bins are closed on the right, the first on the left too."""
    bin_no = F.greatest(F.lit(1), F.ceil(F.col(score) * bins))
    cells = df.groupBy(*keys, bin_no.alias("_bin")).agg(F.count("*").alias("n"), F.avg(score).alias("s"), F.avg(F.col(label).cast("double")).alias("y"))
    return cells.groupBy(*keys).agg((F.sum(F.abs(F.col("s") - F.col("y")) * F.col("n")) / F.sum("n")).alias("ece"))


def ks_two_sample(df: DataFrame, flag: str, value: str, keys: list[str]) -> DataFrame:
    """(keys, n_a, n_b, d, p): rows where ``flag`` is true against the others, asymptotic p of 100 terms; null if either side is empty."""
    cells = df.groupBy(*keys, value).agg(F.count_if(F.col(flag)).alias("a"), F.count_if(~F.col(flag)).alias("b"))
    upto, whole = Window.partitionBy(*keys).orderBy(value), Window.partitionBy(*keys)
    gap = F.abs(rate(F.sum("a").over(upto), F.sum("a").over(whole)) - rate(F.sum("b").over(upto), F.sum("b").over(whole)))
    g = cells.withColumn("_gap", gap).groupBy(*keys).agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.max("_gap").alias("d"))
    en = F.sqrt(F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b")).cast("double"))
    lam = (en + 0.12 + F.try_divide(F.lit(0.11), en)) * F.col("d")
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam))
    return g.withColumn("p", F.when(F.col("d") <= 0, F.lit(1.0)).when(F.col("d").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), terms))))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, rho) of a small table of cells; null below three points."""
    ranked = average_rank(average_rank(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, name="_rx"), y, name="_ry")
    return ranked.agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.corr("_rx", "_ry")).alias("rho"))


def kendall_tau_b(df: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """(n_pairs, tau_b) of a small table of cells, from all pairs of its rows."""
    a, b = df.alias("a"), df.alias("b")
    dx, dy = F.signum(F.col(f"a.{x}") - F.col(f"b.{x}")), F.signum(F.col(f"a.{y}") - F.col(f"b.{y}"))
    pairs = a.join(b, F.col(f"a.{key}") < F.col(f"b.{key}")).select(dx.alias("dx"), dy.alias("dy"))
    root = F.sqrt(F.sum(F.abs("dx")) * F.sum(F.abs("dy")))
    return pairs.agg(F.count("*").alias("n_pairs"), F.try_divide(F.sum(F.col("dx") * F.col("dy")), root).alias("tau_b"))
