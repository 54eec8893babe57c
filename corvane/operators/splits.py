"""Splits by question, folds by cue, balance, fingerprints: all from hashes, none from row order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.stats import unit_hash
from corvane.operators import joins


def question_splits(df: DataFrame, seed: int, fractions: tuple[float, float] = (0.70, 0.15), strata: tuple[str, ...] = ("subject_model",)) -> DataFrame:
    """(question_id, signature, split): train, val, test within each signature (the cells of ``strata`` that a question's rows are in).

    Questions of a signature are ranked by hash; the rank, moved by an offset that is the signature's own hash, is cut.
    A signature's questions may be many, so ranks come from counts of hash cells plus places within a cell.
    """
    if min(fractions) < 0 or sum(fractions) > 1:
        raise ValueError(f"fractions {fractions} are no shares of train and val")
    q = df.groupBy("question_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", *strata))), "|").alias("signature"))
    q = q.withColumn("h", unit_hash(F.lit(str(seed)), F.col("question_id")))
    q = q.withColumn("cell", F.floor(F.col("h") * 1024).cast("int"))
    cells = q.groupBy("signature", "cell").agg(F.count("*").alias("c"))
    upto = Window.partitionBy("signature").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("c").over(upto), F.lit(0))).withColumn("n", F.sum("c").over(Window.partitionBy("signature")))
    place = F.row_number().over(Window.partitionBy("signature", "cell").orderBy("h", "question_id"))
    q = q.withColumn("place", place).join(cells.drop("c"), ["signature", "cell"])
    x = (F.col("before") + F.col("place") - 1 + unit_hash(F.lit(str(seed)), F.lit("offset"), F.col("signature"))) / F.col("n")
    split = F.when(x < fractions[0], "train").when(x < sum(fractions), "val").otherwise("test")
    return q.select("question_id", "signature", split.alias("split"))


def one_split(rows: DataFrame) -> DataFrame:
    """(question_id, split) of the rows that have one; a question in two splits fails the job."""
    q = rows.where("split is not null").groupBy("question_id").agg(F.min("split").alias("split"), F.max("split").alias("_last"))
    return joins.required(q, F.col("split") == F.col("_last"), F.concat(F.lit("question in several splits: "), F.coalesce(F.col("question_id").cast("string"), F.lit("null")))).drop("_last")


def assign_splits(rows: DataFrame, seed: int, *, fractions: tuple[float, float] = (0.70, 0.15), strata: tuple[str, ...] = ("hint_style", "case"), force: bool = False, extend: bool = False) -> DataFrame:
    """``rows`` with split filled in by question.

    Rows that have a split already are an error, unless ``force`` draws all questions anew or ``extend`` keeps every question that has
    one and draws the others, ranked and stratified among themselves.  So no old question ever moves, and a question's
    new rows follow its old ones.
    """
    has = "split" in rows.columns
    if has and not force and not extend and not rows.where("split is not null").isEmpty():
        raise ValueError("rows have a split already; force draws all anew, extend only what has none")
    if not has or not extend:
        drawn = question_splits(rows, seed, fractions, strata).drop("signature")
        return rows.drop("split").join(drawn, "question_id", "left")
    taken = one_split(rows)
    todo = rows.join(taken, "question_id", "left_anti")
    both = taken.unionByName(question_splits(todo, seed, fractions, strata).drop("signature"))
    return rows.drop("split").join(both, "question_id", "left").select(*rows.columns)


def carry_over(new: DataFrame, previous: DataFrame) -> DataFrame:
    """``new`` with the splits that ``previous`` gave its questions; others stay null.  A ``previous`` without a split column changes nothing."""
    if "split" not in previous.columns:
        return new
    return new.drop("split").join(one_split(previous), "question_id", "left")


def carry_report(carried: DataFrame) -> DataFrame:
    """One row: rows and questions that carried a split over, and rows without one."""
    has = F.col("split").isNotNull()
    return carried.agg(F.count_if(has).alias("n_carried"), F.count_distinct(F.when(has, F.col("question_id"))).alias("n_questions_carried"), F.count_if(~has).alias("n_unassigned"))


def split_report(rows: DataFrame) -> DataFrame:
    """Rollouts, questions and labels per split, and in all (null split)."""
    return rows.rollup("split").agg(F.count("*").alias("n_rollouts"), F.countDistinct("question_id").alias("n_questions"), F.count_if(F.col("judge_label") == 0).alias("n_label0"))


def propagate(target: DataFrame, source: DataFrame) -> DataFrame:
    """Splits by question for rows of another table; a question without a split is an error."""
    out = target.join(source.select("question_id", "split"), "question_id", "left")
    return out.withColumn("split", F.coalesce("split", F.raise_error(F.concat(F.lit("no split for "), F.col("question_id"))).cast("string")))


def fold_roles(rows: DataFrame, cues: list[str]) -> DataFrame:
    """One copy of the rows per held-out cue with their role; rows without one are left out."""
    held = F.explode(F.array(*map(F.lit, cues)))
    out = rows.withColumn("held_out", held)
    inner = F.col("hint_style") != F.col("held_out")
    role = F.when(inner, F.when(F.col("split") == "test", "test_id").otherwise(F.col("split"))).when(F.col("split") == "test", "test_ood")
    return out.withColumn("fold_role", role).where("fold_role is not null")


def question_overlap(folds: DataFrame) -> DataFrame:
    """Per fold: questions in training and in a test set, which must be 0, and questions in the outer test only."""
    q = folds.groupBy("held_out", "question_id").agg(*[F.max((F.col("fold_role").isin(*r)).cast("int")).alias(n) for n, r in (("fit", ("train", "val")), ("id", ("test_id",)), ("ood", ("test_ood",)))])
    return q.groupBy("held_out").agg(F.count_if((F.col("fit") == 1) & ((F.col("id") == 1) | (F.col("ood") == 1))).alias("n_leaked"), F.count_if((F.col("ood") == 1) & (F.col("id") == 0)).alias("n_ood_only"))


def balance(rows: DataFrame, label: str, cell: list[str], ratio: float, seed: int) -> DataFrame:
    """Rows kept when the majority of each cell is cut to floor(ratio * minority); one-class cells stay whole."""
    counts = rows.groupBy(*cell).agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"))
    low, high = F.least("n0", "n1"), F.greatest("n0", "n1")
    take = F.when(low == 0, high).otherwise(F.least(high, F.floor(ratio * low + 1e-9)))
    counts = counts.withColumn("take", take).withColumn("major", F.when(F.col("n0") >= F.col("n1"), 0).otherwise(1))
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), *cell, "rollout_id"), 256)
    out = rows.withColumn("place", F.row_number().over(Window.partitionBy(*cell, label).orderBy(order, "rollout_id"))).join(counts, cell)
    return out.where((F.col(label) != F.col("major")) | (F.col("place") <= F.col("take")))


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One hash of a table's lines whatever their order: hashes of 65,536 hash-prefix groups, then of those.

    A group's lines are themselves first hashed, and groups are as many as it takes to keep each small.
    """
    line = F.sha2(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    groups = rows.select(line.alias("x")).groupBy(F.substring("x", 1, 4).alias("g")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("x")), ""), 256).alias("h"), F.count("*").alias("n"))
    return groups.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("g", "h"))), ""), 256).alias("fingerprint"), F.sum("n").alias("n_rows"))
