"""Joins that check how many rows meet, within their own shuffle.

A side that must have one row a key is aggregated by the key, which deals it as the join needs it, and rows are counted
there; a key that breaks the rule fails the job with its values.  Checks are filters, so that no optimiser drops them with
a column that nobody reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shown(keys: list[str]) -> Column:
    return F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in keys])


def required(df: DataFrame, condition: Column, message: Column) -> DataFrame:
    """``df``; a row that fails the condition, or leaves it null, fails the job with the message."""
    return df.where(F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def unique(df: DataFrame, keys: list[str], name: str, counted: str | None = None) -> DataFrame:
    """``df`` dealt by its keys, one row each; a repeated key, or a null in one, fails the job.  ``counted`` names a column for the number of rows, 1."""
    rest = [c for c in df.columns if c not in keys]
    # a value each, so that columns that nobody reads are not dealt
    one = df.groupBy(*keys).agg(F.count("*").alias("_u_n"), *[F.first(c).alias(c) for c in rest])
    present = F.lit(True)
    for k in keys:
        present = present & F.col(k).isNotNull()
    one = required(one, (F.col("_u_n") == 1) & present, F.concat(F.lit(f"{name}: not one row for "), shown(keys)))
    more = [F.col("_u_n").alias(counted)] if counted else []
    return one.select(*df.columns, *more)


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], kind: str = "m:1", *, every_left: bool = False, every_right: bool = False, name: str = "join") -> DataFrame:
    """``left`` with the columns of ``right``: rows of ``left`` without a partner have nulls.

    ``kind``: "m:1" for one row a key at most in ``right``, "1:1" in both.  ``every_left``, ``every_right``: each row must have a
    partner.  Whatever breaks a rule fails the job with the key.  A null key meets nothing: in ``left`` of m:1 it is kept
    without a partner, in ``right`` it is left out unless ``every_right`` asks for it.  Columns other than the keys must differ in name.
    """
    if kind not in ("m:1", "1:1"):
        raise ValueError(f"unknown kind {kind}")
    if clash := sorted(set(left.columns) & set(right.columns) - set(keys)):
        raise ValueError(f"{name}: both sides have {clash}")
    if missing := [k for k in keys if k not in left.columns or k not in right.columns]:
        raise ValueError(f"{name}: a side lacks {missing}")
    a = (unique(left, keys, f"{name}, left") if kind == "1:1" else left).withColumn("_j_left", F.lit(True))
    b = unique(right, keys, f"{name}, right", "_j_right")
    # reading the count keeps the join, and so its checks, where no other column of the right is read
    both = a.join(b, keys, "full" if every_right else "left").where(F.coalesce(F.col("_j_right") == 1, F.lit(True)))
    if every_left:
        both = required(both, F.col("_j_right").isNotNull(), F.concat(F.lit(f"{name}: no partner right for "), shown(keys)))
    if every_right:
        both = required(both, F.col("_j_left").isNotNull(), F.concat(F.lit(f"{name}: no partner left for "), shown(keys)))
    order = [*left.columns, *[c for c in right.columns if c not in keys]]
    return both.select(*order)
