"""Named row selections: a registry from name to a condition, its columns and its label."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Predicate:
    name: str
    condition: Callable[[], Column]
    requires: tuple[str, ...]
    label: str | None
    classes: tuple = ()


REGISTRY: dict[str, Predicate] = {}


def register(name: str, requires: tuple[str, ...], label: str | None, condition: Callable[[], Column], classes: tuple = ()) -> None:
    if name in REGISTRY:
        raise ValueError(f"{name} is registered already")
    REGISTRY[name] = Predicate(name, condition, requires, label, classes)


def _rerolled() -> Column:
    return F.col("is_resample")


def _clean() -> Column:
    return F.col("exclude_reason").isNull()


_CONTRAST = ("is_resample", "contrast_a", "contrast_a_set", "exclude_reason")
_JUDGED = ("is_resample", "to_hint", "judge_label", "exclude_reason")
register("dataset_A", _CONTRAST, "contrast_a", lambda: _rerolled() & (F.col("contrast_a_set") == "train") & _clean(), ("used", "ignored"))
register("dataset_A_challenge", _CONTRAST, "contrast_a", lambda: _rerolled() & (F.col("contrast_a_set") == "challenge") & _clean(), ("used", "ignored"))
register("dataset_B", (*_JUDGED, "reliance_label"), "judge_label", lambda: _rerolled() & (F.col("reliance_label") == "robust_used") & F.col("to_hint") & F.col("judge_label").isin(0, 1) & _clean(), (0, 1))
register("dataset_C", _JUDGED, "judge_label", lambda: ~_rerolled() & F.col("to_hint") & F.col("judge_label").isin(0, 1) & _clean(), (0, 1))
register("dataset_C_incoherent", _JUDGED, None, lambda: ~_rerolled() & F.col("to_hint") & (F.col("judge_label") == -1) & (F.col("exclude_reason") == "incoherent"))
register("verbalised_vs_unverbalised", (*_JUDGED, "reliance_label"), "judge_label", REGISTRY["dataset_B"].condition, (0, 1))
register("verbalised_vs_rest", ("is_resample", "label_verbalised_rest", "exclude_reason"), "label_verbalised_rest", lambda: _rerolled() & F.col("label_verbalised_rest").isNotNull() & _clean(), ("rest", "verbalised"))
register("used_vs_ignored", ("is_resample", "label_used_ignored", "exclude_reason"), "label_used_ignored", lambda: _rerolled() & F.col("label_used_ignored").isNotNull() & _clean(), ("used", "ignored"))
for _base in ("dataset_A", "dataset_B", "dataset_C"):
    _p = REGISTRY[_base]
    register(f"{_base}_positive_only", (*_p.requires, "case"), _p.label, lambda p=_p: p.condition() & (F.col("case") == "positive"), _p.classes)


def select_rows(name: str, df: DataFrame) -> DataFrame:
    """The rows that a predicate selects; a missing column is an error."""
    p = REGISTRY[name]
    if missing := [c for c in p.requires if c not in df.columns]:
        raise ValueError(f"{name} needs the columns {missing}")
    return df.where(F.coalesce(p.condition(), F.lit(False)))


def encoded_labels(name: str, df: DataFrame) -> DataFrame:
    """(rollout_id, label): 0 and 1 in the order of the predicate's classes; another label is an error."""
    p = REGISTRY[name]
    label = F.when(F.col(p.label) == p.classes[0], 0).when(F.col(p.label) == p.classes[1], 1)
    return select_rows(name, df).select("rollout_id", F.coalesce(label, F.raise_error(F.lit(f"{name}: unknown label")).cast("int")).alias("label"))
