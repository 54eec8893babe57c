"""Auditing a judge: strata, quotas, draws with design weights, agreement, sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.stats import kappa, rate
from corvane.operators import bootstrap


def stratum(low: float = 0.7) -> Column:
    """Label by confidence; a missing confidence counts as high."""
    part = F.when(F.coalesce(F.col("judge_confidence") <= low, F.lit(False)), "low").otherwise("high")
    return F.concat(F.when(F.col("judge_label") == 0, "unfaithful_").otherwise("faithful_"), part)


def allocate_quota(available: dict[str, int], target: int, weights: dict[str, float] | None = None, minimum: int = 0) -> dict[str, int]:
    """Shares ``target`` among cells by weight (1 if not given) times what they have, none above that: fill, floor, largest remainders.

    Each cell that has rows gets ``minimum`` at least, and 1 at least, as far as ``target`` allows it for all.
    """
    available = {c: int(n) for c, n in available.items() if n > 0}
    weights = {c: (weights or {}).get(c, 1.0) * n for c, n in available.items()}
    floors = [{c: min(n, m) for c, n in available.items()} for m in (max(minimum, 1), 1, 0)]
    share = {c: float(n) for c, n in next(f for f in floors if sum(f.values()) <= max(target, 0)).items()}
    open_cells = {c for c in available if share[c] < available[c] and weights[c] > 0}
    left = min(max(target, 0), sum(available.values())) - sum(share.values())
    while left > 1e-9 and open_cells:
        total = sum(weights[c] for c in open_cells)
        step = {c: left * weights[c] / total for c in open_cells}
        full = {c for c in open_cells if share[c] + step[c] >= available[c]}
        for c in full or open_cells:
            add = available[c] - share[c] if full else step[c]
            share[c] += add
            left -= add
        open_cells -= full
        if not full:
            break
    out = {c: int(x + 1e-9) for c, x in share.items()}
    rest = round(sum(share.values())) - sum(out.values())
    for c in sorted(share, key=lambda c: (-(share[c] - out[c]), c))[:rest]:
        out[c] += 1
    return {c: n for c, n in out.items() if n > 0}


def draw(frame: DataFrame, cell: list[str], per_cell: int, seed: int) -> DataFrame:
    """A nested draw of ``per_cell`` rows of each cell, each with the weight available / taken."""
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), *cell, "rollout_id"), 256)
    sizes = frame.groupBy(*cell).agg(F.count("*").alias("available"))
    rows = frame.withColumn("place", F.row_number().over(Window.partitionBy(*cell).orderBy(order, "rollout_id"))).where(F.col("place") <= per_cell)
    rows = rows.join(sizes, cell)
    return rows.withColumn("design_weight", F.col("available") / F.least(F.col("available"), F.lit(per_cell)).cast("double"))


def agreement(sample: DataFrame, groups: list[str], a: str = "label_a", b: str = "label_b", weight: str | None = None) -> DataFrame:
    """Agreement and kappa of two judges per group, in one pass over rows that both labelled 0 or 1."""
    w = F.col(weight) if weight else F.lit(1)
    x, y = F.col(a), F.col(b)
    part = lambda i, j: F.sum(F.when((x == i) & (y == j), w).otherwise(w * 0))
    g = sample.where(x.isin(0, 1) & y.isin(0, 1)).groupBy(*groups).agg(F.count("*").alias("n"), part(1, 1).alias("n11"), part(1, 0).alias("n10"), part(0, 1).alias("n01"), part(0, 0).alias("n00"))
    cells = [F.col(c) for c in ("n11", "n10", "n01", "n00")]
    return g.withColumns({"agreement": (F.col("n11") + F.col("n00")) / sum(cells[1:], cells[0]).cast("double"), "kappa": kappa(*cells)})


def review_sheet(sample: DataFrame, n_agree: int, seed: int) -> DataFrame:
    """All disagreements and ``n_agree`` agreements, in a seeded order."""
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), "rollout_id"), 256)
    rows = sample.withColumn("kind", F.when(F.col("label_a") == F.col("label_b"), "agreement").otherwise("disagreement"))
    agreed = rows.where("kind = 'agreement'").orderBy(order, "rollout_id").limit(n_agree)
    return rows.where("kind = 'disagreement'").unionByName(agreed).withColumn("sheet_key", order)


def population_rates(frame: DataFrame, a: str, b: str) -> DataFrame:
    """Unfaithful rates by a, by b and overall, in one grouping-sets pass (null: all)."""
    g = frame.where("judge_label in (0, 1)").groupingSets([[F.col(a)], [F.col(b)], []], F.col(a), F.col(b))
    g = g.agg(F.count("*").alias("n"), F.count_if(F.col("judge_label") == 0).alias("n0"))
    return g.withColumn("rate", rate(F.col("n0"), F.col("n")))


def _audit_rows(sample: DataFrame, pair: list[str], cell: list[str]) -> tuple[DataFrame, DataFrame]:
    """(units, rows): the sample's rows numbered within their cells, with the arbiter's and the judge's weights."""
    named = sample.withColumn("stratum_", F.concat_ws("|", *pair, *cell))
    # a cell's sample has a stated number of rows, so that a window may number it
    named = named.withColumn("qno", (F.row_number().over(Window.partitionBy("stratum_").orderBy("rollout_id")) - 1).cast("long"))
    w, a, j = F.col("design_weight"), F.col("arbiter_label"), F.col("judge_label")
    columns = {"stratum": F.col("stratum_"), "num": F.when(a == 0, w).otherwise(0.0), "den": F.when(a.isin(0, 1), w).otherwise(0.0), "flash_num": F.when(j == 0, w).otherwise(0.0), "flash_den": F.when(j.isin(0, 1), w).otherwise(0.0)}
    rows = named.withColumns(columns)
    return rows.select("stratum", "qno"), rows


def audit_replicates(sample: DataFrame, pair: list[str], cell: list[str], style: str, *, reps: int, seed: int) -> DataFrame:
    """(pair, style, rep, value): the arbiter's weighted rate in samples redrawn within their cells, by style and 'overall'."""
    units, rows = _audit_rows(sample, pair, cell)
    rows = rows.withColumn("style", F.explode(F.array(F.col(style), F.lit("overall"))))
    sums = bootstrap.replicate_sums(units, bootstrap.with_groups(rows, [*pair, "style"]), ["num", "den"], reps=reps, seed=seed)
    return bootstrap.split_groups(sums.withColumn("value", bootstrap.ratio()), [*pair, "style"])


def audit_rates(sample: DataFrame, frame: DataFrame, pair: list[str], cell: list[str], style: str) -> DataFrame:
    """Of each pair and style, and 'overall': rates of the judge in the frame and reweighted, and of the arbiter.

    ``weights_check_ok``: the reweighted sample gives the frame's rate, and all of the frame's cells are sampled.
    """
    _, rows = _audit_rows(sample, pair, cell)
    by_style = F.explode(F.array(F.col(style), F.lit("overall"))).alias("style")
    a = F.col("arbiter_label")
    taken = rows.select("*", by_style).groupBy(*pair, "style").agg(
        F.count("*").alias("n_sample"),
        F.count_if(a.isin(0, 1)).alias("n_binary"),
        F.try_divide(F.sum("flash_num"), F.sum("flash_den")).alias("flash_reweighted_rate"),
        F.try_divide(F.sum("num"), F.sum("den")).alias("arbiter_reweighted_rate"),
        rate(F.count_if(a == 0), F.count_if(a.isin(0, 1))).alias("arbiter_raw_rate"),
    )
    # cells first: the frame may be large, its cells are few
    j = F.col("judge_label")
    cells = frame.groupBy(*pair, *cell).agg(F.count_if(j.isin(0, 1)).alias("n"), F.count_if(j == 0).alias("n0"))
    seen = sample.select(*pair, *cell).distinct().withColumn("seen", F.lit(True))
    cells = cells.join(seen, [*pair, *cell], "left")
    whole = cells.select("*", by_style).groupBy(*pair, "style").agg(
        F.sum("n").alias("n_frame"), rate(F.sum("n0"), F.sum("n")).alias("flash_population_rate"), F.sum(F.when(F.col("seen").isNull(), F.col("n")).otherwise(0)).alias("n_frame_rows_uncovered")
    )
    near = F.abs(F.col("flash_reweighted_rate") - F.col("flash_population_rate")) < 1e-9
    return whole.join(taken, [*pair, "style"]).withColumn("weights_check_ok", (F.col("n_frame_rows_uncovered") == 0) & F.coalesce(near, F.lit(False)))


def gap_audit(sample: DataFrame, frame: DataFrame, pair: list[str], cell: list[str], style: str, *, reps: int = 1000, seed: int = 7) -> DataFrame:
    """``audit_rates`` with percentile bounds of the arbiter's rate, from samples redrawn within their cells."""
    bounds = bootstrap.interval(audit_replicates(sample, pair, cell, style, reps=reps, seed=seed), [*pair, "style"])
    return audit_rates(sample, frame, pair, cell, style).join(bounds.select(*pair, "style", "ci_low", "ci_high"), [*pair, "style"])


def cross_model_gap(sample: DataFrame, frame: DataFrame, pair: list[str], cell: list[str], *, primary: str | None = None, reps: int = 1000, seed: int = 7) -> DataFrame:
    """One row: the gap and the ratio of the first pair's (or ``primary``'s) rates to the next one's, with bounds.

    The gap survives if its interval leaves out 0.  Fewer than two pairs give no row; an unknown ``primary`` is an error.
    """
    name = F.concat_ws("|", *pair).alias("name")
    rates = audit_rates(sample, frame, pair, cell, cell[-1]).where("style = 'overall'").select("*", name)
    names = sorted(r["name"] for r in rates.select("name").collect())  # models and runs are few
    if primary is not None and primary not in names:
        raise ValueError(f"{primary} is not in the sample: {names}")
    first = primary or (names[0] if names else "")
    second = next((n for n in names if n != first), None)
    values = ["name", "flash_population_rate", "arbiter_reweighted_rate"]
    a, b = (rates.where(F.col("name") == F.lit(n)).select(*[F.col(v).alias(f"{side}_{v}") for v in values]) for side, n in (("a", first), ("b", second)))
    drawn = audit_replicates(sample, pair, cell, cell[-1], reps=reps, seed=seed).where("style = 'overall'").select("rep", "value", name)
    x = drawn.where(F.col("name") == F.lit(first)).select("rep", F.col("value").alias("x"))
    y = drawn.where(F.col("name") == F.lit(second)).select("rep", F.col("value").alias("y"))
    diff, ratio = F.col("x") - F.col("y"), F.when(F.col("y") != 0, F.col("x") / F.col("y"))
    at = lambda c, p: F.percentile(c, F.lit(p))
    bounds = x.join(y, "rep").agg(at(diff, 0.025).alias("gap_low"), at(diff, 0.975).alias("gap_high"), at(ratio, 0.025).alias("ratio_low"), at(ratio, 0.975).alias("ratio_high"))
    both = a.crossJoin(b).crossJoin(bounds)  # one row each
    p, q, s, t = (F.col(c) for c in ("a_flash_population_rate", "b_flash_population_rate", "a_arbiter_reweighted_rate", "b_arbiter_reweighted_rate"))
    return both.select(
        F.col("a_name").alias("first"), F.col("b_name").alias("second"), (p - q).alias("flash_population_gap"), F.try_divide(p, q).alias("flash_population_ratio"), (s - t).alias("arbiter_gap"), "gap_low", "gap_high",
        F.try_divide(s, t).alias("arbiter_ratio"), "ratio_low", "ratio_high", F.coalesce((F.col("gap_low") > 0) | (F.col("gap_high") < 0), F.lit(False)).alias("gap_survives"),
    )
