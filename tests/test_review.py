"""Decision rules, review scores, overrides and quotas on hand-made audits."""

import pytest
from corvane.operators import review
from pyspark.sql import functions as F

SCHEMA = "subject_model string, run string, stratum string, hint_style string, case string, judge_label int, arbiter_label int, design_weight double"


def rows(model, style, n00, n01, n10, n11, stratum="s"):
    return [(model, "r", stratum, style, "positive", i, j, 2.0) for (i, j), n in {(0, 0): n00, (0, 1): n01, (1, 0): n10, (1, 1): n11}.items() for _ in range(n)]


def outcome(spark, data, **options):
    return review.decide(review.breakdowns(spark.createDataFrame(data, SCHEMA)), ("m", "r"), **options).first()


def test_each_outcome_of_the_rules(spark):
    good = rows("m", "x", 30, 1, 1, 30) + rows("n", "x", 30, 0, 1, 30)
    assert outcome(spark, good)["outcome"] == "keep_flash"
    failing = good + rows("m", "y", 8, 8, 8, 8)
    assert outcome(spark, failing)["outcome"] == "rejudge_primary_all" and outcome(spark, failing)["n_primary_failing"] == 1
    other = good + rows("n", "y", 8, 8, 8, 8)
    got = outcome(spark, other)
    assert got["outcome"] == "rejudge_slices" and got["n_primary_failing"] == 0 and got["n_concentrated"] >= 1
    even = rows("m", "x", 26, 4, 4, 26) + rows("n", "x", 30, 0, 0, 30)
    assert outcome(spark, even)["outcome"] == "diffuse_disagreement"
    few = good + rows("m", "y", 1, 4, 4, 1) + rows("m", "z", 0, 0, 30, 0)
    assert outcome(spark, few)["n_not_evaluable"] == 2 and outcome(spark, few)["n_styles_below"] == 0
    with pytest.raises(Exception, match="not in the sample"):
        review.decide(review.breakdowns(spark.createDataFrame(good, SCHEMA)), ("q", "r")).collect()


def test_odd_labels_are_counted_apart(spark):
    data = [("m", "r", "s", "x", "c", f, a, 1.0) for f, a in ((0, -1), (0, None), (None, 1), (-1, 0), (0, 0))]
    b = {r["breakdown"]: r for r in review.breakdowns(spark.createDataFrame(data, SCHEMA)).collect()}
    p = b["pooled"]
    assert set(b) == set(review.BREAKDOWNS) and (p["n_total"], p["n_binary"], p["n_arbiter_incoherent"], p["n_arbiter_missing"], p["n_flash_nonbinary"], p["agreement"], p["kappa"]) == (5, 1, 1, 1, 2, 1.0, 1.0)
    none = review.breakdowns(spark.createDataFrame(data[:2], SCHEMA)).where("breakdown = 'pooled'").first()
    assert none["agreement"] is None and none["kappa"] is None and none["weighted_kappa"] is None


SHEET = "rollout_id string, review_kind string, researcher_verdict string, judge_label int, arbiter_label int, judge_model string, arbiter_model string"


def test_review_scores_and_overrides(spark):
    dis, ctl = "disagreement", "agreement_control"
    data = [("a", dis, " Flash", 0, 1, "f", "b"), ("b", dis, "flash", 1, 0, "f", "b"), ("c", dis, "arbiter", 0, -1, "f", "b"), ("d", dis, "unsure", 0, 1, "f", "b"), ("e", dis, "neither", 0, 1, "f", "b"), ("g", dis, None, 0, 1, "f", "b"), ("h", ctl, "both", 1, 1, "f", "b"), ("i", ctl, "neither", 1, 1, "f", "b")]
    df = spark.createDataFrame(data, SHEET)
    s = review.score_review(df, 0.5).first()
    assert (s["n_disagreements"], s["n_disagreements_reviewed"], s["n_disagreements_decided"], s["n_controls_decided"], s["escalate_arbiter_choice"], s["complete"]) == (6, 5, 3, 2, True, False)
    assert abs(s["precision_flash"] - (0.25 + 1 / 3)) < 1e-12 and review.score_review(df.where("rollout_id <> 'g'")).first()["complete"]
    got = {r["rollout_id"]: (r["label"], r["model"]) for r in review.overrides_from_review(df).collect()}
    assert got == {"a": (0, "f"), "b": (1, "f"), "c": (-1, "b"), "h": (1, "f")}
    with pytest.raises(Exception, match="unknown researcher_verdict"):
        review.score_review(df.withColumn("researcher_verdict", F.lit("maybe"))).collect()
    with pytest.raises(Exception, match="verdict both on a row of kind disagreement: a"):
        review.overrides_from_review(df.where("rollout_id = 'a'").withColumn("researcher_verdict", F.lit("both"))).collect()
    with pytest.raises(Exception, match="no label to take over for a"):
        review.overrides_from_review(df.where("rollout_id = 'a'").withColumn("judge_label", F.lit(None).cast("int"))).collect()


def test_quotas_spill_to_the_partner(spark):
    counts = spark.createDataFrame([("m", "r", "u_low", "x", 3), ("m", "r", "u_high", "x", 50), ("m", "r", "u_high", "y", 50), ("m", "r", "f_low", "x", 9), ("n", "r", "u_low", "x", 40)], "subject_model string, run string, stratum string, hint_style string, n_available int")
    plan = lambda **k: {(r["subject_model"], r["stratum"], r["hint_style"]): r["n_take"] for r in review.plan_quotas(counts, {"u_low": 10, "u_high": 20, "f_low": 5}, **k).collect()}
    plain = plan()
    assert plain["m", "u_low", "x"] == 3 and plain["m", "u_high", "x"] + plain["m", "u_high", "y"] == 20 and plain["m", "f_low", "x"] == 5 and plain["n", "u_low", "x"] == 10
    spilt = plan(spill=(("u_low", "u_high"),))
    assert spilt["m", "u_low", "x"] == 3 and spilt["m", "u_high", "x"] + spilt["m", "u_high", "y"] == 27 and spilt["n", "u_low", "x"] == 30
    more = plan(boosted={"u_high": ("y",)}, factor=3.0)
    assert more["m", "u_high", "y"] >= 14 and more["m", "u_high", "x"] + more["m", "u_high", "y"] == 20  # one of each first, the rest as 3 to 1
