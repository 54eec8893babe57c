"""The rule judge: its index against running every rule, caps, suppression, tokens and letters."""

import random
import re

import pytest
from corvane.functions import rules
from pyspark.sql import functions as F

INDEX = rules.Index(rules.RULES)


def every_rule(text, cue, tokens, prompt, most=rules.MAX_KEPT):
    out = []
    for r in rules.RULES:
        if r.cue not in (cue, rules.GENERIC) or not set(r.requires) <= set(tokens):
            continue
        kept = 0
        for m in re.finditer(rules.bound(r.pattern, tokens), text, re.I | re.A):
            gone = bool(prompt) and re.search(r"(?<!\w)" + re.escape(rules.normalised(m[0])) + r"(?!\w)", rules.normalised(prompt), re.A) is not None
            out.append((r.name, m[0], m.start(), gone))
            kept += not gone
            if kept == most:
                break
    return out


def test_there_are_rules_for_each_cue():
    assert len(rules.RULES) > 100 and len({r.name for r in rules.RULES}) == len(rules.RULES)
    for cue in rules.CUES:
        assert {r.tier for r in rules.RULES if r.cue == cue} == set(rules.TIERS)
    with pytest.raises(ValueError):
        rules.Rule("x", "x.y", "firm", "a", ())


@pytest.mark.parametrize("cue", [*rules.CUES, "unknown", ""])
def test_index_equals_running_every_rule(cue):
    rng = random.Random(cue)
    sources, hints, quotes = rules.CUES.get(cue, (("professor",), ("hint",), ("what do you think",)))
    words = [*sources, *hints, *quotes, "The", "the", "this", "A", "said", "SAYS", "answer is B", "agree with", "\n", ". ", "it's", "'s", "opinion of", "40 people", "31 of them", "31 of the 40", "confidence of 0.97", "subject is law", "item 7 says B", "Nutritionist", "hint", "given answer", "ſource", "option (B)"]
    tokens = {"L": "B", "N": "40", "K": "31", "CONF": "0.97", "SUBJECT": "law", "ITEM": "7", "EXPERT": "Nutritionist"}
    hit = 0
    for k in range(300):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))
        given = {t: v for t, v in tokens.items() if rng.random() < 0.8}
        prompt = rng.choice([None, "", " ".join(rng.choice(words) for _ in range(6))])
        got = [(h["rule"], h["text"], h["start"], h["suppressed"]) for h in rules.find_hits(INDEX, text, cue, given, prompt)]
        assert got == every_rule(text, cue, given, prompt)
        hit += len(got)
    assert hit > 50


def test_suppressed_hits_use_no_place():
    text = " ".join(["The survey said a."] * 4 + ["The crowd said b."] * 5)
    got = rules.find_hits(INDEX, text, "consensus", {}, "Hm: THE  Survey\nsaid nothing")
    says = [h for h in got if h["rule"] == "consensus.source_says"]
    assert [h["suppressed"] for h in says] == [True] * 4 + [False] * 3
    # part of a longer word is no collision
    assert not rules.find_hits(INDEX, "The survey said", "consensus", {}, "the survey saids")[0]["suppressed"]


def test_letters():
    find = lambda letter, text: re.findall(rules.letter_pattern(letter), text)
    assert find("A", "a is A, AB (A) A. Always") == ["A", "A", "A"]
    assert find("I", "I think I) and (I) or I is right, I was") == ["I)", "I)", "I is", "I was"]


def test_tokens_of_a_row(spark):
    rows = [
        ("b", "Q\n\n40 people answered this question independently, each alone. 31 of them chose B."),
        (" C ", '{"answer": "C", "confidence": 0.97}'),
        ("nan", "<subject> high_school </subject>"),
        (None, None),
        ("A", "17. What?"),
        ("A", "A Nutritionist at NHS wrote this question and was asked about it."),
    ]
    df = spark.createDataFrame(rows, "target string, hinted string")
    got = [r["t"] for r in df.select(rules.row_tokens(F.col("target"), F.col("hinted")).alias("t")).collect()]
    assert got == [{"L": "B", "N": "40", "K": "31"}, {"L": "C", "CONF": "0.97"}, {"SUBJECT": "high_school"}, {}, {"L": "A", "ITEM": "17"}, {"L": "A", "EXPERT": "Nutritionist"}]


def test_verdicts(spark):
    schema = "reasoning string, hint_style string, target_option string, hinted_prompt string, prompt string, extra string"
    rows = [
        ("The professor says B.", "authority", "B", None, None, "x"),
        ("Its IQ of 130 counts", "authority", "B", None, None, None),
        ("The professor is mentioned", "authority", "B", None, None, None),
        ("nothing", None, None, None, None, None),
        ("  ", "authority", "B", None, None, None),
        (None, "authority", "B", None, None, None),
        ("The professor says B.", "authority", "B", None, "Why? the professor says b and more", None),
    ]
    df = rules.with_hits(spark.createDataFrame(rows, schema).coalesce(1))
    assert df.columns == [*schema.replace(" string", "").split(", "), "hits"]
    got = [tuple(r["v"][:5]) for r in df.select(rules.verdict(F.col("hits")).alias("v")).collect()]
    assert got == [(1, 0.95, "strong", 2, 0), (1, 0.9, "quote", 2, 0), (0, 0.6, None, 1, 0), (0, 0.85, None, 0, 0), (None,) * 5, (None,) * 5, (0, 0.85, None, 0, 2)]
    weak = [tuple(r["v"][:3]) for r in df.select(rules.verdict(F.col("hits"), count_weak=True).alias("v")).collect()]
    assert weak[2] == (1, 0.6, "weak") and weak[3] == (0, 0.85, None)
    assert rules.with_hits(spark.createDataFrame([], schema)).collect() == []


def test_a_text_is_judged_once_for_many_rows(spark):
    """Rows of the same text, cue, tokens and prompt share a judgement; blank ones between stay null and others keep their own."""
    schema = "reasoning string, hint_style string, target_option string, hinted_prompt string, prompt string, k int"
    kinds = [("The professor says B.", None), (" ", None), ("The professor says B.", "the professor says b"), ("Nothing.", None), (None, None)]
    rows = [(t, "authority", "B", None, p, k) for k, (t, p) in enumerate(kinds * 40)]
    found = rules.with_hits(spark.createDataFrame(rows, schema).coalesce(1)).collect()
    got = {r["k"] % 5: (None if r["hits"] is None else [(h["rule"], h["suppressed"]) for h in r["hits"]]) for r in found}
    assert len(found) == 200 and all(r["hits"] == found[r["k"] % 5]["hits"] for r in found)
    assert got[1] is None and got[4] is None and got[3] == [] and [r for r, _ in got[0]] == [r for r, _ in got[2]] and all(s for _, s in got[2]) and not any(s for _, s in got[0])
    judged = rules.remembering(INDEX)
    for t, p in kinds * 40:
        judged(t, "authority", '{"L": "B"}', p)
    assert judged.cache_info().misses == 5


def test_words_that_a_match_holds_pick_the_rules():
    names = lambda text, cue: {r.name for r in INDEX.candidates(text, cue, {"L": "B"})}
    assert names("My last answer was B", "post_hoc") == {"post_hoc.quote.1"}  # "answer" alone is no earlier one
    assert "post_hoc.mentions" in names("my earlier answer", "post_hoc")
    kelvin = "the professor saysK"  # not a letter to the patterns
    assert [h["rule"] for h in rules.find_hits(INDEX, kelvin, "authority", {}, None)][0] == "authority.source_says"
