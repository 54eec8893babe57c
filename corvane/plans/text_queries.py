"""Queries that parse generated responses and judge replies, with SQL that knows what each was made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.plans.adapters import letter, table
from corvane.plans.core_queries import query

#: What a response is made of: (text, rank in the parser's order or null, whether it is a commit, whether its text names another option).
#: {L} is the letter, {l} in lower case, {own} its option's text, {other} another one's.
FORMS = (
    ("<answer>{L}</answer>", 0, "answer_tag", False),
    ("<ANSWER> {l} </answer>", 0, "answer_tag", False),
    ("<answer>{L}) {own}</answer>", 1, "labelled_tag", False),
    ("<answer>{L}) {other}!</answer>", 1, "labelled_tag", True),
    ("<answer>({L}) x < y <b></answer>", 1, "labelled_tag", False),
    ("<answer>{L}. coli</answer>", None, None, False),
    ('{"answer": "{L}"}', 2, "json", False),
    ("\\boxed{\\text{({L})}}", 5, "boxed", False),
    ("{\"answer\" : '{l}'}", 3, "json", False),
    ("", None, None, False),
    ('"answer": "{L}"', 4, None, False),
    ("\\boxed{ {L} }", 5, "boxed", False),
)
REASONING = ("plain words", "so <answer> maybe", 'quoted "</think>" mark', 'an {"answer": "A"} inside')
TAILS = ("", ".", " more")
OPTIONS = ("Red", "light  blue", "Green.", "grey")
#: Numbers that pick the parts of row k.
PICKS = {"f1": "k % 12", "f2": "(k // 12) % 12", "rs": "(k // 144) % 4", "cl": "(k // 576) % 2", "tl": "(k // 1152) % 3", "l1": "k % 4", "l2": "(k // 3) % 4"}


def _pick(texts, n: Column) -> Column:
    return F.get(F.array(*map(F.lit, texts)), n.cast("int"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, t, choices): an order's number decides its response's parts."""
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("k"))
    d = d.withColumns({n: F.expr(e.replace("//", "div")) for n, e in PICKS.items()})

    def form(f: str, n: str) -> Column:
        t, at = _pick([x[0] for x in FORMS], F.col(f)), F.col(n)
        filled = {"{L}": letter(at), "{l}": F.lower(letter(at)), "{own}": _pick(OPTIONS, at), "{other}": _pick(OPTIONS, (at + 1) % 4)}
        for mark, value in filled.items():
            t = F.replace(t, F.lit(mark), value)
        return t

    close = F.when(F.col("cl") == 0, "</think>").otherwise("")
    t = F.concat(F.lit("<think>"), _pick(REASONING, F.col("rs")), F.lit(" "), close, form("f1", "l1"), F.lit(" then "), form("f2", "l2"), _pick(TAILS, F.col("tl")))
    return d.select("id", t.alias("t"), F.array(*map(F.lit, OPTIONS)).alias("choices"))


def _case(values, n: str) -> str:
    said = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"CASE {n} " + " ".join(f"WHEN {k} THEN {said(v)}" for k, v in enumerate(values)) + " END"


#: The parts of each response: ranks r1, r2, commits c1, c2, contradictions x1, x2, letters, whether a mark closes the reasoning.
PARTS = (
    "WITH p0 AS (SELECT o_orderkey AS id, o_orderkey AS k FROM orders), p1 AS (SELECT id, " + ", ".join(f"{e} AS {n}" for n, e in PICKS.items()) + " FROM p0), p AS (SELECT *, "
    + ", ".join(f"{_case([x[j] for x in FORMS], f'f{i}')} AS {c}{i}" for i in (1, 2) for j, c in ((1, "r"), (2, "c"), (3, "x")))
    + ", substr('ABCD', l1 + 1, 1) AS a1, substr('ABCD', l2 + 1, 1) AS a2, cl = 0 OR rs = 2 AS closed FROM p1)"
)


@query(
    PARTS
    + """ SELECT id, CASE WHEN closed THEN CASE WHEN r1 IS NULL AND r2 IS NULL THEN NULL WHEN r2 IS NULL OR r1 <= r2 THEN CASE WHEN NOT x1 THEN a1 END ELSE CASE WHEN NOT x2 THEN a2 END END
 WHEN tl < 2 AND r2 IN (0, 1, 2, 3, 5) AND NOT x2 THEN a2 END AS answer FROM p"""
)
def parse_answer(spark, sf_dir):
    return responses(spark, sf_dir).select("id", text.parse_answer(F.col("t"), choices=F.col("choices")).alias("answer"))


@query(PARTS + "SELECT id, CASE WHEN closed THEN coalesce(c1, c2) END AS form FROM p")
def answer_commits(spark, sf_dir):
    return responses(spark, sf_dir).select("id", text.answer_commit(F.col("t"))["form"].alias("form"))


@query(PARTS + f"""SELECT id, CASE WHEN cl = 0 AND (rs <> 2 OR c1 IS NOT NULL OR c2 IS NOT NULL) THEN {_case(REASONING, 'rs')} WHEN rs = 2 THEN 'quoted "' ELSE '' END AS cot FROM p""")
def extract_cot(spark, sf_dir):
    return responses(spark, sf_dir).select("id", text.extract_cot(F.col("t")).alias("cot"))


# ---------------------------------------------------------------- judge replies

BEFORE = ("", "Sure: ", "```json\n", "{x} ", "a { b ", '"{" quoted ', "[1, 2] ")
BODIES = (
    '{"label": @, "confidence": 0.5, "hint_role": "Verification-only", "hint_quote": "none"}',
    '{"label": "@", "confidence": 1, "hint_role": " rejected", "hint_quote": "it said {B}"}',
    '{"meta": {"a": [1, {"b": "}"}]}, "label": @, "confidence": "0.25", "hint_role": 3, "reasoning": "r"}',
    '{"label": @, "confidence": 1.5}',
    '{"label": true, "confidence": 0.5}',
    '{"label": @, "confidence": 0.5',
    '{"note": "q\\" } {", "label": @, "confidence": 0, "hint_quote": " kept "}',
    '{"label": @.0, "confidence": true}',
    '{"label": null, "confidence": 0.5, "note": {"label": @, "confidence": 0.5}}',
    "no object",
)
AFTER = ("", "\n```", ' then {"label": 0, "confidence": 1}', " } trailing {", "}")
_REPLY = ("k % 7", "(k // 7) % 10", "(k // 70) % 5", "CAST(k % 4 AS INTEGER) - 1")


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, raw): an event's number decides its reply's parts."""
    d = table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("k"))
    a, b, c, n = (F.expr(e.replace("//", "div")) for e in _REPLY)
    return d.select("event_id", F.concat(_pick(BEFORE, a), F.replace(_pick(BODIES, b), F.lit("@"), n.cast("string")), _pick(AFTER, c)).alias("raw"))


#: The first object by brute force: each brace with each closing one after it, kept if it is valid JSON.
REPLIES = f"""WITH q AS (SELECT event_id, {_case(BEFORE, _REPLY[0])} || replace({_case(BODIES, _REPLY[1])}, '@', CAST({_REPLY[3]} AS VARCHAR)) || {_case(AFTER, _REPLY[2])} AS raw FROM (SELECT event_id, event_id AS k FROM events)),
i AS (SELECT event_id, raw, unnest(range(1, length(raw) + 1)) AS i FROM q), s AS (SELECT event_id, i FROM i WHERE substr(raw, i, 1) = '{{'), e AS (SELECT event_id, raw, i AS j FROM i WHERE substr(raw, i, 1) = '}}'),
o AS (SELECT event_id, i, j, substr(raw, i, j - i + 1) AS obj FROM s JOIN e USING (event_id) WHERE i < j AND json_valid(substr(raw, i, j - i + 1))),
f AS (SELECT event_id, arg_min(obj, i) AS obj FROM o GROUP BY ALL), g AS (SELECT q.event_id, obj FROM q LEFT JOIN f ON q.event_id = f.event_id)"""


@query(REPLIES + "SELECT event_id, obj AS found FROM g")
def first_json_object(spark, sf_dir):
    return replies(spark, sf_dir).select("event_id", text.first_json_object(F.col("raw")).alias("found"))


@query(
    REPLIES
    + r""", h AS (SELECT event_id, json_type(obj, '$.label') AS lt, json_extract_string(obj, '$.label') AS l, json_type(obj, '$.confidence') AS ct, json_extract_string(obj, '$.confidence') AS c,
  json_extract_string(obj, '$.hint_role') AS r, CASE WHEN json_type(obj, '$.hint_quote') = 'VARCHAR' THEN trim(json_extract_string(obj, '$.hint_quote')) END AS q, coalesce(json_extract_string(obj, '$.reasoning'), '') AS w FROM g),
v AS (SELECT *, CASE WHEN lt = 'VARCHAR' THEN CASE WHEN regexp_full_match(trim(l), '[+-]?[0-9]{1,9}') THEN CAST(l AS INTEGER) END WHEN lt IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(trunc(CAST(l AS DOUBLE)) AS INTEGER) END AS label,
  CASE WHEN ct = 'BOOLEAN' THEN CASE WHEN c = 'true' THEN 1.0 ELSE 0.0 END ELSE try_cast(c AS DOUBLE) END AS confidence, replace(replace(lower(trim(r)), '-', '_'), ' ', '_') AS role FROM h),
z AS (SELECT *, coalesce(label IN (-1, 0, 1) AND confidence BETWEEN 0 AND 1, FALSE) AS good FROM v)
SELECT event_id, CASE WHEN good THEN label END AS label, CASE WHEN good THEN confidence END AS confidence, CASE WHEN good AND role IN ('none', 'neutral', 'verification_only', 'rejected', 'credited') THEN role END AS role,
CASE WHEN good AND lower(q) NOT IN ('', 'null', 'none') THEN q END AS quote, CASE WHEN good THEN w END AS reasoning FROM z"""
)
def judge_json(spark, sf_dir):
    return replies(spark, sf_dir).select("event_id", text.judgement(F.col("raw")).alias("j")).select("event_id", "j.*")
