"""The audit of filters against its SQL and against following each document through each order."""

from collections import Counter
from itertools import permutations

import duckdb
import pytest
from corvane.llm import filter_audit
from corvane.llm.common import table
from corvane.llm.queries import op13_filter_audit

KEYS = ("part", "filter_order", "step")
VALUES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
DOCS = "doc_id long, text string, lang string, part string, A string, n long"
LABELS = "doc_id long, quality int, toxic int, part string"


def by_key(df):
    return {tuple(r[k] for k in KEYS): tuple(r[v] for v in VALUES) for r in df.collect()}


def by_hand(docs, labels):
    least = {}
    for i, text, *_ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = []
    for i, text, lang, *_ in docs:
        t = text or ""
        words = t.encode().split()
        fails = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t))
        fails += "D" * any(c in "#$%&*|" for c in t) + "E" * (i != least.get(t))
        said = [lab for lab in labels if i is not None and lab[0] == i]
        rows.append((lang or "", fails, any(s[1] == 1 for s in said), any(s[2] == 1 for s in said)))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                mine = [r for r in rows if r[0] == part]
                before = [r for r in mine if not set(r[1]) & set(order[: step - 1])]
                hit = [r for r in before if f in r[1]]
                shapley[part, f] += len(hit)
                out[part, "".join(order), step] = [len(before) - len(hit), len(hit), sum(f in r[1] for r in mine) - len(hit), sum(r[1] == f for r in mine), sum(r[2] for r in hit), sum(r[3] for r in hit)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def edge_docs():
    long = " ".join(f"w{i}" for i in range(400_000))  # several pieces
    base = " ".join(f"v{i}" for i in range(220))
    texts = [None, "", "  \n\t", base, base, base + " HELLO WORLD AND MORE CAPITALS HERE", "x " * 500, long, long, base + " 5% off", "É" * 10 + "AB", "été " * 210 + "Z" * 25, "A|B"]
    rows = [(k, t, (None, "", "en", "de")[k % 4]) for k, t in enumerate(texts)]
    rows += [(3, base, "en"), (3, base, "fr"), (None, base, "en"), (None, "only without an id", "en"), (None, "only without an id", "en"), (4, "another text", "en"), (90, "a b\x1cc d", "en")]
    rows += [(100 + k, "many copies", "es") for k in range(30)]
    return rows


def test_edges_equal_following_each_document(spark):
    docs = edge_docs()
    labels = [(3, 1, 0), (3, 0, 1), (None, 1, 1), (4, None, None), (110, 1, 1), (111, 1, None), (777, 1, 1), (2, 0, 1)]
    df = spark.createDataFrame([(*d, "clash", "clash", 1) for d in docs], DOCS).repartition(4)
    got = by_key(filter_audit.audit_filters(df, spark.createDataFrame([(*x, "clash") for x in labels], LABELS)))
    assert got == by_hand(docs, labels)


def test_the_tables_equal_the_sql(spark, sf_dir):
    got = op13_filter_audit(spark, sf_dir)
    assert dict(got.dtypes) == {"part": "string", "filter_order": "string", "step": "int", **dict.fromkeys(VALUES, "bigint")}
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = c.sql(filter_audit.SQL).fetchall()
    assert by_key(got) == {r[:3]: r[3:] for r in want} and len(want) % 600 == 0


def test_no_documents_and_no_labels(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    assert filter_audit.audit_filters(docs.where("false"), labels).collect() == []
    assert all(v[4] == v[5] == 0 for v in by_key(filter_audit.audit_filters(docs, labels.where("false"))).values())


@pytest.mark.parametrize("text", [b"", b" ", b"a", b"a b " * 400_000, b"x" * 3_000_000, b" ".join(b"%d" % k for k in range(300_000))])
def test_pieces_hold_all_words(text):
    assert [w for p in filter_audit._pieces(text) for w in p.split()] == text.split()
