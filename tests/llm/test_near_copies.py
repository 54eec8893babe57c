"""Near copies by five-word shingles, against brute force."""

import random

import corpus_pipeline
from corvane.llm import near_copies, simhash
from corvane.llm.common import table


def similar_pairs(rows):
    """Pairs of places of similarity 0.8 or more, by sets of word tuples."""
    sets = []
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    return [(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if 10 * len(a & b) >= 8 * len(a | b)]


def test_stage_leaves_no_near_copies(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    bits = simhash.keep_one(docs).collect()
    assert similar_pairs(bits)  # what three bits leave
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, sf_dir).collect()
    assert not similar_pairs(kept)
    # each row that is gone is like a row that three bits left
    gone = {r["doc_id"] for r in bits} - {r["doc_id"] for r in kept}
    alike = {bits[k]["doc_id"] for pair in similar_pairs(bits) for k in pair}
    assert gone and gone <= alike


def test_chains_groups_and_odd_rows(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join([*words[:k], f"x{k}", *words[k + 1 :]])) for k in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "a b"), (1003, "A b"), (None, "a b"), (1004, " ".join(words[::-1]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_copies.keep_one(df).collect()) == [0, 1000, 1002, 1004]
    assert near_copies.keep_one(df.where("false")).count() == 0


def boilerplate():
    """300 texts that share half of their words and buckets, some of them near copies of each other."""
    common = [f"c{i}" for i in range(120)]
    rows = [(k, " ".join(common + [f"own{k}x{i}" for i in range(56)])) for k in range(300)]
    return rows + [(1000 + k, rows[k][1] + " tail") for k in range(0, 300, 30)]


def test_boilerplate_makes_few_pairs(spark):
    rows = boilerplate()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = df.select("doc_id", "text", near_copies.text_hash().alias("th"))
    ids = {r["th"]: r["doc_id"] for r in texts.collect()}
    pairs = {tuple(sorted((ids[r["a"]], ids[r["b"]]))) for r in near_copies.prefix_pairs(texts).collect()}
    like = similar_pairs([r.asDict() for r in df.collect()])
    assert {(rows[i][0], rows[j][0]) for i, j in like} == {(k, 1000 + k) for k in range(0, 300, 30)} <= pairs
    assert len(pairs) < 100  # of 44,850
    assert sorted(r["doc_id"] for r in near_copies.keep_one(df).collect()) == list(range(300))


def test_prefix_pairs_hold_all_similar_ones(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(150):
        text = words[:] if k % 3 else words[: rng.randint(1, 60)]
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = f"z{rng.randint(0, 5)}"
        rows.append((k, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = df.select("text", near_copies.text_hash().alias("th")).distinct()
    given = texts.collect()
    near_copies.MEET = 16  # several blocks
    pairs = {frozenset((r["a"], r["b"])) for r in near_copies.prefix_pairs(texts).collect()}
    near_copies.MEET = 512
    want = {frozenset((given[i]["th"], given[j]["th"])) for i, j in similar_pairs(given)}
    assert want and want <= pairs
