"""Each operator against a plain version of itself, on edge cases and on the smallest tables."""

import hashlib
import math
import re
import statistics
import time
import zlib

import numpy as np
import pytest
import xxhash
from corvane.llm import html_extract, license_scan, mixing, pii, quality_fm, quality_rules, sentencepiece_bpe, simhash, substring_dedup, topk_search
from corvane.llm.common import connected_components, table
from corvane.llm.queries import piece_model
from corvane.llm.recompression import window_anchors
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("anchor", T.StringType()), T.StructField("score", T.StringType())])
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = " ".join(f"p{i}" for i in range(60))


def edge_rows():
    long = " ".join(f"w{i % 977}x{i}" for i in range(9000))
    rows = [
        (1, None, "en", "a", 0),
        (2, "", "en", None, 0),
        (3, "   \n\t ", None, "a", 5),
        (4, "one two", "en", "a", 7),
        (5, long, "en", "b", len(long)),
        (6, "x " + PASSAGE + " y", "en", "b", 10),
        (7, PASSAGE + " tail words here", "en", "c", 10),
        (7, PASSAGE + " tail words here", "en", "c", 10),
        (8, ("again and " * 40).strip(), "en", "c", 10),
        (9, "a\n" * 3 + "b b b b b b\n\n  \nb b b b b b", "en", None, 9),
        (10, "Été … 日本語 \U0001f600 mail me at jo.do@mail.example.com or 10.0.0.1 now", "fr", "a", 5),
        (11, "call +1 (555) 123-4567 card 4539 1488 0343 6467 id 999.1.1.1 and +12", "en", "a", 5),
        (12, "x " + PASSAGE + " y", "en", "b", 10),
        (None, "no id at all", "en", "a", 3),
    ]
    return [(*r, "clash", "clash") for r in rows]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def small(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# ---- op1


def test_pieces_equal_the_library(spark, edge, small, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    for docs in (edge, small, empty):
        want = []
        for k, t in texts(docs):
            ids = sp.encode(t or "")
            want.append((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest(), True))
        got = rows_of(sentencepiece_bpe.encode_decode(docs, piece_model()), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "library_agrees")
        assert got == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))


def test_agenda_on_random_strings():
    codec = sentencepiece_bpe.PieceCodec.of(piece_model())
    rng = np.random.default_rng(3)
    letters = "▁  abcdefé日\n\t\x00\U0001f600 ́the ing 12<s>"
    for _ in range(2000):
        s = "".join(letters[i] for i in rng.integers(0, len(letters), int(rng.integers(0, 30))))
        assert codec.encode(s)[0] == codec.library.encode(s)


# ---- op2


def plain_repeats(docs, width):
    seen, out = {}, []
    order = sorted(docs, key=lambda d: (-(2**63) if d[0] is None else d[0]))
    first = {}
    for k, t in order:
        w = WORD.findall(t or "")
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            place = (-(2**63) if k is None else k, i)
            first[key] = min(first.get(key, place), place)
    for k, t in order:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < (-(2**63) if k is None else k, i):
                gone |= set(range(i, i + width))
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("hold", [1_000_000, 3])
def test_repeats_equal_brute_force(edge, small, empty, hold):
    for docs in (edge, small, empty):
        got = rows_of(substring_dedup.remove_repeats(docs, hold=hold), "doc_id", "n_words", "n_removed", "kept_sha256")
        assert got == plain_repeats(texts(docs), 20)


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(0)
    for alphabet in (2, 3, 50, 10_000):
        tokens = rng.integers(0, alphabet, 4000).astype(np.uint64)
        tokens[3000:3300] = tokens[100:400]
        doc = np.repeat(np.arange(4), 1000)
        starts, anchor, occurrence = window_anchors(tokens, doc, 20)
        by_content = {}
        for s, a, o in zip(starts, anchor, occurrence, strict=True):
            by_content.setdefault(tuple(tokens[s : s + 20]), set()).add((int(a), int(o), int(s)))
        for group in by_content.values():
            assert len({a for a, _, _ in group}) == 1
            assert len({o for _, o, _ in group}) == len(group)


# ---- op3


def plain_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    parts = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(ids, prints, distance=3):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    low = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return [low.get(find(i)) for i in range(len(ids))]


def test_simhash_equals_brute_force(edge, small, empty):
    for docs in (edge, small, empty):
        rows = texts(docs)
        prints = [plain_fingerprint(t) for _, t in rows]
        ids = [k for k, _ in rows]
        want = sorted(zip(ids, [f"{p:016x}" for p in prints], plain_classes(ids, prints), strict=True), key=lambda r: tuple((x is not None, x) for x in r))
        assert rows_of(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want


@pytest.mark.parametrize("block", [2048, 5])
def test_links_of_close_points_equal_brute_force(spark, block):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40)
    points = set(int(x) for x in base)
    for x in base[:12]:
        for _ in range(25):
            y = int(x)
            for b in rng.integers(0, 63, int(rng.integers(1, 5))):
                y ^= 1 << int(b)
            points.add(y)
    points = sorted(points)
    df = spark.createDataFrame([(p,) for p in points], "fp long")
    got = {r["node"]: r["root"] for r in connected_components(simhash.links(df, block=block)).collect()}
    assert [got.get(p, p) for p in points] == plain_classes(points, points)


def test_keep_one_keeps_the_first_of_each_class(edge):
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert ids.count(7) == 1 and 12 not in ids and 6 in ids and 1 in ids and 2 not in ids


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[1000 + i] == 1000 for i in range(50))


# ---- op4


def test_license_matches(edge, empty, spark):
    rows = [
        (1, "Intro. Licensed under the Apache License, Version 2.0. The end.", "", "", 0, "", ""),
        (2, "all RIGHTS\nreserved and so on", "", "", 0, "", ""),
        (3, "This work is licenced under the GNU General Public License, version 3.", "", "", 0, "", ""),
        (4, "the rights of all are reserved", "", "", 0, "", ""),
        (5, license_scan.TEMPLATES["MIT-notice"].replace("Software", "Library"), "", "", 0, "", ""),
        (6, None, "", "", 0, "", ""),
    ]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, DOCS)).collect()
    found = {(r["doc_id"], r["license"]) for r in got}
    assert {(1, "Apache-2.0"), (2, "reserved"), (3, "GPL-3.0"), (5, "MIT-notice")} <= found
    assert not {x for x in found if x[0] in (4, 6)}
    spans = {(r["doc_id"], r["license"]): rows[r["doc_id"] - 1][1][r["start"] : r["end"]] for r in got}
    assert spans[1, "Apache-2.0"] == "Licensed under the Apache License, Version 2.0" and spans[2, "reserved"] == "all RIGHTS\nreserved"
    assert license_scan.scan_licenses(empty).count() == 0 and license_scan.scan_licenses(edge).count() == 0


# ---- op5


def plain_targets(sizes):
    """Share again and again until no source is above its cap."""
    sources = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, list(sources)
    while True:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not above:
            return out | {s: left * weight[s] / total for s in open_}
        for s in above:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.remove(s)
        if not open_:
            return out


def test_mixing_meets_its_targets(edge, small, empty):
    for docs in (edge, small):
        got = mixing.mix_sources(docs).collect()
        assert len(got) == docs.count()
        sizes, biggest = {}, {}
        for r in docs.select("source", "text").collect():
            n = len(WORD.findall(r["text"] or ""))
            sizes[r["source"]] = sizes.get(r["source"], 0) + n
            biggest[r["source"]] = max(biggest.get(r["source"], 0), n)
        want, taken = plain_targets(sizes), {}
        for r in got:
            assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
            assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-6)
            taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        for s, w in want.items():
            assert abs(taken[s] - w) <= biggest[s], (s, taken[s], w)
        again = mixing.mix_sources(docs.repartition(5)).collect()
        key = lambda r: (str(r["doc_id"]), r["_m_text"] or 0, r["taken"])
        assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix_sources(empty).count() == 0


def test_tilts_solve_the_dual(small):
    sizes = small.select("source", mixing.word_count(F.col("text")).alias("size"))
    goals = mixing.targets(sizes)
    grouped = sizes.groupBy("source", "size").agg(F.count("*").alias("n"))
    got = {r["source"]: r for r in mixing.tilts(grouped, goals).collect()}
    want = {r["source"]: r for r in goals.collect()}
    words = {}
    for r in sizes.collect():
        t = got[r["source"]]
        words[r["source"]] = words.get(r["source"], 0) + r["size"] * 2 / (1 + math.exp(-t["tilt"] * r["size"] / t["scale"]))
    for s, w in want.items():
        if w["target"] < 2 * w["source_size"]:
            assert math.isclose(words[s], w["target"], rel_tol=1e-4), (s, words[s], w["target"])


# ---- op6


def test_factorisation_machine_on_held_out_rows(spark, empty, edge):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    model = quality_fm.train(docs, labels)
    got = quality_fm.score_quality(docs, model).join(labels, "doc_id").collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    good = [r["score"] for r in got if r["held_out"] and r["quality"] == 1]
    bad = [r["score"] for r in got if r["held_out"] and r["quality"] == 0]
    pairs = statistics.mean((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert pairs > 0.97
    assert quality_fm.score_quality(edge, model).count() == edge.count() and quality_fm.score_quality(empty, model).count() == 0
    assert quality_fm.train(docs, labels.where("false")) is None


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    model = {"w0": 0.3, "w": rng.normal(size=50), "v": rng.normal(size=(50, 4))}
    index, x = np.array([3, 7, 20, 41]), rng.normal(size=4)
    pairs = sum(model["v"][index[a]] @ model["v"][index[b]] * x[a] * x[b] for a in range(4) for b in range(a))
    assert math.isclose(quality_fm.raw_score(index, x, model), 0.3 + model["w"][index] @ x + pairs)


# ---- op7


def plain_top(rows, k):
    vectors = {}
    sound = []
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            sound.append((i, [math.floor(256 * float(x)) for x in v]))
    out = []
    for q, a in sound:
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), c) for c, b in sound if c != q and len(a) == len(b))
            out += [(q, r, c, -s) for r, (s, c) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_top_k_equals_brute_force(spark, sf_dir):
    rows = [(r["vec_id"], list(r["embedding"])) for r in table(spark, sf_dir, "embeddings").collect()]
    odd = [(1000, None), (1001, []), (1002, [1.0, None] * 32), (1003, [float("nan")] * 64), (1004, [float("inf")] * 64), (1050, [0.5, 1.5]), (1005, [1.0, 2.0]), (1006, [1.0, 2.0]), (1100, rows[0][1]), (None, rows[1][1])]
    schema = "vec_id long, embedding array<float>, label int, score string"
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows + odd], schema)
    got = rows_of(topk_search.top_k(df, F.col("vec_id") % 50 == 0), "query_id", "rank", "vec_id", "score")
    assert got == plain_top(rows + odd, 5)
    assert topk_search.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def broadcast_bytes(spark, run):
    """The sizes of all broadcasts made while ``run`` is called."""
    store = spark._jsparkSession.sharedState().statusStore()
    several = lambda xs: [xs.apply(i) for i in range(xs.size())]
    runs = lambda: {x.executionId() for x in several(store.executionsList())}
    before = runs()
    run()
    time.sleep(2)  # the store follows the runs
    sizes, units = [0], {"B": 1, "KiB": 2**10, "MiB": 2**20, "GiB": 2**30}
    for i in runs() - before:
        values = store.executionMetrics(i)
        for node in several(store.planGraph(i).allNodes()):
            for m in several(node.metrics()) if node.name() == "BroadcastExchange" else ():
                if m.name() == "data size" and values.contains(m.accumulatorId()):
                    size, unit = values.apply(m.accumulatorId()).split()
                    sizes.append(float(size.replace(",", "")) * units[unit])
    return sizes


def test_top_k_sends_no_copies_to_the_driver(spark, sf_dir, monkeypatch):
    """Copies of candidate blocks, one for each query block, were broadcast, for they look small before they are made."""
    monkeypatch.setattr(topk_search, "QUERIES", 1)
    base = [(r["vec_id"], list(r["embedding"])) for r in table(spark, sf_dir, "embeddings").collect()]
    rows = base + [(10_000 + 50 * i, base[i % len(base)][1]) for i in range(300)]
    df, got = spark.createDataFrame(rows, "vec_id long, embedding array<float>"), []
    sent = broadcast_bytes(spark, lambda: got.extend(rows_of(topk_search.top_k(df, F.col("vec_id") % 50 == 0), "query_id", "rank", "vec_id", "score")))
    assert got == plain_top(rows, 5)
    assert max(sent) < 8 * 2**20, sent


def test_pruning_drops_no_result():
    rng = np.random.default_rng(2)
    c = np.floor(256 * rng.normal(0, 0.1, (1500, 64)))
    c[:300] += 40
    q, cid = c[:40], np.arange(1500)
    a, b, s = topk_search.search_block(cid[:40], q, cid, c, 5, chunk=100)
    full = (q @ c.T).astype(int)
    for i in range(40):
        want = sorted((-full[i, j], j) for j in range(1500) if j != i)[:5]
        assert [(-x, y) for y, x in zip(b[a == i], s[a == i], strict=True)] == want


# ---- op8


def plain_base(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[\x20-]", "", m[0])
        if 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_patterns_equal_the_plain_ones(spark, sf_dir, small):
    rng = np.random.default_rng(4)
    letters = "ab@.-+_% 0123456789()é\n"
    made = ["".join(letters[i] for i in rng.integers(0, len(letters), 60)) for _ in range(3000)]
    made += ["1.2.3.4.5.6.7.8 1.2.3", "a@b@c.d.e@f.g", "00000001.2.3.4", "4539148803436467", "+" * 30 + "1 2 3 4 5 6 7 8 9", "1" * 5000]
    for t in made + [t for _, t in texts(small)]:
        assert sorted(pii.base_spans(t)) == sorted(plain_base(t)), t


def test_spans_hold_the_base_and_do_not_overlap(edge, empty, small):
    assert pii.find_personal_data(empty).count() == 0
    for docs in (edge, small):
        text = {}
        for k, t in texts(docs):
            text.setdefault(k, []).append(t or "")
        rows = pii.find_personal_data(docs).collect()
        assert len(rows) == docs.count()
        for r in rows:
            wants = [pii.joined(plain_base(t)) for t in text[r["doc_id"]]]
            assert r["base_sha256"] in [hashlib.sha256(w.encode()).hexdigest() for w in wants]
            assert any(set(filter(None, w.split(","))) <= set(r["spans"].split(",")) for w in wants)


def test_tagger_adds_variants_and_leaves_prose():
    x, y, _ = pii.training_set(400, 1234)
    params = pii.train()
    scores, _ = pii.emissions(x, params)
    path = pii.viterbi(scores, params)
    hit = (path == y)[y > 0].mean()
    assert hit > 0.8 and (path == y).mean() > 0.93
    tagger = pii.Tagger(params)
    clean = ["the ring of her tion is version 2.0 and 45 more", "no digits here at all " * 50]
    assert tagger.added(clean, [[], []]) == [[], []]


def test_gradient_is_that_of_the_loss():
    x, y, _ = pii.training_set(3, 1)
    p = pii._start(1)
    _, g = pii.loss_and_gradient(x, y, p)
    for k, a in p.items():
        i = tuple(n // 3 for n in a.shape)
        i = (x[0, 0], 2) if k == "embed" else i
        a[i] += 1e-5
        up, _ = pii.loss_and_gradient(x, y, p)
        a[i] -= 2e-5
        down, _ = pii.loss_and_gradient(x, y, p)
        a[i] += 1e-5
        assert math.isclose((up - down) / 2e-5, g[k][i], rel_tol=1e-4, abs_tol=1e-7)


def test_windows_cover_every_trigger():
    text = "".join("7" if i % 37 in (0, 1, 5) else "x" for i in range(1000))
    starts = pii.windows(text)
    for i, c in enumerate(text):
        if c == "7":
            assert any(s <= max(0, i - 8) and i + 8 <= s + pii.SIZE for s in starts)


# ---- op9

PAGES = [
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><article><h1>Big &amp; bold</h1><p>Some  <b>text</b>\n of the day.<p>More of it &eacute; here.</article><div class='ad'>Buy the thing now</div><footer>&copy; x</footer></body></html>", "Big & bold\nSome text of the day.\nMore of it é here."),
    (None, ""),
    ("", ""),
    ("<p>cut off <b", "cut off"),
    ("<div id='comments'><p>I think that the article is bad and it is wrong.</p></div>", ""),
    ("<article><p>Kept of the page.</p><form><p>Your name of it</p></form><aside>See the rest</aside><section class='comments'><p>Nice of you</p></section></article>", "Kept of the page."),
    ("<article><script>var a='<p>no</p>';</script><p>a &lt; b &#x41;&#66; is the case</p><!-- <p>x</p> --></article>", "a < b AB is the case"),
]


def test_pages(spark):
    df = spark.createDataFrame([(i, f"u{i}", h, "clash") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_extract.extract_main_text(df).collect()}
    for i, (h, want) in enumerate(PAGES):
        if i != 3:
            assert got[i]["text"] == want, h
        assert got[i]["n_chars"] == len(got[i]["text"]) and got[i]["url"] == f"u{i}"
    assert html_extract.extract_main_text(df.where("false")).count() == 0


def test_neighbours_decide_short_blocks():
    prose = "This is the text of a page that is not marked as an article but it has all the words that one would expect of it. " * 3
    page = f"<div><p>{prose}</p><p>Short one</p><p>{prose}</p></div><div><a href=1>One link</a> <a href=2>Two links</a></div><p>tail</p>"
    assert html_extract.main_text(page).split("\n") == [prose.strip(), "Short one", prose.strip()]


def test_article_of_the_small_pages(spark, sf_dir):
    for r in table(spark, sf_dir, "pages").collect():
        inner = re.search(r"(?s)<article>(.*?)</article>", r["html"])[1]
        blocks = [re.sub(r"\s+", " ", __import__("html").unescape(re.sub("<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1|br)>", inner)]
        assert html_extract.main_text(r["html"]) == "\n".join(b for b in blocks if b)


# ---- op10


def plain_shape(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    rep = {p for v in grams.values() if len(v) > 1 for i in v for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(rep)


def test_shape_and_verdicts(spark, edge, small, empty, sf_dir):
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    for docs in (edge, small):
        got = quality_rules.annotate_quality(docs, trusted)
        assert set(docs.columns) - {"score"} <= set(got.columns)
        rows = got.collect()
        assert len(rows) == docs.count()
        for r in rows:
            shape = plain_shape(r["text"])
            assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == shape
            failed = shape[0] < 50 or 100 * shape[4] > 50 * shape[0]
            assert r["base_failed"] == failed and r["kept"] == (not failed and r["score"] >= quality_rules.THRESHOLD)
    assert quality_rules.annotate_quality(empty, trusted).count() == 0


def test_scores_equal_brute_force(spark, small, sf_dir):
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    buckets, prior = 512, 5.0
    got = {r["doc_id"]: r["score"] for r in quality_rules.annotate_quality(small, trusted, strata=None, buckets=buckets, prior=prior).collect()}
    cell = F.pmod(F.xxhash64("a"), F.lit(buckets)), F.pmod(F.xxhash64(F.xxhash64("a"), F.xxhash64("b")), F.lit(buckets))
    pairs = {(a, b) for _, t in texts(small) for w in [WORD.findall(t or "")] for a, b in zip(w, w[1:] + w[:1], strict=True)}
    known = {(r["a"], r["b"]): (r["x"], r["y"]) for r in spark.createDataFrame(list(pairs), "a string, b string").select("a", "b", cell[0].alias("x"), cell[1].alias("y")).collect()}
    good = {r["doc_id"] for r in trusted.collect()}
    grams, raw, target = {}, np.zeros(buckets), np.zeros(buckets)
    for k, t in texts(small):
        w = WORD.findall(t or "")
        g = [known[a, b][0] for a, b in zip(w, w[1:] + w[:1], strict=True)] + [known[a, b][1] for a, b in zip(w, w[1:], strict=False)]
        grams[k] = g
        np.add.at(raw, g, 1)
        if k in good:
            np.add.at(target, g, 1)
    scale = raw.sum() / target.sum()
    for k, g in grams.items():
        own = target - (k in good)
        weight = np.log((np.maximum(own, 0)[g] * scale + prior) / (raw[g] - 1 + prior))
        assert math.isclose(got[k], weight.mean() if g else 0.0, abs_tol=2e-6)


def test_cells_are_broadcast_as_pages(spark, small, sf_dir):
    """A row for each of the 2^20 cells was slow to look up, and larger."""
    counts = spark.createDataFrame([(0, 5, 7, 2.0), (1023, 1, 3, 2.0), (1024, 0, 9, 2.0), (2999, 4, 4, 2.0)], "cell int, t long, r long, scale double")
    pages = {r["page"]: r for r in quality_rules.cell_pages(counts, 3000).collect()}
    assert {p: len(r["ts"]) for p, r in pages.items()} == {0: 1024, 1: 1024, 2: 952} and all(len(r["ts"]) == len(r["rs"]) for r in pages.values())
    found = {(p << 10) + i: (t, r) for p, row in pages.items() for i, (t, r) in enumerate(zip(row["ts"], row["rs"], strict=True)) if t or r}
    assert found == {0: (5, 7), 1023: (1, 3), 1024: (0, 9), 2999: (4, 4)}
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    sent = broadcast_bytes(spark, lambda: quality_rules.annotate_quality(small, trusted).collect())
    assert max(sent) < 40 * 2**20, sent


def test_held_out_junk_goes_and_clean_stays(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    half = labels.where("quality = 1 and crc32(string(doc_id)) % 2 = 0")  # every other id would leave a language out
    got = quality_rules.annotate_quality(docs.select("doc_id", "text", "lang"), half).where("not base_failed").join(labels, "doc_id").where("crc32(string(doc_id)) % 2 = 1").collect()
    good, bad = ([r["kept"] for r in got if r["quality"] == q] for q in (1, 0))
    assert statistics.mean(good) > 0.95 and statistics.mean(bad) < 0.25, (statistics.mean(good), statistics.mean(bad), len(good), len(bad))
