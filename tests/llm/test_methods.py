"""That the dealt methods decide, on inputs of their own: licences, personal data, pruning, pieces, pages."""

import random
import time

import numpy as np
import pyarrow.parquet as pq
import pytest
from corvane.llm import html_extract, license_scan, pii, sentencepiece_bpe, topk_search
from corvane.llm.queries import piece_model

# ---- op4


@pytest.fixture(scope="module")
def scanner():
    return license_scan.Scanner(license_scan.TEMPLATES, license_scan.GRAM, license_scan.WINDOW, license_scan.BAND, license_scan.COVERAGE)


def test_a_letter_that_grows_when_lowered_loses_no_match(scanner):
    text = "İstanbul notes. Released under the MIT License. All rights reserved."
    assert [(n, text[a:b]) for n, _, a, b in scanner.scan(text)] == [("MIT", "Released under the MIT License"), ("reserved", "All rights reserved")]


@pytest.mark.parametrize("between", range(21))
def test_repeated_notices_are_found_however_near(scanner, between):
    assert len(scanner.scan(("All rights reserved. " + "x " * between) * 3)) == 3


def test_every_template_finds_itself(scanner):
    for name, text in license_scan.TEMPLATES.items():
        assert any(m[:2] == (name, 1.0) for m in scanner.scan(f"some words {text} and more"))


def plain_alignment(a, b):
    """Coverage and span of the best alignment of a with any part of b, over all cells, without index or band."""
    n, m = len(a), len(b)
    score = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        score[i][0] = -i
        for j in range(1, m + 1):
            score[i][j] = max(score[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), score[i - 1][j] - 1, score[i][j - 1] - 1)
    i, j = n, max(range(m + 1), key=lambda j: score[n][j])
    places = []
    while i and j:
        if score[i][j] == score[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1):
            if a[i - 1] == b[j - 1]:
                places.append(j - 1)
            i, j = i - 1, j - 1
        elif score[i][j] == score[i - 1][j] - 1:
            i -= 1
        else:
            j -= 1
    return len(places) / n, (min(places), max(places)) if places else None


def test_matches_equal_a_full_alignment():
    rng = random.Random(3)
    templates = {name: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(9)) for _ in range(size)) for name, size in (("short", 6), ("middle", 25), ("long", 60))}
    found = license_scan.Scanner(templates, 3, 4, 8, 0.8)
    planted = 0
    for _ in range(40):
        words, pieces = [], rng.sample(list(templates), rng.randrange(0, 3))
        for name in pieces:
            words += [f"n{rng.randrange(50)}" for _ in range(rng.randrange(12, 40))]
            copy = templates[name].split()
            for _ in range(rng.randrange(0, len(copy) // 8 + 1)):
                at = rng.randrange(2, len(copy) - 2)
                copy[at : at + 1] = rng.choice([[], ["odd"], [copy[at], "more"]])
            words += copy
        text = " ".join([*words, "end"])
        want = set()
        for name, template in templates.items():
            share, span = plain_alignment(template.split(), text.split())
            if share >= 0.8:
                start = len(" ".join(text.split()[: span[0]])) + (span[0] > 0)
                want.add((name, round(share, 9), start, len(" ".join(text.split()[: span[1] + 1]))))
        assert {(n, round(s, 9), a, b) for n, s, a, b in found.scan(text)} == want
        planted += len(want)
    assert planted > 25


def test_long_texts_take_time_in_proportion(scanner):
    began = time.process_time()
    assert scanner.scan("the following conditions of the software " * 20_000) == []
    assert time.process_time() - began < 60


# ---- op8

NAMES, HOSTS, ENDS = "anna.meyer bob_k carla77 d.ferrari office sales.team ivan.petrov".split(), "acme-tools northwind example mailhub univ-west".split(), "com org net de".split()
PROSE = "please contact our office about the invoice before friday because server room needs new keys and nobody answered when we called yesterday afternoon".split()


def variant(rng):
    n, h, d = rng.choice(NAMES), rng.choice(HOSTS), rng.choice(ENDS)
    quad = [str(rng.randrange(1, 256)) for _ in range(4)]
    digits = "".join(rng.choice("0123456789") for _ in range(15))
    digits = next(digits + x for x in "0123456789" if pii.luhn(digits + x))
    four = [digits[i : i + 4] for i in range(0, 16, 4)]
    a, b, c = ("".join(rng.choice("0123456789") for _ in range(k)) for k in (3, 3, 4))
    return rng.choice([f"{n} @ {h}.{d}", f"{n} at {h} dot {d}", f"{n} [at] {h} [dot] {d}", f"{n}(at){h}(dot){d}", " . ".join(quad), "[.]".join(quad), ".".join(four), "/".join(four), f"({a}) {b}-{c}", f"0049 {a} {b} {c}"])


def test_variants_in_sentences_of_another_kind_are_added():
    rng, tagger, found, other = random.Random(5), pii.Tagger(pii.train()), 0, 0
    for _ in range(300):
        before, after = (" ".join(rng.choice(PROSE) for _ in range(rng.randrange(2, 9))) for _ in range(2))
        v = variant(rng)
        text = f"{before} {v} {after}"
        got = tagger.added([text], [pii.base_spans(text)])[0]
        hit = any((a, b) == (len(before) + 1, len(before) + 1 + len(v)) for _, a, b in got)
        found, other = found + hit, other + len(got) - hit
    assert found >= 0.85 * 300 and other <= 0.05 * 300
    clean = [" ".join(rng.choice(PROSE) for _ in range(60)) + f" on 2024-0{k}-11 at {k}:30, version 2.{k}.0, {k},000 units" for k in range(1, 9)]
    assert tagger.added(clean, [pii.base_spans(t) for t in clean]) == [[]] * 8


def test_span_probabilities_are_sums_over_all_tag_sequences():
    rng, p = np.random.default_rng(0), pii._start(3)
    scores = rng.normal(0, 1, (1, 4, pii.TAGS))
    alpha, beta, z = pii.forward_backward(scores, p)
    total, held = [], []
    for path in np.ndindex(*[pii.TAGS] * 4):
        s = p["first"][path[0]] + sum(scores[0, k, t] for k, t in enumerate(path)) + sum(p["trans"][a, b] for a, b in zip(path, path[1:], strict=False))
        total.append(s)
        if path[1:3] == (3, 4) and path[3] != 4:
            held.append(s)
    assert np.isclose(z[0], np.logaddexp.reduce(total))
    assert np.isclose(pii.span_probability(scores[0], alpha[0], beta[0], z[0], p, 1, 3, 1), np.exp(np.logaddexp.reduce(held) - z[0]))


def test_names_without_a_host_take_time_in_proportion():
    began = time.process_time()
    assert pii.base_spans("a" * 1_000_000 + "@ " + "b@" * 100_000) == []
    assert time.process_time() - began < 5


# ---- op7


def test_seeded_bars_prune_and_lose_nothing():
    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    v, ids = np.floor(256 * np.array(t.column("embedding").to_pylist(), float)), t.column("vec_id").to_numpy()
    asks = ids % 50 == 0
    scores = np.where(ids[None, :] != ids[asks][:, None], v[asks] @ v.T, -np.inf)
    bar = np.sort(scores[:, ::4], axis=1)[:, -5]
    tally = []
    q, c, s = topk_search.search_block(ids[asks], v[asks], ids, v, 5, start=bar, tally=tally)
    assert sum(tally) < 0.7 * scores.size
    for row, i in zip(scores, ids[asks], strict=True):
        best = sorted(zip(-row, ids, strict=True))[:5]
        assert [(-int(x), y) for x, y in zip(s[q == i], c[q == i], strict=True)] == [(int(x), y) for x, y in best]


# ---- op1


def test_odd_texts_and_long_words_equal_the_library():
    codec = sentencepiece_bpe.PieceCodec.of(piece_model())
    texts = ["a km². b  c", " ².", "x  ². y.", "▁▁", "▁", " ", "a\n\n b\t\rc", "é" * 400, "ab" * 3000 + ". ", "日本語 ² .\x00 \U0001f600x", "word " * 3000, "n\no\n", "\n", "Ünïcode–dash…  “quotes”"]
    for text, (ids, joined, same) in zip(texts, codec.encode_all(texts), strict=True):
        assert ids == codec.library.encode(text) and joined == ",".join(map(str, ids)) and same


def test_what_a_worker_remembers_is_small_and_keeps_the_words_at_hand():
    import tracemalloc

    codec = sentencepiece_bpe.PieceCodec(piece_model())
    tracemalloc.start()
    n = sum(len(codec.encode(" ".join(f"word{k}x{i}" for i in range(1000)))[0]) > 0 for k in range(20))
    each = tracemalloc.get_traced_memory()[0] / (1000 * n)
    tracemalloc.stop()
    # a worker has it beside the tasks of all other stages, two workers an executor
    assert len(codec.words) == 20_000 and each * codec.memory < 100e6
    codec, taught, learn = sentencepiece_bpe.PieceCodec(piece_model(), memory=40), [], sentencepiece_bpe.PieceCodec.learn
    codec.learn = lambda segments: taught.extend(segments) or learn(codec, segments)
    for k in range(30):
        text = "some words that all texts hold, " + " ".join(f"own{k}n{i}" for i in range(10))
        assert codec.encode(text)[0] == codec.library.encode(text) and len(codec.words) <= 40
    assert len(taught) == len(set(taught))


# ---- op9

PROSE_BLOCK = "This is the text of the page and it has all of the words that one would expect to find in it. " * 3


@pytest.mark.parametrize("name", ["no-sidebar", "has-sidebar", "page tags-enabled", "single with-header", "post tag-news"])
def test_class_names_shut_out_no_whole_page(name):
    assert html_extract.main_text(f'<body class="{name}"><article class="{name}"><p>{PROSE_BLOCK}</p></article></body>') == PROSE_BLOCK.strip()


def test_an_open_quote_ends_with_its_tag():
    assert html_extract.main_text('<article><p title="a>x of the day</p><p>and it is here</p></article>') == "x of the day\nand it is here"


def test_labels_of_both_passes():
    page = f"<p>{PROSE_BLOCK}</p><p>Short</p><p>{PROSE_BLOCK}</p><p>{'zq ' * 50}</p><p>lone</p><p>{'xy ' * 60}</p>"
    blocks, has_article = html_extract.blocks_of(page)
    html_extract.classify(blocks, has_article)
    assert [b.label for b in blocks] == ["good", "good", "good", "bad", "bad", "bad"]
