"""Personal data: fixed patterns, and a character-level BiLSTM with a CRF on top.

*Patterns.*  ``base_spans`` finds emails, IPv4 addresses, card numbers and phone numbers by regular
expressions with checks.  They are always reported.

*Model.*  Characters are classes (a letter of any case, a digit, single punctuation marks); an LSTM reads a
window forwards, another backwards, and a linear-chain CRF over tags (outside, and begin and inside of each kind) scores their joint
states.  It is trained in numpy on generated sentences whose spans are known, with variants that the
patterns miss (spaces around dots, spelled-out signs, other groupings) and look-alikes that are no
personal data (keys, hashes, version numbers, sums).  Training is seeded and takes place once per process.

*Windows.*  A span of any kind holds a digit, an at sign or a spelled-out dot, so windows are laid over the neighbourhood of
those, half overlapping.  Each is decoded by Viterbi; spans that touch a window's inner edge are left to the
window that holds them whole, which is there for every span of up to ``MARGIN - 2`` characters (patterns find longer ones);
spans of all windows are reconciled over the text: those that overlap a pattern's or a surer span go, and a span needs a minimum
probability, worked out by a forward-backward pass held to it, and the digits and signs of its kind.

Edge cases: null and empty texts have no spans; texts of any length are searched whole, in time in proportion to it; of spans
alike in probability the first stays; repeated rows are returned each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import small_batches, text_batches

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns.  Possessive digits and the look-behind change no match: a match may as well begin with its run of digits.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|\b(?:dot|punkt|punto|point)\b|[\[({] ?(?:at|dot) ?[\])}]", re.IGNORECASE)
TAGS = 1 + 2 * len(KINDS)
CLASSES = "abcdefghijklmnopqrstuvwxyz0@._%+-()[]{}<>:;,/#'\"=! \n"
OTHER = len(CLASSES)
SIZE, HIDDEN, EMBED = 96, 20, 12
POSTERIOR = 0.7
MARGIN = 48


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out: list[tuple[str, int, int]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        # the host first: names alone, however long, are not searched again and again
        end = at + 1
        if at > done and text[at - 1] in EMAIL_NAME and (host := EMAIL_HOST.match(text, at)):
            start, end = at - 1, host.end()
            while start > done and text[start - 1] in EMAIL_NAME:
                start -= 1
            out.append(("email", start, end))
            done = end
        at = text.find("@", end)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = re.sub(r"[\x20-]", "", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def classes(text: str) -> np.ndarray:
    """The class of each character."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return _table()[np.minimum(codes, 256)]


@lru_cache(1)
def _table() -> np.ndarray:
    table = np.full(257, OTHER, np.int64)
    for i, c in enumerate(CLASSES):
        table[ord(c)] = table[ord(c.upper())] = i
    for c in "123456789":
        table[ord(c)] = CLASSES.index("0")
    table[[9, 13]] = CLASSES.index(" ")
    return table


# ---------------------------------------------------------------- generated sentences


def _example(rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A sentence and its spans (kind number, start, end)."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda k: "".join(str(int(d)) for d in rng.integers(0, 10, k))
    parts = ["the", "an", "er", "tion", "ou", "es", "st", "le", "ment", "eux", "sch", "ung", "keit", "os", "ción", "ar", "re", "on", "é", "ü", "ing", "ha"]
    letters = lambda: pick("bcdfghjklmnprstvwz") + pick("aeiouy") + pick(["", "", "n", "r", "s", "t", "l"])
    word = lambda: "".join(pick(parts) if rng.random() < 0.4 else letters() for _ in range(int(rng.integers(1, 4))))
    ascii_word = lambda: re.sub("[^a-z]", "", word()) or "x"

    def item() -> tuple[str, int]:
        kind = int(rng.integers(0, 9))
        if kind == 0:
            name, host, end = pick([ascii_word(), f"{ascii_word()}.{ascii_word()}", f"{ascii_word()}.{num(2)}", f"{ascii_word()}{num(2)}", f"{ascii_word()}_{ascii_word()}"]), pick(["mail", "post", ascii_word()]) + pick(["", num(1)]), pick(["com", "org", "net", "de", "fr", "example.com", "example.org"])
            at, dot = pick([" at ", " [at] ", " (at) ", "[at]", "(at)", " AT ", " @ "]), pick([" dot ", " [dot] ", " (dot) ", "[dot]", "(dot)", " DOT "])
            return pick([f"{name}@{host}.{end}"] * 3 + [f"{name} @ {host}.{end}", f"{name}@{host} . {end}", f"{name} @ {host} . {end}"] + [f"{name}{at}{host}{dot}{end.replace('.', dot)}"] * 3), 0
        if kind == 1:
            quad = [str(int(x)) for x in rng.integers(1, 256, 4)]
            return pick([".".join(quad)] * 3 + [" . ".join(quad), "[.]".join(quad), " dot ".join(quad), "(.)".join(quad)]), 1
        if kind == 2:
            digits = pick("3456") + num(15)
            four = [digits[i : i + 4] for i in range(0, 16, 4)]
            return pick([digits, digits, " ".join(four), "-".join(four), ".".join(four), "/".join(four), " - ".join(four)]), 2
        if kind == 3:
            a, b, c = num(3), num(3), num(4)
            return pick([f"+1 ({a}) {b}-{c}"] * 3 + [f"({a}) {b}-{c}", f"+{num(2)} {a} {b} {c}", f"00{num(2)} {a} {b} {c}", f"+1-{a}-{b}-{c}", f"({a}) {b} {c}", f"00{num(2)}-{a}-{b}-{c}", f"+ {num(2)} {a} {b} {c}"]), 3
        if kind == 4:
            return pick([f"version {num(1)}.{num(1)}.", f"{num(1)}.{num(1)}.{num(1)}", f"{num(1)}.0", f"{num(2)} %", f"$ {num(3)}.{num(2)}", f"{num(4)}-{num(2)}-{num(2)}", num(int(rng.integers(1, 6)))]), -1
        if kind == 5:
            return "".join(pick("0123456789abcdef") for _ in range(int(rng.integers(8, 41)))), -1
        if kind == 6:
            return pick(["password=", "AKIA", 'token = "']) + "".join(pick("0123456789abcdefGHKLMN") for _ in range(16)), -1
        if kind == 7:
            return pick([f"{word()} at {word()}", f"{word()} dot {word()}", f"at {num(1)} dot {num(2)}", f"{word()} {num(2)}:{num(2)}", f"#{num(3)}", f"({num(4)})", f"@{word()}", f"{num(3)},{num(3)},{num(3)}", f"p. {num(3)}-{num(3)}"]), -1
        return word(), -1

    text, spans = "", []
    for _ in range(int(rng.integers(6, 16))):
        if rng.random() < 0.4:
            part, kind = item()
        else:
            part, kind = word(), -1
        if kind >= 0:
            spans.append((kind, len(text), len(text) + len(part)))
        text += part + pick([" "] * 8 + [", ", ". ", "\n"])
    return text, spans


def training_set(n: int, seed: int, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes, tags, mask), each n by ``size``; spans that a cut goes through are left out."""
    rng = np.random.default_rng(seed)
    x, y, mask = np.full((n, size), OTHER), np.zeros((n, size), np.int64), np.zeros((n, size), bool)
    for k in range(n):
        text, spans = _example(rng)
        at = int(rng.integers(0, max(1, len(text) - size)))
        piece = text[at : at + size]
        x[k, : len(piece)] = classes(piece)
        mask[k, : len(piece)] = True
        for kind, a, b in spans:
            if at <= a and b <= at + size:
                y[k, a - at] = 1 + 2 * kind
                y[k, a - at + 1 : b - at] = 2 + 2 * kind
    return x, y, mask


# ---------------------------------------------------------------- the network


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _start(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {"embed": rng.normal(0, 0.3, (OTHER + 1, EMBED)), "out": rng.normal(0, 0.2, (2 * HIDDEN, TAGS)), "bias": np.zeros(TAGS), "trans": rng.normal(0, 0.05, (TAGS, TAGS)), "first": np.zeros(TAGS)}
    for side in ("f", "b"):
        p[f"x{side}"] = rng.normal(0, 1 / np.sqrt(EMBED), (EMBED, 4 * HIDDEN))
        p[f"h{side}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
        p[f"c{side}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    return p


def _lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, c0: np.ndarray, keep: bool):
    """States of an LSTM over axis 1 of x (batch, time, features); with ``keep`` also what the gradient needs."""
    n, t, _ = x.shape
    z_in = x @ w + c0
    h, c = np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype)
    hs, saved = np.empty((n, t, HIDDEN), x.dtype), []
    for k in range(t):
        z = z_in[:, k] + h @ u
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        c_old, h_old = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        hs[:, k] = h
        if keep:
            saved.append((i, f, o, g, c_old, tc, h_old))
    return hs, saved


def _lstm_back(dh_all: np.ndarray, x: np.ndarray, w: np.ndarray, u: np.ndarray, saved: list):
    n, t, _ = x.shape
    dz_all = np.empty((n, t, 4 * HIDDEN))
    du, dh, dc = np.zeros_like(u), np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
    for k in reversed(range(t)):
        i, f, o, g, c_old, tc, h_old = saved[k]
        dh = dh + dh_all[:, k]
        dc = dc + dh * o * (1 - tc**2)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c_old * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)], axis=1)
        dz_all[:, k] = dz
        du += h_old.T @ dz
        dh, dc = dz @ u.T, dc * f
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    return dz_all @ w.T, x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(axis=0)


def _lse(z: np.ndarray, axis: int) -> np.ndarray:
    top = z.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(z - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def emissions(x: np.ndarray, p: dict, keep: bool = False):
    e = p["embed"][x]
    hf, sf = _lstm(e, p["xf"], p["hf"], p["cf"], keep)
    hb, sb = _lstm(e[:, ::-1], p["xb"], p["hb"], p["cb"], keep)
    h = np.concatenate([hf, hb[:, ::-1]], axis=2)
    return h @ p["out"] + p["bias"], (e, h, sf, sb)


def forward_backward(scores: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch: forward and backward scores, log partition."""
    t = scores.shape[1]
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[:, 0] = scores[:, 0] + p["first"]
    for k in range(1, t):
        alpha[:, k] = scores[:, k] + _lse(alpha[:, k - 1][:, :, None] + p["trans"], 1)
    for k in range(t - 2, -1, -1):
        beta[:, k] = _lse(p["trans"] + (scores[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
    return alpha, beta, _lse(alpha[:, -1], 1)


def marginals(scores: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch: log partition, posteriors of tags, expected counts of transitions."""
    t = scores.shape[1]
    alpha, beta, z = forward_backward(scores, p)
    post = np.exp(alpha + beta - z[:, None, None])
    pair = np.zeros((TAGS, TAGS), scores.dtype)
    for k in range(1, t):
        pair += np.exp(alpha[:, k - 1][:, :, None] + p["trans"] + (scores[:, k] + beta[:, k])[:, None, :] - z[:, None, None]).sum(axis=0)
    return z, post, pair


def loss_and_gradient(x: np.ndarray, y: np.ndarray, p: dict) -> tuple[float, dict[str, np.ndarray]]:
    """Negative log-likelihood of the tags and its gradient, both per window."""
    n, t = x.shape
    scores, (e, h, sf, sb) = emissions(x, p, keep=True)
    z, post, pair = marginals(scores, p)
    rows = np.arange(n)
    gold = np.take_along_axis(scores, y[:, :, None], 2).sum() + p["first"][y[:, 0]].sum() + p["trans"][y[:, :-1], y[:, 1:]].sum()
    ds = post.copy()
    ds[rows[:, None], np.arange(t)[None, :], y] -= 1
    ds /= n
    true_pair = np.zeros((TAGS, TAGS))
    np.add.at(true_pair, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    g = {"trans": (pair - true_pair) / n, "first": ds[:, 0].sum(axis=0), "bias": ds.sum(axis=(0, 1))}
    g["out"] = h.reshape(-1, 2 * HIDDEN).T @ ds.reshape(-1, TAGS)
    dh = ds @ p["out"].T
    def_, g["xf"], g["hf"], g["cf"] = _lstm_back(dh[:, :, :HIDDEN], e, p["xf"], p["hf"], sf)
    deb, g["xb"], g["hb"], g["cb"] = _lstm_back(dh[:, ::-1, HIDDEN:], e[:, ::-1], p["xb"], p["hb"], sb)
    g["embed"] = np.zeros_like(p["embed"])
    np.add.at(g["embed"], x.ravel(), (def_ + deb[:, ::-1]).reshape(-1, EMBED))
    return float((z.sum() - gold) / n), g


@lru_cache(2)
def train(steps: int = 1000, batch: int = 40, seed: int = 9, size: int = 64) -> dict[str, np.ndarray]:
    """The tagger's parameters after ``steps`` of Adam; the same on every machine run."""
    x, y, _ = training_set(steps * batch // 4, seed, size)
    p = _start(seed)
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    rng = np.random.default_rng(seed)
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(x), batch)
        _, g = loss_and_gradient(x[pick], y[pick], p)
        norm = np.sqrt(sum((a**2).sum() for a in g.values()))
        rate = 0.03 * min(1.0, step / 20) * (1 - 0.95 * step / steps)
        for k in p:
            a = g[k] * min(1.0, 5 / norm)
            m[k], v[k] = 0.9 * m[k] + 0.1 * a, 0.99 * v[k] + 0.01 * a**2
            p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return {k: a.astype(np.float32) for k, a in p.items()}


def viterbi(scores: np.ndarray, p: dict) -> np.ndarray:
    """The best tag sequence of each window; inside tags follow only their own kind."""
    n, t, _ = scores.shape
    trans, first = p["trans"].copy(), p["first"].copy()
    for kind in range(len(KINDS)):
        inner = 2 + 2 * kind
        first[inner] = -1e9
        for tag in range(TAGS):
            if tag not in (inner - 1, inner):
                trans[tag, inner] = -1e9
    best, back = scores[:, 0] + first, np.empty((t, n, TAGS), np.int8)
    for k in range(1, t):
        options = best[:, :, None] + trans
        back[k] = options.argmax(axis=1)
        best = scores[:, k] + options.max(axis=1)
    path = np.empty((n, t), np.int64)
    path[:, -1] = best.argmax(axis=1)
    for k in range(t - 1, 0, -1):
        path[:, k - 1] = back[k][np.arange(n), path[:, k]]
    return path


def windows(text: str, size: int = SIZE, margin: int = MARGIN) -> list[int]:
    """Starts of half-overlapping windows that cover the neighbourhood of every digit and at sign."""
    out, end = [], -1
    for m in TRIGGER.finditer(text):
        lo, hi = max(0, m.start() - margin), min(len(text), m.start() + margin)
        if not out or lo > end:
            out.append(lo)
            end = lo + size
        while end < hi:
            out.append(out[-1] + size // 2)
            end = out[-1] + size
    return out


def span_probability(scores: np.ndarray, alpha: np.ndarray, beta: np.ndarray, z: float, p: dict, a: int, b: int, kind: int) -> float:
    """The probability, in one window, of exactly this span: a forward-backward pass held to its tags and to its end."""
    first, inner = 1 + 2 * kind, 2 + 2 * kind
    total = alpha[a, first]
    for k in range(a + 1, b):
        total += p["trans"][first if k == a + 1 else inner, inner] + scores[k, inner]
    if b < len(scores):
        last = inner if b > a + 1 else first
        after = p["trans"][last] + scores[b] + beta[b]
        after[inner] = -np.inf
        total += _lse(after[None], 1)[0]
    return float(np.exp(total - z))


def _plausible(kind: int, piece: str) -> bool:
    digits = sum(c.isdigit() for c in piece)
    if kind == 0:
        at = "@" in piece or re.search(r"\bat\b", piece, re.IGNORECASE)
        return bool(at and ("." in piece or re.search(r"\bdot\b", piece, re.IGNORECASE)) and len(piece) >= 6)
    if kind == 1:
        numbers = re.findall("[0-9]+", piece)
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers)
    if kind == 2:
        return 15 <= digits <= 19 and luhn("".join(c for c in piece if c.isdigit()))
    return 9 <= digits <= 15 and len(re.findall("[0-9]+", piece)) >= 3


class Tagger:
    def __init__(self, params: dict, posterior: float = POSTERIOR) -> None:
        self.params, self.posterior = params, posterior

    def added(self, texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
        """For each text, the spans that the model adds to its base spans."""
        where = [(k, s) for k, t in enumerate(texts) for s in windows(t)]
        proposals: list[list[tuple[float, int, int, int]]] = [[] for _ in texts]
        for at in range(0, len(where), 1024):
            part = where[at : at + 1024]
            x = np.full((len(part), SIZE), OTHER)
            for r, (k, s) in enumerate(part):
                piece = texts[k][s : s + SIZE]
                x[r, : len(piece)] = classes(piece)
            scores, _ = emissions(x, self.params)
            path = viterbi(scores, self.params)
            some = np.flatnonzero((path > 0).any(axis=1))
            if not len(some):
                continue
            alpha, beta, z = forward_backward(scores[some], self.params)
            for q, r in enumerate(some):
                k, s = part[r]
                tags = path[r]
                for a in np.flatnonzero(tags % 2 == 1):
                    b = a + 1
                    while b < SIZE and tags[b] == tags[a] + 1:
                        b += 1
                    cut = (b == SIZE and s + SIZE < len(texts[k])) or (a == 0 and s > 0)
                    if cut or s + b > len(texts[k]):
                        continue
                    kind = int(tags[a] - 1) // 2
                    sure = span_probability(scores[r], alpha[q], beta[q], z[q], self.params, int(a), int(b), kind)
                    if sure >= self.posterior:
                        proposals[k].append((sure, s + int(a), s + int(b), kind))
        out = []
        for k, text in enumerate(texts):
            taken, new = [(a, b) for _, a, b in base[k]], []
            for _, a, b, kind in sorted(proposals[k], key=lambda x: (-x[0], x[1], x[2])):
                if _plausible(kind, text[a:b]) and not any(a < d and c < b for c, d in taken):
                    taken.append((a, b))
                    new.append((KINDS[kind], a, b))
            out.append(new)
        return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by a mark of its kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame, *, posterior: float = POSTERIOR, clean: bool = False) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one row per row of ``docs``.

    ``clean`` adds ``clean_text``, the text with its spans redacted (null for a null text), and passes all columns
    of ``docs``, which must not have these names.
    """
    small_batches(docs.sparkSession)
    params = docs.sparkSession.sparkContext.broadcast(train())
    counts = [f"n_{k}" for k in KINDS]
    given = docs if clean else docs.select("doc_id", F.col("text").cast("string").alias("text"))
    keep = given.columns if clean else ["doc_id"]
    made = [*counts, "base_sha256", "spans", *(["clean_text"] if clean else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(params.value, posterior)
        for batch in text_batches(batches):
            raw = batch.column(batch.schema.get_field_index("text")).to_pylist()
            texts = [t or "" for t in raw]
            base = [base_spans(t) for t in texts]
            new = tagger.added(texts, base)
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            arrays += [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS]
            arrays.append(pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base]))
            arrays.append(pa.array([joined(b + n) for b, n in zip(base, new, strict=True)]))
            if clean:
                arrays.append(pa.array([None if r is None else redact(t, b + n) for r, t, b, n in zip(raw, texts, base, new, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *made])

    kinds = {f.name: f.dataType.simpleString() for f in given.schema}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"{c} long" for c in counts] + ["base_sha256 string", "spans string"] + (["clean_text string"] if clean else []))
    return given.mapInArrow(run, schema)
