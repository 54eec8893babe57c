"""Recompression of token sequences into globally named symbols, in numpy.

A sequence is rewritten in rounds.  One round names maximal runs of an equal
symbol, the later rounds name pairs: every symbol falls on the left or the right
side by a hash of its name and the round, and each neighbouring (left, right) pair
becomes one symbol.  Names are hashes of what they stand for, so they agree in every
document, task and cluster run without a table of names, and two equal substrings are
parsed alike but for a few symbols at either end.

For a window of ``width`` tokens ``window_anchors`` follows, round by round, the
*zone* of symbols whose parse depends on the window's own tokens alone (the outermost
symbol is given up where an unseen neighbour could join it), and picks the longest
symbol of the last zone that isn't empty.  The pick is a function of the window's
tokens, so equal windows share their anchor's name: a window whose anchor occurs once
in the corpus occurs once itself.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_M1, _M2, _GOLD = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * _M1
    x = x ^ (x >> U64(27))
    x = x * _M2
    return x ^ (x >> U64(31))


def _salt(k: int) -> np.uint64:
    return U64(int(_GOLD) * k & (2**64 - 1))


def join_names(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """The name of the pair (a, b) in the round ``salt``."""
    return mix(mix(a + _salt(2 * salt + 1)) ^ (b + _salt(2 * salt + 2)))


def _best_of_zones(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The index of the largest key in each [a, b), the leftmost of equals."""
    out = np.empty(len(a), np.int64)
    level = np.zeros(len(a), np.int8)
    size = b - a
    top = int(size.max(initial=1)).bit_length()
    for k in range(1, top):
        level[size >= (1 << k)] = k
    table = np.arange(len(key), dtype=np.int64)
    for k in range(top):
        pick = np.flatnonzero(level == k)
        if len(pick):
            left, right = table[a[pick]], table[b[pick] - (1 << k)]
            out[pick] = np.where(key[right] > key[left], right, left)
        half = 1 << k
        if len(table) <= half:
            break
        left, right = table[:-half], table[half:]
        table = np.where(key[right] > key[left], right, left)
    return out


def window_anchors(tokens: np.ndarray, doc: np.ndarray, width: int, rounds: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows of ``width`` tokens that stay inside one document.

    ``tokens``: uint64 names of the tokens of some documents, one after another;
    ``doc``: each token's document, an ascending int64.  Returns the windows' starts, each
    window's anchor name, and an occurrence number: windows that picked the same symbol
    occurrence have the same number.
    """
    n = len(tokens)
    if n < width:
        return np.empty(0, np.int64), np.empty(0, U64), np.empty(0, np.int64)
    starts = np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :]).astype(np.int64)
    anchor = np.empty(len(starts), U64)
    occurrence = np.empty(len(starts), np.int64)
    if not len(starts):
        return starts, anchor, occurrence

    # runs
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (tokens[1:] != tokens[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    size = np.diff(at, append=n)
    name = np.where(size > 1, join_names(tokens[at], size.astype(U64), 0), tokens[at])
    owner = doc[at]
    symbol = np.cumsum(new) - 1
    a, b = symbol[starts] + 1, symbol[starts + width - 1]

    # windows of one or two runs have no run that ends inside them on both sides
    alive = np.flatnonzero(a < b)
    bare = np.flatnonzero(a >= b)
    anchor[bare] = join_names(tokens[starts[bare]], tokens[starts[bare] + width - 1], 1)
    occurrence[bare] = starts[bare]
    base = n
    a, b = a[alive], b[alive]

    for r in range(2, rounds + 3):
        last = r == rounds + 2
        if not len(alive):
            break
        if last:
            done = np.ones(len(alive), bool)
        else:
            side = (mix(name + _salt(r)) & U64(1)).astype(np.int64)
            a2, b2 = a + side[a], b - (1 - side[b - 1])
            done = a2 >= b2
        if done.any():
            key = (np.minimum(size, 63).astype(U64) << U64(58)) | (name >> U64(6))
            best = _best_of_zones(key, a[done], b[done])
            anchor[alive[done]] = join_names(name[best], size[best].astype(U64), 100 + r)
            occurrence[alive[done]] = base + best
        base += len(name)
        if last:
            break
        alive, a, b = alive[~done], a2[~done], b2[~done]
        pair = np.zeros(len(name), bool)
        pair[:-1] = (side[:-1] == 0) & (side[1:] == 1) & (owner[:-1] == owner[1:])
        right = np.zeros(len(name), bool)
        right[1:] = pair[:-1]
        keep = ~right
        index = np.cumsum(keep) - 1
        a, b = index[a], index[b - 1] + 1
        left = np.flatnonzero(pair)
        name, size = name.copy(), size.copy()
        name[left] = join_names(name[left], name[left + 1], r)
        size[left] += size[left + 1]
        name, size, owner = name[keep], size[keep], owner[keep]
    return starts, anchor, occurrence


def window_names(tokens: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit names of the windows that begin at ``starts``, as two uint64 arrays."""
    high = np.zeros(len(starts), U64)
    low = np.full(len(starts), _GOLD)
    for k in range(width):
        t = tokens[starts + k]
        high = mix(high * _M1 + t + U64(k))
        low = mix((low ^ t) * _M2 + _GOLD)
    return high, low
