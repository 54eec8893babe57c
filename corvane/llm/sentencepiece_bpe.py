"""Encoding and decoding with a merge-type (BPE) SentencePiece vocabulary.

The encoder keeps a *score-ordered agenda of adjacent symbol pairs*: the pair whose
joined piece has the best score is merged first, the leftmost of equals, and the
merge puts the two pairs it creates on the agenda; characters without a piece become
byte pieces.

No merge crosses a place between two characters that no piece holds side by side.  A text is cut at such places that are cheap to
find (before a word mark, around a line feed, each only if the vocabulary allows it), and the segments, which recur, are encoded
once per process and remembered.  The agendas of all segments that are new in a piece of an Arrow batch are worked off together in
numpy, one merge of each segment a round, over symbol numbers and a table of pairs; a segment that is long or holds a character
without a piece has an agenda of its own, a heap.  Each new segment is also encoded by the sentencepiece library: where the ids
differ, ``library_agrees`` is false for the texts that hold the segment.  Texts are decoded by the library.

Edge cases: a null text counts as empty; an empty text has no ids, and both digests are those of
the empty string; repeated rows give repeated rows; very long texts are encoded whole, their words as any others; equal scores
merge from the left; other columns of the input are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import small_batches, text_batches

MARK = "▁"
#: Segments of more characters have an agenda of their own.
TOGETHER = 48
#: The agenda's entry of a pair that no piece joins.
NONE = np.iinfo(np.int64).max


class PieceCodec:
    """Encodes as the library's BPE model does; decodes with the library.

    ``memory``: segments remembered at most; beyond it only those of the texts at hand stay.  An executor's Python
    workers keep their memories through the tasks of other operators, so that it is part of what all of these need.
    """

    _made: dict[str, PieceCodec] = {}

    @classmethod
    def of(cls, model_file: str) -> PieceCodec:
        """The process's own codec for a file: what one task has learnt serves the next."""
        if model_file not in cls._made:
            cls._made[model_file] = cls(model_file)
        return cls._made[model_file]

    def __init__(self, model_file: str, memory: int = 250_000) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = self.library.vocab_size()
        self.ids, self.cost, self.bytes = {}, {}, {}
        for i in range(size):
            piece = self.library.id_to_piece(i)
            if self.library.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i)):
                self.ids[piece], self.cost[piece] = i, -self.library.get_score(i)
        pairs = {(x, y) for piece in self.ids for x, y in zip(piece, piece[1:], strict=False)}
        self.lone = [c for c in "\n\t\r" if not any(c in p for p in pairs)]
        if any(x != MARK and y == MARK for x, y in pairs):
            self.lone = []
            self.segments = re.compile("(?s).+")
        else:
            alone = re.escape("".join(self.lone))
            self.segments = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else ""))
        self.cuts = "\n" in self.lone
        self.memory, self.words, self.known, self.differ = memory, {}, {}, set()
        self.decimal = [str(i) for i in range(size)]
        self._number_symbols(size)

    def _number_symbols(self, size: int) -> None:
        """Symbols as numbers: a piece's id, or a number of its own for a character that only longer pieces hold."""
        number = dict(self.ids)
        for c in sorted({c for piece in self.ids for c in piece} - self.ids.keys()):
            number[c] = size + len(number)
        self.radix = max(number.values(), default=0) + 1
        self.of_char = np.full(0x110000, -1, np.int64)
        for c, k in number.items():
            if len(c) == 1:
                self.of_char[ord(c)] = k
        by_cost = {c: k for k, c in enumerate(sorted(set(self.cost.values())))}
        joins = [
            (number[piece[:k]] * self.radix + number[piece[k:]], by_cost[self.cost[piece]], i)
            for piece, i in self.ids.items()
            for k in range(1, len(piece))
            if piece[:k] in number and piece[k:] in number
        ]
        table = np.array(sorted(joins) or [(-1, 0, 0)], np.int64)
        self.pair, self.pair_rank, self.pair_joined = (np.ascontiguousarray(table[:, k]) for k in range(3))

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair in the table of pairs, -1 for a pair that no piece joins."""
        key = left * self.radix + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((self.pair[at] == key) & (left >= 0) & (right >= 0), at, -1)

    def merge_together(self, segments: list[str]) -> list[list[int]]:
        """The ids of segments by their agendas, one merge of each segment a round.

        A segment's agenda is a slice of ``agenda``: for each symbol the rank of the pair that it begins, then its place,
        so that the slice's least entry is the best pair, the leftmost of equals.
        """
        symbol = self.of_char[np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)]
        n = len(symbol)
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        end = np.cumsum(size)
        start = end - size
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[end - 1], before[start] = n, n  # n: no neighbour
        symbol = np.append(symbol, -1)
        join = np.append(self._look_up(symbol[:-1], symbol[after[:-1]]), -1)
        place = np.arange(n + 1)
        agenda = np.where(join >= 0, self.pair_rank[join] << 32 | place, NONE)
        alive = np.ones(n + 1, bool)
        for _ in range(int(size.max()) - 1):
            best = np.minimum.reduceat(agenda[:n], start)
            i = best[best != NONE] & 0xFFFFFFFF
            if not len(i):
                break
            j = after[i]
            symbol[i], alive[j], agenda[j], symbol[j] = self.pair_joined[join[i]], False, NONE, -1
            after[i] = k = after[j]
            before[k] = i  # that of the end mark is never read
            h = before[i]
            for x, y in ((i, k), (h, i)):
                join[x] = found = self._look_up(symbol[x], symbol[y])
                agenda[x] = np.where(found >= 0, self.pair_rank[found] << 32 | x, NONE)
            agenda[n] = NONE
        left = symbol[:n][alive[:n]].tolist()
        upto = np.cumsum(np.add.reduceat(alive[:n].astype(np.int64), start)).tolist()
        return [left[a:b] for a, b in zip([0, *upto], upto, strict=False)]

    def merge(self, segment: str) -> list[int]:
        """The ids of one segment by the agenda."""
        symbols, cost = list(segment), self.cost
        n = len(symbols)
        agenda = [(c, i, i + 1, 2) for i in range(n - 1) if (c := cost.get(segment[i : i + 2])) is not None]
        if agenda:
            heapify(agenda)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            while agenda:
                _, i, j, size = heappop(agenda)
                left, right = symbols[i], symbols[j]
                # an entry is out of date if either side has since been merged or has grown
                if not left or not right or len(left) + len(right) != size:
                    continue
                left += right
                symbols[i], symbols[j] = left, ""
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                    if (c := cost.get(left + symbols[k])) is not None:
                        heappush(agenda, (c, i, k, size + len(symbols[k])))
                k = before[i]
                if k >= 0 and (c := cost.get(symbols[k] + left)) is not None:
                    heappush(agenda, (c, k, i, size + len(symbols[k])))
        out: list[int] = []
        for s in symbols:
            if s in self.ids:
                out.append(self.ids[s])
            elif s and self.bytes:
                out.extend(self.bytes[b] for b in s.encode())
            elif s:
                out.append(self.library.unk_id())
        return out

    def learn(self, segments: list[str]) -> list[bytes]:
        """Encodes new segments, as packed ids, and checks them against the library."""
        together = [k for k, s in enumerate(segments) if len(s) <= TOGETHER]
        merged: list[list[int] | None] = [None] * len(segments)
        if together:
            for k, ids in zip(together, self.merge_together([segments[k] for k in together]), strict=True):
                merged[k] = ids if min(ids) >= 0 and max(ids) < len(self.decimal) else None
        # a text begins with a word mark; a segment that has none is encoded after a lone character
        lead = self.lone[0] if self.lone else ""
        marked = [s[0] == MARK for s in segments]
        plain = [s[1:].replace(MARK, " ") if m else lead + s for s, m in zip(segments, marked, strict=True)]
        skip = len(self.library.encode(lead)) if lead else 0
        out = []
        for s, ids, exact, m in zip(segments, merged, self.library.encode(plain, num_threads=1), marked, strict=True):
            if ids is None:
                ids = self.merge(s)
            if s != MARK and (m or lead) and ids != (exact if m else exact[skip:]):
                self.differ.add(s)
            # packed ids are small, and nothing that the garbage collector has to follow
            out.append(array("I", ids).tobytes())
        return out

    def split(self, text: str) -> tuple[list[str], bool]:
        """The segments of a text; true: they are words, each with a word mark before it but after a line feed."""
        single = text.replace("\n", " \n") if self.cuts else ""
        if single and "  " not in single and MARK not in text and single[0] != " " and single[-1] != " ":
            return single.split(" "), True
        return self.segments.findall(MARK + text.replace(" ", MARK)) if text else [], False

    def encode_all(self, texts: list[str]) -> Iterator[tuple[list[int], str, bool]]:
        """Of each text: the ids, the same as decimals joined by commas, whether the library agrees."""
        split = [self.split(text) for text in texts]
        for plain, known in ((True, self.words), (False, self.known)):
            all_found = [found for found, words in split if words == plain]
            new = set().union(*(set(found).difference(known) for found in all_found))
            if len(known) + len(new) > self.memory:
                kept = {s: known[s] for s in set().union(*all_found).difference(new)}
                known.clear()
                known.update(kept)
            order = sorted(new)  # any order would do; this one makes runs alike
            known.update(zip(order, self.learn([MARK + s if plain and s[0] != "\n" else s for s in order]), strict=True))
        decimal = self.decimal
        for found, plain in split:
            known = self.words if plain else self.known
            agrees = not self.differ or self.differ.isdisjoint(found) and self.differ.isdisjoint([MARK + s for s in found])
            ids = np.frombuffer(b"".join([known[s] for s in found]), np.uint32).tolist()
            yield ids, ",".join([decimal[i] for i in ids]), agrees

    def encode(self, text: str) -> tuple[list[int], str]:
        return next(self.encode_all([text]))[:2]


def encode_decode(docs: DataFrame, model_file: str, *, key: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: the key, n_tokens, ids_sha256, decoded_sha256, library_agrees.

    ``keep_ids`` adds ``ids`` (array<int>) and ``decoded``.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    extra = [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] if keep_ids else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec.of(model_file)
        for batch in text_batches(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n, ids_sha, text_sha, agrees, all_ids, all_text = [], [], [], [], [], []
            for ids, joined, same in codec.encode_all(texts):
                agrees.append(same)
                decoded = codec.library.decode(ids)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                if keep_ids:
                    all_ids.append(np.array(ids, np.int32))  # a tenth of a list's memory
                    all_text.append(decoded)
            columns = [batch.column(key), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha), pa.array(agrees)]
            columns += [pa.array(all_ids, extra[0][1]), pa.array(all_text, pa.string())] if keep_ids else []
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n_tokens", "ids_sha256", "decoded_sha256", "library_agrees", *[n for n, _ in extra]])

    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, library_agrees boolean"
    schema += ", ids array<int>, decoded string" if keep_ids else ""
    return docs.select(key, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
