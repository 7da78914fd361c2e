"""SentencePiece-style encoding by Viterbi over a double-array trie, and decoding.

A space is written as the white-space marker and one is put in front, so words are the stretches that
begin with markers; no piece crosses from one word to the next, so each distinct word is solved once
per slice. The best split of a word maximises the sum of the log scores of its pieces. A character
that no single-character piece covers costs more than any piece and is written as one byte piece per
byte. A literal marker in a text is also written as bytes, so decoding gives every text back exactly.

Scores: a vocabulary whose scores are merge ranks holds no probabilities; rank r then counts as
Zipf's log(1 / (r + 2)), ranks being in order of frequency. Pieces marked as unused (score of -1e9 in
the file, runs of markers) get the lowest score. Equal sums prefer the longer last piece.

Defined cases: null and empty texts give no ids and decode to the empty text; repeated rows give
repeated rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldgauge.llm import flat, pieces

MARKER = "▁"
UNKNOWN_COST = 10.0
LONG_WORD = 256  # bytes; the longest word sets the number of steps that words take side by side
SIDE_BYTES = 1 << 17


class DoubleArray:
    """A trie over bytes in two arrays: child of s by byte c is base[s] + c + 1 where check of it is s."""

    def __init__(self, words: Sequence[bytes]):
        tree: dict = {}
        for i, w in enumerate(words):
            at = tree
            for c in w:
                at = at.setdefault(c, {})
            at[-1] = i
        self.base, self.check, self.value = [0], [-2], [-1]
        self.free: list[int] = []  # slots below the end, tried from the last; bounded by what stays unused
        queue = [(0, tree)]
        for state, node in queue:  # grows as it is read
            self.value[state] = node.get(-1, -1)
            codes = sorted(c + 1 for c in node if c >= 0)
            self.base[state] = base = self._fit(codes) if codes else -1
            for c in codes:
                self.check[base + c] = state
                queue.append((base + c, node[c - 1]))
        del self.free

    def _fit(self, codes: list[int]) -> int:
        """A base that puts all codes on unused slots: one of the last unused ones, else behind the end."""
        check = self.check
        base = max(len(check) - codes[0], 0)
        for k in range(len(self.free) - 1, max(-1, len(self.free) - 33), -1):
            b = self.free[k] - codes[0]
            if b >= 0 and all(b + c >= len(check) or check[b + c] == -1 for c in codes):
                base = b
                break
        used, end = {base + c for c in codes}, base + codes[-1] + 1
        if end > len(check):
            self.free += range(len(check), end)
            for held, empty in ((self.base, 0), (check, -1), (self.value, -1)):
                held += [empty] * (end - len(held))
        tail = bisect_left(self.free, base + codes[0])
        self.free[tail:] = [f for f in self.free[tail:] if f not in used]
        return base

    def prefixes(self, text: bytes, begin: int) -> Iterator[tuple[int, int]]:
        """(end, word) of every word that starts at ``begin``."""
        base, check, value, state = self.base, self.check, self.value, 0
        for i in range(begin, len(text)):
            if base[state] < 0:
                return
            to = base[state] + text[i] + 1
            if to >= len(check) or check[to] != state:
                return
            state = to
            if value[state] >= 0:
                yield i + 1, value[state]


class Unigram:
    """``scored`` are (piece, log score, id) with the marker for a space; ``byte_ids`` the id of each byte piece."""

    def __init__(self, scored: Sequence[tuple[str, float, int]], byte_ids: Sequence[int]):
        if any(MARKER in p.lstrip(MARKER) for p, _, _ in scored):
            raise ValueError("a piece crosses from one word to the next")
        self.words = [p.replace(MARKER, " ").encode() for p, _, _ in scored]
        self.score = [s for _, s, _ in scored]
        self.id = [i for _, _, i in scored]
        self.byte_ids = list(byte_ids)
        self.trie = DoubleArray(self.words)
        self.unknown = min(self.score, default=0.0) - UNKNOWN_COST
        t = self.trie
        self.arrays = (
            np.array(t.base, np.int64), np.append(t.check, np.full(257, -1)), np.array(t.value, np.int64),
            np.array([*self.score, self.unknown]), np.array(self.id, np.int64), np.array(self.byte_ids, np.int64),
        )
        self.bytes_of = {i: w for i, w in zip(self.id, self.words)} | {b: bytes([v]) for v, b in enumerate(byte_ids)}

    def best(self, word: bytes) -> tuple[list[int], float]:
        """Ids of the best split of one word, and its score."""
        n, trie, score = len(word), self.trie, self.score
        base, check, value, slots = trie.base, trie.check, trie.value, len(trie.check)
        total, back = [-math.inf] * (n + 1), [(0, -1)] * (n + 1)
        total[0] = 0.0
        for i in range(n):
            here = total[i]
            if here == -math.inf:
                continue
            b = word[i]
            step = i + (1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4)
            single, state = False, 0
            for end in range(i, n):
                to = base[state] + word[end] + 1
                if to >= slots or check[to] != state:
                    break
                state = to
                w = value[to]
                if w >= 0:
                    end += 1
                    if end == step:
                        single = True
                    if here + score[w] > total[end]:
                        total[end] = here + score[w]
                        back[end] = (i, w)
                if base[to] < 0:
                    break
            if not single and here + self.unknown > total[step]:
                total[step], back[step] = here + self.unknown, (i, -1)
        ids, at = [], n
        while at:
            i, w = back[at]
            ids += [self.id[w]] if w >= 0 else [self.byte_ids[c] for c in reversed(word[i:at])]
            at = i
        return ids[::-1], total[n]

    def best_many(self, words: Sequence[bytes]) -> list[bytes]:
        """Ids as ``best`` finds them, as packed 32-bit numbers: words side by side, longer ones one by one."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out = [b""] * len(words)
        for i in np.flatnonzero(sizes > LONG_WORD).tolist():
            out[i] = np.array(self.best(words[i])[0], np.uint32).tobytes()
        short = np.flatnonzero(sizes <= LONG_WORD)
        stop = np.cumsum(sizes[short])
        for some in np.split(short, np.searchsorted(stop, np.arange(SIDE_BYTES, int(stop[-1]) if len(stop) else 0, SIDE_BYTES))):
            for i, ids in zip(some.tolist(), self._side_by_side([words[i] for i in some.tolist()])):
                out[i] = ids
        return out

    def _side_by_side(self, words: list[bytes]) -> list[bytes]:
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        stop = np.cumsum(size)
        word = np.repeat(np.arange(len(words)), size)
        # edges of the lattice: the pieces that begin at each character, found by one walk down the trie for all
        base, check, value, score, ids, byte_ids = self.arrays
        letters = np.flatnonzero((data & 0xC0) != 0x80)
        width = np.diff(np.append(letters, len(data)))
        step, alone = np.zeros(len(data), np.int64), np.zeros(len(data), bool)
        step[letters], alone[letters] = letters + width, True
        found, begin, at, state = [], letters, letters, np.zeros(len(letters), np.int64)
        while len(begin):
            to = base[state] + data[at] + 1
            on = check[to] == state
            begin, at, state = begin[on], at[on] + 1, to[on]
            hit = value[state] >= 0
            found.append((begin[hit], at[hit], value[state[hit]]))
            on = at < stop[word[begin]]
            begin, at, state = begin[on], at[on], state[on]
        for b, e, _ in found:
            alone[b[e == step[b]]] = False
        lone = np.flatnonzero(alone)
        found.append((lone, step[lone], np.full(len(lone), -1)))
        begin, end, piece = (np.concatenate(x) for x in zip(*found))
        gain = score[piece]  # the last one is that of an unknown character
        # relax by place in the word; edges that begin at one place end at different ones
        place = begin - (stop - size)[word[begin]]
        order = np.argsort(place, kind="stable")
        begin, end, piece, gain = begin[order], end[order], piece[order], gain[order]
        source, target = begin + word[begin], end + word[begin]
        first, last = stop - size + np.arange(len(words)), stop + np.arange(len(words))
        total, back = np.full(len(data) + len(words), -np.inf), np.full(len(data) + len(words), -1)
        total[first] = 0.0
        bounds = np.append(0, np.cumsum(np.bincount(place))).tolist()
        for a, b in zip(bounds, bounds[1:]):
            sums, to = total[source[a:b]] + gain[a:b], target[a:b]
            better = np.flatnonzero(sums > total[to])
            total[to[better]], back[to[better]] = sums[better], a + better
        chosen, node = [], last[size > 0]
        while len(node):
            edge = back[node]
            chosen.append(edge)
            node = source[edge]
            node = node[node != first[word[begin[edge]]]]
        edge = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
        # an id stands where its piece begins, byte pieces stand on their bytes
        placed = np.full(len(data), -1, np.int64)
        known = edge[piece[edge] >= 0]
        placed[begin[known]] = ids[piece[known]]
        other = edge[piece[edge] < 0]
        for k in range(4):
            spot = begin[other] + k
            spot = spot[spot < end[other]]
            placed[spot] = byte_ids[data[spot]]
        kept = placed >= 0
        packed = placed[kept].astype(np.uint32).tobytes()
        to = 4 * np.append(0, np.cumsum(np.bincount(word[kept], minlength=len(words))))
        return [packed[a:b] for a, b in zip(to.tolist(), to[1:].tolist())]

    def encode(self, text: str) -> list[int]:
        data, at = flat.texts(pa.array([text]))
        raw, begin, end, _ = words(data, at)
        raw = raw.tobytes()
        return [i for b, e in zip(begin.tolist(), end.tolist()) for i in self.best(raw[b:e])[0]]

    def decode(self, ids: Sequence[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:].decode(errors="replace")


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Non-empty rows with a space in front; begin and end of their words; first word of each row (n + 1)."""
    filled = at[:-1] < at[1:]
    spaced = np.insert(data, at[:-1][filled], 0x20)
    to = at + np.append(0, np.cumsum(filled))
    fresh = spaced == 0x20
    fresh[1:] &= spaced[:-1] != 0x20
    fresh[to[:-1][filled]] = True
    begin = np.flatnonzero(fresh)
    return spaced, begin, np.append(begin[1:], len(spaced))[: len(begin)], np.searchsorted(begin, to)


def from_model_file(path: str) -> Unigram:
    """Pieces of a SentencePiece file with merge ranks as scores, under Zipf's law."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    bytes_, scored, unused = {}, [], []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            bytes_[int(piece[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i)):
            (unused if model.get_score(i) <= -1e9 else scored).append((piece, i, model.get_score(i)))
    ranked = [(p, -math.log(r + 2.0), i) for r, (p, i, _) in enumerate(sorted(scored, key=lambda x: -x[2]))]
    low = min(s for _, s, _ in ranked)
    return Unigram(ranked + [(p, low, i) for p, i, _ in unused], [bytes_[b] for b in range(256)])


def encode_decode(docs: DataFrame, model: Unigram, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids, decoded`` of every row: one pass, no shuffle."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of the size of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver = Solver(shared.value)
        for batch in batches:
            for part in flat.slices(batch, 1):
                ids, n = solver.rows(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(n, pa.int32()), pa.array(ids, pa.int32())), solver.texts(ids, n)],
                    names=[key, "ids", "decoded"],
                )

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded string")


def digest(docs: DataFrame, model: Unigram, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``encode_decode``, but counts and check sums instead of the ids: ``n_ids, n_byte_ids, ids_crc32, exact``."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver = Solver(shared.value)
        for batch in batches:
            for part in flat.slices(batch, 1):
                ids, at = solver.rows(part.column(1))
                bytes_ = flat.sums(solver.is_byte[ids], at)
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                got, want = flat.texts(solver.texts(ids, at)), flat.texts(part.column(1))
                raw_got, raw_want = got[0].tobytes(), want[0].tobytes()
                exact = [raw_got[a:b] == raw_want[c:d] for a, b, c, d in zip(got[1][:-1], got[1][1:], want[1][:-1], want[1][1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(at)), pa.array(bytes_), pa.array(crc, pa.int64()), pa.array(exact)],
                    names=[key, "n_ids", "n_byte_ids", "ids_crc32", "exact"],
                )

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_ids bigint, n_byte_ids bigint, ids_crc32 bigint, exact boolean")


class Solver:
    """Encoding and decoding of slices in a task."""

    def __init__(self, model: Unigram):
        self.memo = pieces.Memo(model.best_many)
        size = max(model.bytes_of) + 1
        self.is_byte = np.zeros(size, bool)
        self.is_byte[model.byte_ids] = True
        self.letters = [model.bytes_of.get(i, b"") for i in range(size)]

    def rows(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows and the n + 1 offsets between them."""
        data, begin, end, first = words(*flat.texts(array))
        values, which = self.memo.look(data, begin, end)
        ids, n = pieces.spread(values, which)
        return ids.astype(np.int64), np.append(0, np.cumsum(n))[first]

    def texts(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """Markers back to spaces, byte pieces to their bytes, the space in front taken off."""
        data, n = pieces.spread(self.letters, ids, np.uint8)
        to = np.append(0, np.cumsum(n))[at]
        filled = to[:-1] < to[1:]
        data = np.delete(data, to[:-1][filled])
        to = to - np.append(0, np.cumsum(filled))
        return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(data.tobytes())).cast(pa.string())
