"""Texts as the pieces a word tokenizer works on, with each distinct piece worked on once per slice.

The rules are those of ``word_bpe_49k.json``: NFC, lower case, then contractions, letter runs,
single digits and runs of anything else but white space. Texts whose characters all lie below
U+0300 are cut with array operations on their bytes; other texts by the same pattern.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from fieldgauge.llm import flat

PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")

_GAP, _LETTER, _NUMBER, _OTHER = range(4)


def _kind(c: str) -> int:
    if regex.match(r"\p{White_Space}", c):
        return _GAP
    return {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(c)[0], _OTHER)


_KIND = np.array([_kind(chr(i)) for i in range(0x300)], np.uint8)


def normal(text: str) -> str:
    """NFC and lower case, character by character."""
    return "".join(map(str.lower, unicodedata.normalize("NFC", text)))


def cut(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, begin and end of all pieces, first piece of each row (n + 1), and which rows were cut by pattern."""
    array = pc.fill_null(array, "") if array.null_count else array
    data, at = flat.texts(pc.utf8_lower(array))
    odd = np.zeros(len(array), bool)
    high = np.flatnonzero(data >= 0xCC)
    odd[np.searchsorted(at, high, "right") - 1] = True
    raw, raw_at = flat.texts(array)
    dotted = np.flatnonzero((raw[:-1] == 0xC4) & (raw[1:] == 0xB0))
    odd[np.searchsorted(raw_at, dotted, "right") - 1] = True
    if odd.any():
        plain = array.to_pylist()
        rows = [" ".join(PATTERN.findall(normal(plain[i]))) if odd[i] else "" for i in range(len(plain))]
        spaced, spaced_at = flat.texts(pa.array(rows, pa.large_string()))
        clean, clean_at = flat.texts(pc.if_else(pa.array(odd), "", pc.utf8_lower(array)))
        begin, end, first = _runs(clean, clean_at)
        s, e, f = flat.words(spaced, spaced_at)
        begin, end = np.concatenate([begin, s + len(clean)]), np.concatenate([end, e + len(clean)])
        row = np.concatenate([np.repeat(np.arange(len(odd)), np.diff(first)), np.repeat(np.arange(len(odd)), np.diff(f))])
        order = np.argsort(row, kind="stable")
        return np.concatenate([clean, spaced]), begin[order], end[order], first + f, odd
    begin, end, first = _runs(data, at)
    return data, begin, end, first, odd


def _runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(data):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(len(at), int)
    kind = _KIND[np.minimum(data, 0x7F)]
    lead = np.flatnonzero(data >= 0xC2)
    kind[lead] = kind[lead + 1] = _KIND[((data[lead].astype(np.int64) & 0x1F) << 6) | (data[lead + 1] & 0x3F)]
    fresh = np.ones(len(data), bool)
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[at[:-1][at[:-1] < len(data)]] = True
    fresh |= (kind == _NUMBER) & ((data & 0xC0) != 0x80)
    begin = np.flatnonzero(fresh)
    end = np.append(begin[1:], len(data))
    # an apostrophe alone between other kinds takes the contraction that follows it
    quote = np.flatnonzero((data[begin] == 0x27) & (end - begin == 1) & (kind[begin] == _OTHER))
    quote = quote[quote + 1 < len(begin)]
    row_end = at[np.searchsorted(at, begin[quote], "right")]
    quote = quote[(end[quote] < row_end) & (kind[np.minimum(end[quote], len(data) - 1)] == _LETTER)]
    for i in quote:
        tail = data[end[i] : min(end[i] + 2, end[i + 1])].tobytes()
        took = next((len(c) for c in CONTRACTIONS if tail.startswith(c)), 0)
        end[i] += took
        begin[i + 1] += took
    keep = (kind[np.minimum(begin, len(data) - 1)] != _GAP) & (begin < end)
    begin, end = begin[keep], end[keep]
    return begin, end, np.searchsorted(begin, at)


class Memo:
    """Values of distinct byte strings, kept from slice to slice in two generations of bounded size.

    When the younger one is full it becomes the older one, and what the older one held is forgotten
    unless it was asked for meanwhile.
    """

    def __init__(self, many: Callable[[list[bytes]], Sequence], limit: int = 150_000):
        self.many, self.limit, self.held, self.older = many, limit, {}, {}

    def look(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[list, np.ndarray]:
        """Values of the distinct pieces, and which of them each piece is."""
        key = flat.slice_hash(flat.prefix_hash(data), begin, end)
        order = np.argsort(key)
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[order][1:] != key[order][:-1]
        which = np.empty(len(key), np.int64)
        which[order] = np.cumsum(fresh) - 1
        one = order[fresh]
        raw = data.tobytes()
        strings = [raw[b:e] for b, e in zip(begin[one].tolist(), end[one].tolist())]
        held, older = self.held, self.older
        missing = []
        for s in strings:
            if s not in held:
                if s in older:
                    held[s] = older[s]
                else:
                    missing.append(s)
        held.update(zip(missing, self.many(missing)))
        out = [held[s] for s in strings]
        if len(held) > self.limit:
            self.held, self.older = {}, held
        return out, which


def spread(values: list[bytes], which: np.ndarray, width: type = np.uint32) -> tuple[np.ndarray, np.ndarray]:
    """All values of the pieces in order, given as packed numbers, and how many of them each piece has."""
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // np.dtype(width).itemsize
    at = np.cumsum(sizes) - sizes
    n = sizes[which]
    total = np.cumsum(n)
    joined = np.frombuffer(b"".join(values), width)
    place = np.repeat(at[which] - (total - n), n) + np.arange(int(total[-1]) if len(total) else 0)
    return joined[place], n
