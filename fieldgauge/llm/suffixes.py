"""Suffix arrays by induced sorting, and permuted common prefixes, over arrays.

Suffixes are classified, the leftmost smaller ones are sorted by their substrings, which are named and
sorted in the same way as a shorter text until all names differ, and from their order all others are
induced in one pass each way.

Induction moves the suffixes of one bucket together where buckets are full, as in texts of bytes: a bucket
is emptied in waves, and a wave sends the predecessors of all its suffixes to their buckets at once; the
number of waves is the alphabet plus the longest run of one symbol. In the shorter texts of many names
buckets hold few suffixes, and a wave goes over as many buckets as it does not fill itself.
"""

from __future__ import annotations

import numpy as np

CROWDED = 64  # suffixes a bucket has on average from which on it is worth moving them together


def types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one. The end counts as smaller than any symbol."""
    n = len(t)
    change = np.flatnonzero(t[1:] != t[:-1])
    run_end = np.append(change, n - 1)
    up = np.append(t[change] < t[change + 1], False)
    return np.repeat(up, np.diff(np.append(-1, run_end)))


def _append(at: np.ndarray, t: np.ndarray, sa: np.ndarray, place: np.ndarray, step: int) -> None:
    """Put suffixes into the buckets of their first symbols, in order."""
    if not len(at):
        return
    symbol = t[at]
    order = np.argsort(symbol, kind="stable")
    symbol = symbol[order]
    first = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1]))
    size = np.diff(np.append(first, len(symbol)))
    rank = np.arange(len(symbol)) - np.repeat(first, size)
    sa[place[symbol] + step * rank] = at[order]
    place[symbol[first]] += step * size


def _sweep(sa: np.ndarray, heads: np.ndarray, to: np.ndarray) -> None:
    """Send the predecessors of all suffixes in ``sa`` to their buckets, from the first place to the last.

    ``to`` names the bucket of a suffix's predecessor, -1 for none and for an empty place. A wave takes as
    many places as come before the first one that it fills itself.
    """
    n, p, wide = len(sa), 0, 256
    while p < n:
        some = sa[p : p + wide]
        c = to[some]
        at = np.flatnonzero(c >= 0)
        stop = len(some)
        if len(at):
            order = at[np.argsort(c[at], kind="stable")]
            c = c[order]
            rank = np.arange(len(c))
            first = np.zeros(len(c), np.int64)
            first[1:] = np.where(c[1:] != c[:-1], rank[1:], 0)
            place = heads[c] + rank - np.maximum.accumulate(first)
            lowest = int(place.min())
            if lowest < p + stop:
                stop = lowest - p
                keep = order < stop
                order, c, place = order[keep], c[keep], place[keep]
            sa[place] = some[order] - 1
            heads[c] = place + 1  # of equal buckets the last one stays
        p += stop
        wide = min(8192, 2 * wide) if stop == len(some) else max(64, stop)


def induce_sparse(t: np.ndarray, up: np.ndarray, marked: np.ndarray, k: int) -> np.ndarray:
    """``induce`` for buckets of few suffixes: a wave goes over many buckets."""
    n = len(t)
    end = np.cumsum(np.bincount(t, minlength=k))
    larger, smaller = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
    larger[1:n] = np.where(up[:-1], -1, t[:-1])
    smaller[1:n] = np.where(up[:-1], t[:-1], -1)
    sa = np.full(n, -1, np.int64)
    _append(marked[::-1], t, sa, end - 1, -1)
    heads = end - np.bincount(t, minlength=k)
    _append(np.array([n - 1]), t, sa, heads, 1)
    _sweep(sa, heads, larger)
    _sweep(sa[::-1], n - end, smaller)
    return sa


def induce(t: np.ndarray, up: np.ndarray, marked: np.ndarray, k: int) -> np.ndarray:
    """All suffixes in order, given the marked ones (leftmost smaller) in order."""
    n = len(t)
    if n < CROWDED * k:
        return induce_sparse(t, up, marked, k)
    size = np.bincount(t, minlength=k)
    end = np.cumsum(size)
    begin = end - size
    sa = np.full(n, -1, np.int64)
    tails = end - 1
    _append(marked[::-1], t, sa, tails, -1)
    heads = begin.copy()
    _append(np.array([n - 1]), t, sa, heads, 1)
    for c in range(k):
        if not size[c]:
            continue
        done = begin[c]
        while done < heads[c]:
            some = sa[done : heads[c]]
            done = heads[c]
            before = some[some > 0] - 1
            _append(before[~up[before]], t, sa, heads, 1)
        some = sa[tails[c] + 1 : end[c]]
        before = some[some > 0] - 1
        _append(before[~up[before]], t, sa, heads, 1)
    tails = end - 1
    for c in range(k - 1, -1, -1):
        if not size[c]:
            continue
        done = end[c]
        while done > tails[c] + 1:
            some = sa[tails[c] + 1 : done][::-1]
            done = tails[c] + 1
            before = some[some > 0] - 1
            _append(before[up[before]], t, sa, tails, -1)
        some = sa[begin[c] : heads[c]][::-1]
        before = some[some > 0] - 1
        _append(before[up[before]], t, sa, tails, -1)
    return sa


def names(t: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers of the marked substrings, given in order: equal ones share a number. In text order."""
    n = len(t)
    place = np.sort(at)
    stop = np.append(place[1:], n - 1)
    length = stop[np.searchsorted(place, at)] - at + 1
    same = length[1:] == length[:-1]
    pair = np.flatnonzero(same)
    step = 0
    while len(pair):
        going = step < length[pair]
        pair = pair[going]
        differ = t[at[pair] + step] != t[at[pair + 1] + step]
        same[pair[differ]] = False
        pair = pair[~differ]
        step += 1
    last = np.flatnonzero(at + length == n)  # reaches the end: equal to no other
    same[last[last < len(same)]] = False
    same[last[last > 0] - 1] = False
    number = np.append(0, np.cumsum(~same))
    out = np.empty(n, np.int64)
    out[at] = number
    return out[place], int(number[-1]) + 1 if len(at) else 0


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """Suffixes of ``t`` (symbols below ``k``) in order."""
    if len(t) < 2:
        return np.arange(len(t))
    up = types(t)
    marked = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    if not len(marked):
        return induce(t, up, marked, k)
    is_marked = np.zeros(len(t), bool)
    is_marked[marked] = True
    rough = induce(t, up, marked, k)
    number, m = names(t, rough[is_marked[rough]])
    order = marked[suffix_array(number, m)] if m < len(marked) else marked[np.argsort(number)]
    return induce(t, up, order, k)


def shared_prefixes(t: np.ndarray, sa: np.ndarray, begin: np.ndarray, count: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For ``count[i]`` positions from ``begin[i]`` on: the suffix before in order, and the common prefix with it, up to ``most``.

    A prefix shrinks by one at most from a position to the next, so each run of positions is read once;
    all runs are read side by side, eight bytes at a time.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([t.astype(np.uint8), np.zeros(most + 16, np.uint8)])
    word = np.zeros(n + most + 8, np.uint64)
    for j in range(8):
        word |= padded[j : j + len(word)].astype(np.uint64) << np.uint64(8 * j)
    prefix = np.zeros(n, np.int32)
    order = np.argsort(-count, kind="stable")
    begin, count = begin[order], count[order]
    h = np.zeros(len(begin), np.int64)
    for k in range(int(count[0]) if len(count) else 0):
        live = int(np.searchsorted(-count, -k, "left"))
        i, h = begin[:live] + k, np.maximum(h[:live] - 1, 0)
        j = before[i]
        h[j < 0] = 0
        open_ = np.flatnonzero((j >= 0) & (h < most))
        while len(open_):
            x = word[i[open_] + h[open_]] ^ word[j[open_] + h[open_]]
            low = x & (~x + np.uint64(1))  # the lowest differing bit
            gain = np.where(x == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 8)
            h[open_] += gain
            open_ = open_[(x == 0) & (h[open_] < most)]
        # a match may not run over the end of the text
        h = np.minimum(h, np.minimum(most, n - np.maximum(i, j)))
        prefix[i] = h
    return before, prefix
