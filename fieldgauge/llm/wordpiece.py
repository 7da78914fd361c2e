"""Token counts by a linear longest-match automaton.

The vocabulary becomes a trie; every node has a failure link and the number of pieces that are
popped when the link is taken. Reading a word moves down the trie or along links, so a word costs
steps in proportion to its length, and no piece is ever built: only counts are added.

For a node whose string is a piece the link leads to the root of continuations and pops one piece.
Otherwise the links of its parent are followed until one has the wanted child, and what they pop is
added up.

Defined cases: null and empty texts have no words and no tokens; a word with a stretch that no piece
matches counts as one unknown token; repeated rows give repeated rows; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldgauge.llm import flat, pieces

END = "\0"


class Automaton:
    """Counts greedy longest-match pieces of words.

    ``first`` are pieces that may begin a word, ``later`` those that may follow; with one set for both
    give it twice. ``ended`` adds ``END`` to each word, for vocabularies that mark the last piece.
    """

    def __init__(self, first: Iterable[str], later: Iterable[str], ended: bool = False):
        first, later = set(first), set(later)
        self.ended = ended
        self.children: list[dict[str, int]] = [{}]
        self.start, self.rest = 0, 0
        piece = self._add(self.start, first)
        if first != later:
            self.rest = self._node()
            piece |= self._add(self.rest, later)
        n = len(self.children)
        self.link, self.pops = [-1] * n, [0] * n
        queue = [(self.start, c, v) for c, v in self.children[self.start].items()]
        if self.rest != self.start:
            queue += [(self.rest, c, v) for c, v in self.children[self.rest].items()]
        for u, c, v in queue:  # grows as it is read: nodes in order of depth
            if v in piece:
                self.link[v], self.pops[v] = self.rest, 1
            else:
                z, popped = self.link[u], self.pops[u]
                while z >= 0 and c not in self.children[z]:
                    popped += self.pops[z]
                    z = self.link[z]
                if z >= 0:
                    self.link[v], self.pops[v] = self.children[z][c], popped
            queue += [(v, d, w) for d, w in self.children[v].items()]

    def _node(self) -> int:
        self.children.append({})
        return len(self.children) - 1

    def _add(self, root: int, words: set[str]) -> set[int]:
        ends = set()
        for word in sorted(words):
            at = root
            for c in word:
                if c not in self.children[at]:
                    self.children[at][c] = self._node()
                at = self.children[at][c]
            if at != root:
                ends.add(at)
        return ends

    def count(self, word: str) -> int:
        """Number of pieces of one word; 1 if it has a stretch without a piece."""
        children, link, pops = self.children, self.link, self.pops
        at, n = self.start, 0
        for c in word + END if self.ended else word:
            while c not in children[at]:
                if link[at] < 0:
                    return 1
                n += pops[at]
                at = link[at]
            at = children[at][c]
        while at not in (self.rest, self.start):
            if link[at] < 0:
                return 1
            n += pops[at]
            at = link[at]
        return n


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


def word_end_automaton(path: str) -> Automaton:
    """From a byte-level vocabulary file whose last pieces end in ``</w>``."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    known = {v.removesuffix("</w>") + END * v.endswith("</w>") for v in vocabulary}
    return Automaton(known, known, ended=True)


def token_counts(docs: DataFrame, automaton: Automaton, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, n_tokens`` of every row: one pass, no shuffle."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(automaton)  # of the size of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, letter = shared.value.count, byte_letters()
        memo = pieces.Memo(lambda many: [counts("".join(map(letter.__getitem__, s))) for s in many])
        for batch in batches:
            for part in flat.slices(batch, 1):
                data, begin, end, first, _ = pieces.cut(part.column(1))
                values, which = memo.look(data, begin, end)
                n = np.append(0, np.cumsum(np.array(values, np.int64)[which]))
                found = [pa.array(np.diff(first).astype(np.int64)), pa.array(np.diff(n[first]))]
                yield pa.RecordBatch.from_arrays([part.column(0), *found], names=[key, "n_words", "n_tokens"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_words bigint, n_tokens bigint")
