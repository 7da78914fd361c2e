"""Hierarchical packing into several context sizes.

Every run of tokens (a whole document, or what is left of one after its full windows) is routed to
the tier of the smallest context that holds it. Windows of a tier are opened by its own runs; the gap
behind a run is filled with the longest run of the shorter tiers that fits, again and again, and the
last gap with the head of a run that is cut. So every closed window is exactly full.

The work is done in two passes without moving texts. First each task packs the rows it reads, holding
a bounded number of waiting tokens, and writes its pieces; what its last windows could not close it
writes with its tokens. The rest, less than a few windows per task, is packed again in groups of
tasks, until one group is left. There the last windows are cut at powers of two, which need no
padding, down to the smallest tier.

Defined cases: null text is empty and packs as its end token alone; repeated rows are packed each;
long texts are cut at full windows; an empty table gives no rows; other columns are ignored. A retry
packs the same rows to the same places.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldgauge.llm import flat, pieces
from fieldgauge.session import cut

WINDOW = 4096
TIERS = (512, 1024, 2048, 4096)
END_TOKEN = 2
WAITING = 1 << 20
GROUP = 64  # tasks whose rests are packed together
STEP_TOKENS = 1 << 19

SCHEMA = (
    "`{key}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
    "`offset` bigint, tier int, step_group string, rest binary"
)


class Encoder:
    """Token ids of texts by a word tokenizer; each distinct piece is encoded once per slice."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.special = [t["content"].encode() for t in file["added_tokens"]]
        self.tokenizer = Tokenizer.from_file(path)
        last = np.zeros(max(file["model"]["vocab"].values()) + 1, bool)
        last[[i for w, i in file["model"]["vocab"].items() if w.endswith("</w>")]] = True
        self.last = last
        self.memo = pieces.Memo(self._many)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _many(self, strings: list[bytes]) -> list[bytes]:
        """Pieces encoded as one text; each ends with a token that closes a word."""
        out: list[bytes] = []
        for i in range(0, len(strings), 4096):
            some = strings[i : i + 4096]
            ids = self._ids(b" ".join(some).decode())
            cut_at = np.flatnonzero(self.last[ids]) + 1
            if len(cut_at) == len(some):
                packed, at = ids.tobytes(), [0, *(4 * cut_at).tolist()]
                out += [packed[a:b] for a, b in zip(at, at[1:])]
            else:
                out += [self._ids(s.decode()).tobytes() for s in some]
        return out

    def rows(self, array: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a slice. Texts with special strings or odd letters go through the tokenizer whole."""
        data, begin, end, first, odd = pieces.cut(array)
        raw, at = flat.texts(array)
        raw = raw.tobytes()
        for s in self.special:
            found = raw.find(s)
            while found >= 0:
                odd[np.searchsorted(at, found, "right") - 1] = True
                found = raw.find(s, found + 1)
        values, which = self.memo.look(data, begin, end)
        ids, n = pieces.spread(values, which)
        to = np.append(0, np.cumsum(n))[first]
        for i in range(len(array)):
            yield self._ids(raw[at[i] : at[i + 1]].decode()) if odd[i] else ids[to[i] : to[i + 1]]


class Packer:
    """Runs in, pieces out. A run is (document, start, doc_tokens, ids)."""

    def __init__(self, task: int):
        self.task = task
        self.closed = dict.fromkeys(TIERS, 0)
        self.runs: dict[int, list[tuple]] = {}
        self.lengths: list[int] = []
        self.waiting = 0
        self.out: list[tuple] = []

    def add(self, run: tuple) -> None:
        doc, start, total, ids = run
        while len(ids) >= WINDOW:
            self._place([(doc, start, total, ids[:WINDOW])], WINDOW)
            start, ids = start + WINDOW, ids[WINDOW:]
        if len(ids):
            self._wait((doc, start, total, ids))
        if self.waiting >= WAITING:
            self.drain(WAITING // 2)

    def _wait(self, run: tuple) -> None:
        n = len(run[3])
        if n not in self.runs:
            insort(self.lengths, n)
            self.runs[n] = []
        self.runs[n].append(run)
        self.waiting += n

    def _take(self, most: int) -> tuple | None:
        """The longest waiting run of at most this length."""
        i = bisect_right(self.lengths, most) - 1
        if i < 0:
            return None
        n = self.lengths[i]
        run = self.runs[n].pop()
        if not self.runs[n]:
            del self.runs[n], self.lengths[i]
        self.waiting -= n
        return run

    def drain(self, until: int) -> None:
        """Close windows, the longest runs first, while more than ``until`` tokens wait."""
        while self.waiting > until and self.lengths:
            tier = next(t for t in TIERS if self.lengths[-1] <= t)
            if self.waiting < tier:
                return
            self._fill(tier)

    def _fill(self, size: int) -> None:
        held, gap = [], size
        while gap:
            run = self._take(gap)
            if run is None:  # all that wait are longer: the shortest gives its head
                doc, start, total, ids = self._take(self.lengths[0])
                held.append((doc, start, total, ids[:gap]))
                self._wait((doc, start + gap, total, ids[gap:]))
                gap = 0
            else:
                held.append(run)
                gap -= len(run[3])
        self._place(held, size)

    def _place(self, runs: list[tuple], size: int) -> None:
        """A closed window; steps take equally many windows of one tier, so each has ``STEP_TOKENS``."""
        tier = size if size in self.closed else WINDOW
        sequence = (self.task << 32) + sum(self.closed.values())
        step = f"{tier}:{self.task}:{self.closed[tier] * tier // STEP_TOKENS}"
        self.closed[tier] += 1
        offset = 0
        for doc, start, total, ids in runs:
            crc = zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
            self.out.append((doc, start, len(ids), crc, total, sequence, offset, tier, step, None))
            offset += len(ids)

    def close(self) -> None:
        """What cannot fill a window of its tier leaves with its tokens."""
        self.drain(0)
        while (run := self._take(WINDOW)) is not None:
            doc, start, total, ids = run
            self.out.append((doc, start, len(ids), 0, total, None, None, None, None, np.ascontiguousarray(ids, "<u4").tobytes()))

    def finish(self) -> None:
        """The very last windows: the largest power of two each time; below the smallest tier one window."""
        self.drain(0)
        while self.waiting:
            self._fill(next((t for t in reversed(TIERS) if t <= self.waiting), self.waiting))

    def batch(self, names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
        rows, self.out = self.out, []
        columns = list(zip(*rows)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _types(key: pa.DataType) -> list[pa.DataType]:
    return [key, *[pa.int64()] * 6, pa.int32(), pa.string(), pa.binary()]


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all rows: ``key, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group``."""
    kind = docs.schema[key].dataType.simpleString()
    schema = SCHEMA.format(key=key, kind=kind)
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group", "rest"]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, types = Encoder(path), Packer(TaskContext.get().partitionId()), None
        for batch in batches:
            types = _types(batch.column(0).type)
            for part in flat.slices(batch, 1):
                for doc, ids in zip(part.column(0).to_pylist(), encoder.rows(part.column(1))):
                    packer.add((doc, 0, len(ids) + 1, np.append(ids, np.uint32(END_TOKEN))))
                yield packer.batch(names, types)
        if types:
            packer.close()
            yield packer.batch(names, types)

    def again(last: bool, level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer, types = Packer((level << 24) + TaskContext.get().partitionId()), None
            for batch in batches:
                types = _types(batch.column(0).type)
                for row in batch.to_pylist():
                    packer.add((row[key], row["start"], row["doc_tokens"], np.frombuffer(row["rest"], "<u4")))
                yield packer.batch(names, types)
            if types:
                packer.finish() if last else packer.close()
                yield packer.batch(names, types)

        return run

    packed = cut(docs.select(key, text).mapInArrow(first, schema).withColumn("task", F.spark_partition_id()), "pieces")
    done, rest, level = packed.where("rest IS NULL").drop("task", "rest"), packed.where("rest IS NOT NULL"), 1
    tasks = rest.agg(F.max("task")).first()[0]
    while tasks is not None:
        groups = tasks // GROUP + 1
        # the rests are cut ids of the tasks before, few and small, whatever the size of the input
        dealt = rest.withColumn("task", F.floor(F.col("task") / GROUP).cast("int"))
        dealt = dealt.repartitionByRange(groups, "task").sortWithinPartitions("task", F.desc("length"), key, "start", "doc_tokens", "rest")
        moved = dealt.drop("task").mapInArrow(again(groups == 1, level), schema).withColumn("task", F.spark_partition_id())
        moved = cut(moved, "rests")
        done = done.unionByName(moved.where("rest IS NULL").drop("task", "rest"))
        if groups == 1:
            break
        rest, level = moved.where("rest IS NOT NULL"), level + 1
        tasks = rest.agg(F.max("task")).first()[0]
    return done
