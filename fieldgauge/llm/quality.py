"""Rule bitmask ledger: measure once, keep failure bits, judge by versioned policies.

``ledger`` reads every text once and returns its measurements and one integer whose bit i says
that rule i fails. Policies are masks over these bits: applying another version, or asking what a
rule alone costs, never touches a text again.

Defined cases: a null or blank text has no words and fails ``few_words``; repeated rows give
repeated rows; an empty table gives an empty ledger; other columns of the input are ignored.
Word windows and lines are compared within a text by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldgauge.llm import flat

WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capital_words")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL condition over the measurements."""

    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """The rules whose failure rejects a document."""

    version: str
    rules: tuple[str, ...]


RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("capitals", "2 * n_capital_words > n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
)
BASE = Policy("base", ("few_words", "repeated_words"))
POLICIES = {
    p.version: p
    for p in (BASE, Policy("v1", BASE.rules + ("symbols", "duplicate_lines")), Policy("v2", tuple(r.name for r in RULES)))
}


def measure(texts: pa.Array) -> list[np.ndarray]:
    """The columns of ``MEASURES`` for one slice of texts."""
    data, at = flat.texts(texts)
    starts, ends, first = flat.words(data, at)
    n_words = np.diff(first)
    prefix = flat.prefix_hash(data)

    word = flat.slice_hash(prefix, starts, ends)
    row = np.repeat(np.arange(len(n_words)), n_words)
    salt = flat.mix(np.arange(1, len(n_words) + 1, dtype=np.uint64))
    windows = np.flatnonzero(row[WINDOW - 1 :] == row[: len(row) - WINDOW + 1]) if len(row) >= WINDOW else np.zeros(0, int)
    key = salt[row[windows]]
    for j in range(WINDOW):
        key = flat.mix(key + word[windows + j])
    again = windows[flat.repeated(key)[0]]
    covered = np.zeros(len(word), bool)
    for j in range(WINDOW):
        covered[again + j] = True

    inner = np.flatnonzero(data == 10) + 1
    # a line belongs to the row of the break before it, also when it begins where that row ends
    of_line = np.concatenate([np.arange(len(n_words)), np.searchsorted(at, inner - 1, "right") - 1])
    begin = np.concatenate([at[:-1], inner])
    order = np.lexsort((begin, of_line))
    begin, of_line = begin[order], of_line[order]
    end = np.append(begin[1:] - 1, at[-1])
    last = np.append(of_line[1:] != of_line[:-1], True)
    end[last] = at[1:]
    filled = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end, line_row = begin[filled], end[filled], of_line[filled]
    later = flat.repeated(flat.mix(salt[line_row] + flat.slice_hash(prefix, begin, end)))[1]

    inside = ~flat.GAPS[data] & ((data & 0xC0) != 0x80)
    upper = flat.sums(_UPPER[data], np.append(starts, len(data)))
    lower = flat.sums(_LOWER[data], np.append(starts, len(data)))
    return [
        n_words,
        flat.sums(inside, at),
        flat.sums(_SYMBOL[data], at),
        np.bincount(of_line, minlength=len(n_words)),
        np.bincount(line_row[later], minlength=len(n_words)),
        flat.sums(covered, first),
        flat.sums((upper > 0) & (lower == 0), first),
    ]


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the ``carry`` columns, the measurements and ``failed_bits`` of every row: one pass, no shuffle."""
    own = {c: docs.schema[c].dataType.simpleString() for c in (key, *carry)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.slices(batch, 0):
                found = [pa.array(m.astype(np.int64)) for m in measure(part.column(0))]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *found], names=[*own, *MEASURES])

    schema = ", ".join([f"`{c}` {kind}" for c, kind in own.items()] + [f"{m} bigint" for m in MEASURES])
    measured = docs.select(F.col(text).alias("_text"), *own).mapInArrow(run, schema)
    bits = sum((F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, r in enumerate(rules)), F.lit(0).cast("bigint"))
    return measured.withColumn("failed_bits", bits)


def mask(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    names = [r.name for r in rules]
    return sum(1 << names.index(r) for r in policy.rules)


def judge(ledger: DataFrame, policy: Policy, name: str = "kept", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add the verdict of one policy version."""
    return ledger.withColumn(name, F.col("failed_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("bigint")) == 0)


def ablate(ledger: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of the policy: rows that fail it, rows that fail nothing else, rows kept without it.

    Rows are counted by bit pattern first, so what is shuffled and expanded is at most one row per
    pattern and task.
    """
    whole = mask(policy, rules)
    patterns = (
        ledger.select(F.col("failed_bits").bitwiseAND(F.lit(whole).cast("bigint")).alias("bits"))
        .groupBy("bits").agg(F.count(F.lit(1)).alias("n"))
    )
    named = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("bigint").alias("bit")) for i, r in enumerate(rules) if r.name in policy.rules])
    rows = patterns.select("bits", "n", F.inline(named))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    rest = F.col("bits").bitwiseAND(F.lit(whole).cast("bigint") - F.col("bit")) == 0
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint")
    return rows.groupBy("rule").agg(
        count(hit).alias("n_failed"), count(hit & rest).alias("n_only"), count(rest).alias("n_kept_without")
    ).withColumn("policy", F.lit(policy.version))
