r"""Benchmark decontamination in DataFrame expressions only: a broadcast hash set of test windows meets every training window.

Words are the maximal runs of digits, letters a-z after lower-casing A-Z, and characters beyond ASCII.
A window is ``n`` consecutive words of an item; an item with fewer words is one window of all it has.
The 64-bit hash of each window of a text is looked up in the set, a match is verified word by word, and
every word inside a verified window is hit. The lookup is part of one scan: a text leaves it as one row
with its number of words, and one row per hit.

The set is measured before it is broadcast. Beyond ``SET_BYTES`` the same lookup is a join that shuffles
both sides by the hash, with the same result.

Defined cases: a null or wordless text has no words and no hits; a null or wordless item has no windows;
items are told apart by their ids as text, a null id counts as the empty id, rows with one id are one
item; repeated rows are counted each; texts of any length are scanned whole; empty tables give no rows or
no hits; columns that are not named are carried by ``scrub`` and ignored elsewhere.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldgauge.session import cut

N = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# A word of a text that was not lower-cased with the gap before it, or the gap after the last word.
PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# The hash set is broadcast up to this size, reckoned as WINDOW_BYTES and its text per window.
SET_BYTES = 64 << 20
WINDOW_BYTES = 320


class Windows(NamedTuple):
    """``grams`` ``(hash, gram, wid)`` once each, ``owners`` ``(wid, item)``, the window lengths, and whether both are small."""

    grams: DataFrame
    owners: DataFrame
    lengths: list[int]
    small: bool


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def windows(items: DataFrame, key: str = "item_id", text: str = "text", n: int = N, bound: int = SET_BYTES) -> Windows:
    rows = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("_w")).where(F.size("_w") > 0)
    length = F.least(F.lit(n), F.size("_w"))
    every = rows.select("item", "_w", length.alias("_n"), F.explode(F.sequence(F.lit(1), F.size("_w") - length + 1)).alias("_at"))
    gram = F.slice("_w", F.col("_at"), F.col("_n"))
    # words hold no blank, so the joined text names the window
    owners = cut(every.select("item", gram.alias("gram")).select("item", "gram", F.sha2(F.array_join("gram", " "), 256).alias("wid")).distinct(), "windows")
    grams = owners.groupBy("wid").agg(F.first("gram").alias("gram")).select(F.xxhash64("gram").alias("hash"), "gram", "wid")
    held = owners.groupBy(F.size("gram").alias("n")).agg(F.sum(F.octet_length(F.array_join("gram", " ")) + F.octet_length("item") + WINDOW_BYTES).alias("bytes")).collect()
    return Windows(grams, owners.select("wid", "item"), sorted(r["n"] for r in held), sum(r["bytes"] for r in held) <= bound)


def _hits(docs: DataFrame, key: str, text: str, found: Windows) -> DataFrame:
    """``(_row, key, n_words, at, end, wid)``: a row per text with ``at`` 0, and a row per verified window."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("key"), words(F.col(text)).alias("_w"))
    rows = rows.select("_row", "key", "_w", F.explode(F.sequence(F.lit(0), F.size("_w"))).alias("at"))
    if len(found.lengths) > 1:
        each = F.when(F.col("at") > 0, F.array(*map(F.lit, found.lengths))).otherwise(F.array(F.lit(0)))
        rows = rows.select("*", F.explode(each).alias("_n"))
    else:
        rows = rows.withColumn("_n", F.lit(found.lengths[0] if found.lengths else 1))
    gram = F.slice("_w", F.greatest("at", F.lit(1)), F.col("_n"))
    fits = (F.col("at") > 0) & (F.col("at") + F.col("_n") <= F.size("_w") + 1)
    # rows without a window get a spread key, as null keys would meet in one task of a shuffled join
    rows = rows.withColumn("_fits", fits).withColumn("_hash", F.when(F.col("_fits"), F.xxhash64(gram)).otherwise(F.xxhash64("_row", "at")))
    grams = F.broadcast(found.grams) if found.small else found.grams.hint("merge")
    same = (F.col("_hash") == F.col("hash")) & F.col("_fits") & (gram == F.col("gram"))
    met = rows.join(grams, same, "left").where((F.col("at") == 0) | F.col("wid").isNotNull())
    return met.select("_row", "key", F.size("_w").cast("bigint").alias("n_words"), "at", (F.col("at") + F.col("_n")).alias("end"), "wid")


def spans(docs: DataFrame, found: Windows, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, n_hit, spans, wids`` for every row.

    ``spans`` are the hit runs as (begin, end) in words from 1, end exclusive, in order; ``wids`` the
    windows that occur. All of it happens where the row's hits lie after one shuffle of hits.
    """
    hits = _hits(docs, key, text, found)
    real = F.col("at") > 0
    order = Window.partitionBy("_row").orderBy("at")
    before = F.max(F.when(real, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = hits.withColumn("_opens", F.when(real & (F.coalesce(before, F.lit(0)) < F.col("at")), 1).otherwise(0))
    runs = opened.withColumn("_run", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    span = runs.groupBy("_row", "_run").agg(
        F.first("key").alias("key"), F.first("n_words").alias("n_words"), F.min("at").alias("begin"), F.max("end").alias("end"),
        F.collect_set("wid").alias("wids"),
    )
    here = F.when(F.col("begin") > 0, F.struct("begin", "end"))
    return span.groupBy("_row").agg(
        F.first("key").alias(key), F.first("n_words").alias("n_words"),
        F.coalesce(F.sum(F.when(F.col("begin") > 0, F.col("end") - F.col("begin"))), F.lit(0)).cast("bigint").alias("n_hit"),
        F.sort_array(F.collect_list(here)).alias("spans"), F.array_distinct(F.flatten(F.collect_list("wids"))).alias("wids"),
    )


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", n: int = N, bound: int = SET_BYTES) -> DataFrame:
    """``key, n_words, n_hit, spans, items, contaminated`` for every row; ``items`` are ids as text, sorted."""
    found = windows(items, item_key, n=n, bound=bound)
    seen = spans(docs, found, key, text)
    owners = F.broadcast(found.owners) if found.small else found.owners
    named = seen.select("*", F.explode_outer("wids").alias("wid")).drop("wids").join(owners, "wid", "left")
    return named.groupBy("_row").agg(
        F.first(key).alias(key), F.first("n_words").alias("n_words"), F.first("n_hit").alias("n_hit"), F.first("spans").alias("spans"),
        F.sort_array(F.collect_set("item")).alias("items"),
    ).drop("_row").withColumn("contaminated", F.col("n_hit") > 0)


def without(text: Column, hit: Column) -> Column:
    """The text without its hit words and the gaps before them."""
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    starts = F.concat(F.array(F.lit(1)), F.transform(hit, lambda s: s["end"]))
    stops = F.concat(F.transform(hit, lambda s: s["begin"]), F.array(F.size(pieces) + 1))
    kept = F.flatten(F.zip_with(starts, stops, lambda a, b: F.slice(pieces, a, F.greatest(b - a, F.lit(0)))))
    return F.array_join(kept, "")


def scrub(docs: DataFrame, items: DataFrame, remove: str = "spans", text: str = "text", item_key: str = "item_id", n: int = N, bound: int = SET_BYTES) -> DataFrame:
    """``docs`` without hit spans, or without the documents that have any; all columns stay.

    Equal texts have equal spans, so what is found is kept once per text and only that small table meets
    the documents again.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove={remove!r}: spans or documents")
    named = docs.withColumn("_text_key", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    seen = spans(named.select("_text_key", text), windows(items, item_key, n=n, bound=bound), "_text_key", text)
    hit = cut(seen.where(F.col("n_hit") > 0).select("_text_key", F.col("spans").alias("_spans")).dropDuplicates(["_text_key"]), "spans")
    if remove == "documents":
        return named.join(hit.select("_text_key"), "_text_key", "left_anti").select(*docs.columns)
    left = named.join(hit, "_text_key", "left")
    clean = F.when(F.col("_spans").isNull(), F.col(text)).otherwise(without(F.col(text), F.col("_spans")))
    return left.withColumn(text, clean).select(*docs.columns)
