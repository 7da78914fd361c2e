"""Queries of the dealt operators over their whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldgauge.llm import chat, covertree, jaccard, langid, leaks, merkle, packing, quality, repeats, unigram, whitening, wordpiece, wrapper
from fieldgauge.session import ship_package

TABLE: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register ``(spark, sf_dir) -> DataFrame`` under the function's name."""

    def keep(fn):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf)

        TABLE[fn.__name__] = run
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return keep


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


@query(r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest([w[i:i + 4] FOR i IN range(1, len(w) - 3)]) AS g FROM d),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d),
dup AS (SELECT doc_id, sum(n - 1)::BIGINT AS n FROM (SELECT doc_id, l, count(*) AS n FROM ln
        WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id, l) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        len(string_split(text, chr(10)))::BIGINT AS n_lines,
        coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
        len([x FOR x IN w IF regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]')])::BIGINT AS n_capital_words
      FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, ((n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
        + 8 * (10 * n_dup_lines > 3 * n_lines)::BIGINT + 16 * (2 * n_capital_words > n_words)::BIGINT
        + 32 * (word_chars > 20 * n_words)::BIGINT + 64 * (word_chars < 2 * n_words)::BIGINT)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capital_words, failed_bits,
    failed_bits & 3 <> 0 AS base_failed, failed_bits & 127 = 0 AS kept FROM b
""")
def op1_quality_rules(spark, sf):
    book = quality.ledger(read(spark, sf, "documents"))
    judged = quality.judge(quality.judge(book, quality.BASE, "_base"), quality.POLICIES["v2"])
    return judged.withColumn("base_failed", ~F.col("_base")).drop("_base")


@query(r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, 12 + length(regexp_replace(role, '[\\#<:]', 'xx', 'g')) + length(regexp_replace(text, '[\\#<]', 'xx', 'g')) + 2 AS n,
    lag(role) OVER w AS b, lead(1) OVER w IS NULL AS z FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
v AS (SELECT *, (role = 'system' AND b IS NULL) OR (role = 'user' AND (b IS NULL OR b IN ('system', 'assistant')))
    OR (role = 'assistant' AND coalesce(b = 'user', false)) AS ok FROM e)
SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(n)::BIGINT AS formatted_chars, bool_and(ok AND (NOT z OR role = 'assistant')) AS valid
FROM v GROUP BY conv_id
""")
def op2_chat_formatting(spark, sf):
    probe = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"),
    )
    rows = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    whole = chat.join_turns(chat.format_turns(rows)).withColumn("_turns", chat.parse(F.col("formatted")))
    back = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = chat.unescape(F.col("trained"))
    return whole.select(
        "conv_id", F.size("_turns").cast("bigint").alias("n_turns"), F.sha2(back, 256).alias("turns_sha256"),
        F.length(trained).cast("bigint").alias("loss_chars"), F.sha2(trained, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"), "valid",
    )


def tokenizer_file(name: str) -> str:
    """Where the public vocabulary files lie."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op3_token_counts(spark, sf):
    automaton = wordpiece.word_end_automaton(tokenizer_file("word_bpe_49k.json"))
    return wordpiece.token_counts(read(spark, sf, "documents"), automaton)


@query()
def op7_packing(spark, sf):
    return packing.pack(read(spark, sf, "documents"), tokenizer_file("word_bpe_49k.json"))


@query()
def op10_sentencepiece(spark, sf):
    return unigram.digest(read(spark, sf, "documents"), unigram.from_model_file(tokenizer_file("piece_bpe_32k.model")))


@query()
def op4_language_id(spark, sf):
    docs = read(spark, sf, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.predict(docs, model).withColumn("held_out", langid.held_out())


@query()
def op5_embedding_near_dedup(spark, sf):
    return covertree.near_duplicates(read(spark, sf, "embeddings"))


@query()
def op6_html_extraction(spark, sf):
    return wrapper.extract(read(spark, sf, "pages")).drop("wrapper")


@query()
def op9_suffix_array_dedup(spark, sf):
    left = repeats.remove_repeats(read(spark, sf, "documents"), ["doc_id"])
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("rest", 256).alias("kept_sha256"))


@query()
def op8_ngram_jaccard_join(spark, sf):
    found = jaccard.join(read(spark, sf, "documents"))
    return found.withColumn("kept", F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True)))


# crc32 of the decimal digits: each byte is one exclusive-or and eight shifts
_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten([[ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]
    FOR x IN string_split(doc_id::VARCHAR, '')])), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"""


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


@query(f"""
WITH RECURSIVE d AS (SELECT *, sha256({' || '.join(map(_field, merkle.FIELDS))}) AS leaf, {_field('doc_id')} || {_field('source')} || {_field('lang')} AS a,
    CASE WHEN doc_id IS NOT NULL AND {_CRC32} % 7 = 0 THEN n_chars::HUGEINT + 1 ELSE n_chars END AS m FROM documents),
l AS (SELECT doc_id, lang, leaf, sha256(a || {_field('m')} || {_field('text')}) AS claim,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
t AS (SELECT lang, 0 AS lvl, pos, leaf AS h FROM l UNION ALL
    SELECT lang, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM t) WHERE n > 1
    GROUP BY lang, lvl, pos // 2),
s AS (SELECT lang, arg_max(h, lvl) AS h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank FROM t GROUP BY lang),
u AS (SELECT 0 AS lvl, rank AS pos, h FROM s UNION ALL
    SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM u) WHERE n > 1 GROUP BY lvl, pos // 2),
top AS (SELECT h AS root, lvl FROM u ORDER BY lvl DESC LIMIT 1),
high AS (SELECT lang, max(lvl) AS lvl FROM t GROUP BY lang),
p AS (SELECT l.lang, l.pos, g.lvl, (l.pos >> g.lvl) & 1 AS slot, coalesce(b.h, '') AS h FROM l JOIN high k ON k.lang IS NOT DISTINCT FROM l.lang
    JOIN (SELECT DISTINCT lvl FROM t) g ON g.lvl < k.lvl LEFT JOIN t b ON b.lang IS NOT DISTINCT FROM l.lang AND b.lvl = g.lvl AND b.pos = xor(l.pos >> g.lvl, 1)
  UNION ALL SELECT l.lang, l.pos, k.lvl + g.lvl, (s.rank >> g.lvl) & 1, coalesce(b.h, '') FROM l JOIN high k ON k.lang IS NOT DISTINCT FROM l.lang
    JOIN s ON s.lang IS NOT DISTINCT FROM l.lang CROSS JOIN top JOIN (SELECT DISTINCT lvl FROM u) g ON g.lvl < top.lvl LEFT JOIN u b ON b.lvl = g.lvl AND b.pos = xor(s.rank >> g.lvl, 1)),
q AS (SELECT lang, pos, list(slot ORDER BY lvl) AS slots, list(h ORDER BY lvl) AS hs, count(*) AS n FROM p GROUP BY lang, pos),
f AS (SELECT l.lang, l.pos, 0 AS lvl, l.claim AS h, q.slots, q.hs, coalesce(q.n, 0) AS n FROM l LEFT JOIN q ON q.lang IS NOT DISTINCT FROM l.lang AND q.pos = l.pos UNION ALL
    SELECT lang, pos, lvl + 1, sha256(CASE WHEN slots[lvl + 1] = 1 THEN hs[lvl + 1] || h ELSE h || hs[lvl + 1] END), slots, hs, n FROM f WHERE lvl < n)
SELECT l.doc_id, l.leaf, s.h AS subroot, top.root, sha256(coalesce(array_to_string(f.hs, ''), '')) AS proof_sha256, f.h AS folded_root, f.h = top.root AS verified
FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang CROSS JOIN top JOIN f ON f.lang IS NOT DISTINCT FROM l.lang AND f.pos = l.pos AND f.lvl = f.n
""")
def op13_merkle_manifest(spark, sf):
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    told = F.when(tampered, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars"))
    held = merkle.manifest(read(spark, sf, "documents"), claimed={"n_chars": told})
    folded = held.withColumn("folded_root", merkle.fold(F.col("claim"), F.col("path")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query(rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{leaks.UPPER}', '{leaks.LOWER}'), '{leaks.WORD}') AS w FROM documents),
b AS (SELECT item_id, w, least({leaks.N}, len(w)) AS k FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{leaks.UPPER}', '{leaks.LOWER}'),
    '{leaks.WORD}') AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
dw AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM b))),
hit AS (SELECT r, i, k, g FROM dw SEMI JOIN bw USING (k, g)),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
own AS (SELECT r, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT r, item_id FROM hit JOIN bw USING (k, g)) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(cov.n, 0)::BIGINT AS n_hit, coalesce(own.n, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(cov.n, 0) > 0 AS contaminated FROM d LEFT JOIN cov USING (r) LEFT JOIN own USING (r)
""")
def op12_benchmark_decontamination(spark, sf):
    seen = leaks.contamination(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
    return seen.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


@query()
def op11_embedding_whitening(spark, sf):
    vectors = read(spark, sf, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors))
