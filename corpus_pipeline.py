"""The corpus pipeline: rules, language, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet
in the shared folder and reads it again as the next stage's documents. All stages but the last return
the columns of documents. No stage reads labels: what it decides follows from the texts it is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldgauge.llm import jaccard, langid, packing, quality, queries, repeats
from fieldgauge.session import cut, ship_package

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.4


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the newest policy rejects; null texts fail."""
    ship_package(spark)
    book = quality.ledger(docs, carry=COLUMNS[1:])
    return quality.judge(book, quality.POLICIES["v2"]).where("kept").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned, by a score of at least ``LEAST_SCORE``; the prediction becomes ``lang``."""
    ship_package(spark)
    model = langid.fit(docs.where(~langid.held_out()))
    said = langid.predict(docs, model, carry=("text", "source", "n_chars"))
    good = said.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return good.withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links tie together: the one with the smallest id, a null id last.

    Every row is a document of its own, so rows with a null id or with one id and different texts are
    compared and kept like others; equal rows are copies. Rows without a word link with nothing and
    stay, each of them. Nulls in other columns are values like any.
    """
    ship_package(spark)
    rows = cut(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64(*COLUMNS[1:]).alias("rest"), "row")
    found = jaccard.join(rows, key="row").join(rows.select("row", rank.alias("rank")), "row")
    first = found.groupBy("class_id").agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias("row"))
    return rows.join(first, "row", "left_semi").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur elsewhere; a letter that lost some of its bytes goes whole. Empty rests stay."""
    ship_package(spark)
    left = repeats.remove_repeats(docs, ["doc_id", "lang", "source"], decoded=True)
    return left.select("doc_id", F.col("rest").alias("text"), "lang", "source", F.length("rest").cast("bigint").alias("n_chars"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of several context sizes."""
    ship_package(spark)
    return packing.pack(docs, queries.tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("packing", pack_documents),
]

ORACLE_SQL = None  # a fitted model and a join by MinHash have no SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
