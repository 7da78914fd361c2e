"""The walk-field study: running sums of stored vectors, three synthetic dense learners, fixed DCT basis.

Fields are running sums of the embedding elements, so they have a decaying cosine spectrum. The
learner with seed s shrinks a field towards the mean and mixes in the field of row (pos+s+1) mod n.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldgauge.functions import ranking
from fieldgauge.functions.arrow import to_lists, to_matrix
from fieldgauge.functions.vectors import doubles
from fieldgauge.operators import basis as bases
from fieldgauge.operators.roles import role_of_rank
from fieldgauge.session import cut

SEEDS = (0, 1, 2)
LADDER = (2, 4, 8, 16, 32, 48, 64)


class Walk(NamedTuple):
    fields: DataFrame
    basis: DataFrame
    mean: np.ndarray
    n: int
    width: int


def running_sums(df: DataFrame, col: str) -> DataFrame:
    """Replace a vector by its running sums, a batch at a time."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                at = batch.schema.get_field_index(col)
                yield batch.set_column(at, col, to_lists(np.cumsum(to_matrix(batch.column(at)), axis=1)))

    return df.mapInArrow(run, df.schema)


def fields(spark: SparkSession, sf: str, holdout: bool = False) -> tuple[DataFrame, int]:
    """``(vec_id, label, pos, role, y)`` and the row count; roles are contiguous in vec_id order.

    60/20/20 train / selection / test, or train / holdout with ``holdout``.
    """
    raw = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", "embedding")
    n = raw.count()
    placed = ranking.ordered_position(raw, [], "vec_id", "pos", n=n)
    a, b = int(n * 0.6), int(n * 0.8)
    ranges = {"train": (0, a), "holdout": (a, n)} if holdout else {
        "train": (0, a), "selection": (a, b), "test": (b, n)
    }
    rows = placed.select("vec_id", "label", "pos", role_of_rank(ranges, F.col("pos")).alias("role"), doubles("embedding").alias("y"))
    return running_sums(rows, "y"), n


def study(spark: SparkSession, sf: str, holdout: bool = False) -> Walk:
    rows, n = fields(spark, sf, holdout)
    rows = cut(rows, "fields")
    mean = bases.mean_vector(rows.where("role = 'train'"), "y")
    return Walk(rows, bases.dct_basis(spark, len(mean)), mean, n, len(mean))


def predictions(walk: Walk) -> DataFrame:
    """``(seed, vec_id, label, pos, role, y, p)``: each row with the guess of every seed."""
    spread = walk.fields.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in SEEDS])))
    spread = spread.withColumn("_at", (F.col("pos") + F.col("seed") + 1) % walk.n)
    donor = walk.fields.select(F.col("pos").alias("_at"), F.col("y").alias("_other"))
    a = F.lit(0.6) + F.lit(0.1) * F.col("seed")
    # μ + a(y−μ) + (1−a)(y′−μ) = a·y + (1−a)·y′ because the weights add to one
    guess = F.zip_with("y", "_other", lambda u, v: a * u + (1 - a) * v)
    return spread.join(donor, "_at").select(
        "seed", "vec_id", "label", "pos", "role", "y", guess.alias("p")
    )
