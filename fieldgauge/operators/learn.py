"""Learners and scoring that run as Spark sums: closed-form linear, data-parallel MLP, batch scoring."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldgauge.functions.arrow import append, to_lists, to_matrix, widened
from fieldgauge.functions.ranking import hash_key
from fieldgauge.functions.sums import add_blocks
from fieldgauge.functions.vectors import doubles
from fieldgauge.operators.basis import DRIVER_SIDE
from fieldgauge.session import cut

STRIP = 64


def score(df: DataFrame, col: str, model: Callable[[np.ndarray], np.ndarray], output: str = "pred") -> DataFrame:
    """Append ``model(matrix)`` for a fixed model, one call per Arrow batch; the model is shipped once."""
    share = df.sparkSession.sparkContext.broadcast(model)
    schema = widened(df.schema, [output])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = to_matrix(batch.column(batch.schema.get_field_index(col)))
                yield append(batch, {output: to_lists(np.asarray(share.value(x)))})

    return df.mapInArrow(run, schema)


def in_subsample(seed: int, key: Sequence[str], fraction: float):
    """True for the rows a seed trains on: a stable hash rule, the same in every engine."""
    # eight lower-case hex digits compare as text in the order of their number
    below = int(np.ceil(fraction * 2.0**32))
    head = F.substring(hash_key(seed, *key), 1, 8)
    return F.lit(True) if below >= 1 << 32 else head < F.lit(f"{below:08x}")


class Linear(NamedTuple):
    """x ↦ xW + b."""

    weights: np.ndarray
    bias: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


def normal_equations(pairs: DataFrame, x: str, y: str, groups: dict[int, object]) -> DataFrame:
    """Strips of Σ[x 1]ᵀ[x 1 y] over the rows of each group: ``(grp, strip, n, seg)``.

    ``groups`` maps a number to a row condition; a row may be in several groups and is read and
    shipped once. Every task emits one record per group and strip.
    """
    numbers = list(groups)

    def run(batches):
        held: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            xs, ys = to_matrix(batch.column(0)), to_matrix(batch.column(1))
            design = np.hstack([xs, np.ones((len(xs), 1))])
            right = np.hstack([design, ys])
            for i, number in enumerate(numbers):
                at = batch.column(2 + i).to_numpy(zero_copy_only=False)
                n, old = held.get(number, (0, 0.0))
                held[number] = (n + int(at.sum()), old + design[at].T @ right[at])
        for number, (n, m) in held.items():
            for s, lo in enumerate(range(0, len(m), STRIP)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int32()), pa.array([s], pa.int32()), pa.array([n], pa.int64()),
                     to_lists(m[lo : lo + STRIP].reshape(1, -1))],
                    names=["grp", "strip", "n", "seg"],
                )

    marks = [groups[g].alias(f"_g{i}") for i, g in enumerate(numbers)]
    parts = pairs.select(doubles(x).alias("_x"), doubles(y).alias("_y"), *marks).mapInArrow(
        run, "grp int, strip int, n bigint, seg array<double>"
    )
    return add_blocks(parts, ["grp", "strip"], ["seg"])


def fit_linear(
    pairs: DataFrame, x: str, y: str, seeds: Sequence[int], key: Sequence[str], fraction: float = 0.8,
    ridge: float = 1e-6,
) -> dict[int, Linear]:
    """One multi-output ridge model per seed, each on its own hash subsample, from one pass.

    The bias is not penalised. Only (D+1)×(D+1+K) sums reach the driver.
    """
    first = pairs.select(F.size(x).alias("d"), F.size(y).alias("k")).first()
    d, k = first["d"], first["k"]
    if d + 1 > DRIVER_SIDE:
        raise ValueError(f"D={d} exceeds the driver bound {DRIVER_SIDE}")
    sums = {int(s): np.zeros((d + 1, d + 1 + k)) for s in seeds}
    groups = {int(s): in_subsample(s, key, fraction) for s in seeds}
    for r in normal_equations(pairs, x, y, groups).toLocalIterator():
        seg = np.asarray(r["seg"]).reshape(-1, d + 1 + k)
        sums[r["grp"]][r["strip"] * STRIP : r["strip"] * STRIP + len(seg)] = seg
    out = {}
    for s, m in sums.items():
        n = m[d, d]
        if not n:
            raise ValueError(f"seed {s} has no training rows")
        penalty = ridge * n * np.eye(d + 1)
        penalty[d, d] = 0.0
        solved = np.linalg.solve(m[:, : d + 1] + penalty, m[:, d + 1 :])
        out[s] = Linear(solved[:d], solved[d])
    return out


def predict_by_seed(df: DataFrame, col: str, models: dict[int, Linear], output: str = "pred") -> DataFrame:
    """One row per (row, seed) with the seed's prediction."""
    seeds = sorted(models)
    spread = df.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    share = df.sparkSession.sparkContext.broadcast(models)
    schema = widened(spread.schema, [output])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = to_matrix(batch.column(batch.schema.get_field_index(col)))
            s = batch.column(batch.schema.get_field_index("seed")).to_numpy()
            out = None
            for seed in np.unique(s):
                part = share.value[int(seed)](x[s == seed])
                if out is None:
                    out = np.empty((len(x), part.shape[1]))
                out[s == seed] = part
            yield append(batch, {output: to_lists(out)})

    return spread.mapInArrow(run, schema)


# --------------------------------------------------------------------------------------- MLP


class Mlp(NamedTuple):
    """Fully connected layers with GELU between them; input and output are standardised."""

    layers: list[tuple[np.ndarray, np.ndarray]]
    scale: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        xm, xs, ym, ys = self.scale
        return forward(self.layers, (x - xm) / xs)[-1] * ys + ym


def gelu(z: np.ndarray) -> np.ndarray:
    return gelu_and_slope(z)[0]


def gelu_and_slope(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The activation and its derivative from one tanh; cubes are products, as NumPy's power is many times slower."""
    root, square = np.sqrt(2 / np.pi), z * z
    t = np.tanh(root * z * (1 + 0.044715 * square))
    return 0.5 * z * (1 + t), 0.5 * (1 + t) + 0.5 * z * (1 - t * t) * root * (1 + 3 * 0.044715 * square)


def forward(layers, x: np.ndarray) -> list[np.ndarray]:
    """Pre-activations of every layer; the last one is the output."""
    out, a = [], x
    for i, (w, b) in enumerate(layers):
        z = a @ w + b
        out.append(z)
        a = gelu(z) if i < len(layers) - 1 else z
    return out


def gradient(layers, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Flat gradient of the summed squared error, and that error."""
    acts, slopes = [x], []
    for w, b in layers[:-1]:
        a, slope = gelu_and_slope(acts[-1] @ w + b)
        acts.append(a)
        slopes.append(slope)
    gap = acts[-1] @ layers[-1][0] + layers[-1][1] - y
    delta, flat = 2 * gap, []
    for i in reversed(range(len(layers))):
        flat.append((acts[i].T @ delta, delta.sum(axis=0)))
        if i:
            delta = (delta @ layers[i][0].T) * slopes[i - 1]
    return np.concatenate([np.concatenate([w.ravel(), b]) for w, b in reversed(flat)]), float((gap * gap).sum())


def _unflatten(flat: np.ndarray, sizes: Sequence[int]):
    layers, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        w = flat[at : at + a * b].reshape(a, b)
        at += a * b
        layers.append((w, flat[at : at + b]))
        at += b
    return layers


def fit_mlp(
    train: DataFrame, validation: DataFrame, x: str, y: str, hidden: Sequence[int] = (256, 256),
    epochs: int = 200, patience: int = 20, min_delta: float = 1e-3, rate: float = 1e-3, seed: int = 0,
) -> tuple[Mlp, list[float]]:
    """Data-parallel full-batch Adam with the stopping rule; returns the kept model and the curve.

    Each step is one Spark job: weights go out by broadcast, tasks return one gradient sum each, and
    those are added in strips by a shuffle, so neither rows nor per-row gradients reach the driver.
    """
    spark = train.sparkSession
    sc = spark.sparkContext
    both = train.select(F.lit(True).alias("fit"), doubles(x).alias("x"), doubles(y).alias("y")).unionByName(
        validation.select(F.lit(False).alias("fit"), doubles(x).alias("x"), doubles(y).alias("y"))
    )
    both = cut(both, "pairs")
    from fieldgauge.functions.sums import vector_sums

    def moments(col):
        s = vector_sums(both.where("fit").select(col), [col], [], ["s", "ss"], lambda m: (m, m * m))
        pdf = s.toPandas().sort_values("j")
        mean = (pdf["s"] / pdf["n"]).to_numpy()
        var = (pdf["ss"] / pdf["n"]).to_numpy() - mean**2
        return mean, np.sqrt(np.maximum(var, 0.0)) + 1e-8

    (xm, xs), (ym, ys) = moments("x"), moments("y")
    scale = (xm, xs, ym, ys)
    sizes = [len(xm), *hidden, len(ym)]
    rng = np.random.default_rng(seed)
    layers = [(rng.standard_normal((a, b)) / np.sqrt(a), np.zeros(b)) for a, b in zip(sizes, sizes[1:])]
    flat = np.concatenate([np.concatenate([w.ravel(), b]) for w, b in layers])
    strip = 1 << 16

    def pass_over(flat):
        share = sc.broadcast((flat, scale))

        def run(batches):
            flat, (xm, xs, ym, ys) = share.value
            layers = _unflatten(flat, sizes)
            grad, n, held, m = np.zeros(len(flat)), 0, 0.0, 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                fit = batch.column(0).to_numpy(zero_copy_only=False)
                a = (to_matrix(batch.column(1)) - xm) / xs
                b = to_matrix(batch.column(2))
                if fit.any():
                    g, _ = gradient(layers, a[fit], (b[fit] - ym) / ys)
                    grad += g
                    n += int(fit.sum())
                if (~fit).any():
                    guess = forward(layers, a[~fit])[-1] * ys + ym
                    held += float(((guess - b[~fit]) ** 2).sum())
                    m += int((~fit).sum())
            padded = np.concatenate([grad, [held, float(m)]])
            for s, lo in enumerate(range(0, len(padded), strip)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s], pa.int32()), pa.array([n], pa.int64()),
                     to_lists(padded[None, lo : lo + strip])],
                    names=["strip", "n", "seg"],
                )

        parts = both.mapInArrow(run, "strip int, n bigint, seg array<double>")
        out, n = np.zeros(len(flat) + 2), 0
        for r in add_blocks(parts, ["strip"], ["seg"], tasks=1 + len(out) // strip).toLocalIterator():
            out[r["strip"] * strip : r["strip"] * strip + len(r["seg"])] = r["seg"]
            n = r["n"]
        share.unpersist()
        return out[:-2] / (n * sizes[-1]), out[-2] / (out[-1] * sizes[-1])

    m1, m2 = np.zeros_like(flat), np.zeros_like(flat)
    curve, best, kept, waited = [], None, flat, 0
    grad, _ = pass_over(flat)
    for step in range(1, epochs + 1):
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.999 * m2 + 0.001 * grad * grad
        flat = flat - rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        grad, val = pass_over(flat)
        curve.append(val)
        if best is None or (best - val) / best >= min_delta:
            best, kept, waited = val, flat, 0
        else:
            waited += 1
            if waited >= patience:
                break
    return Mlp(_unflatten(kept, sizes), scale), curve
