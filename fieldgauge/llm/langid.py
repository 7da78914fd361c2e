"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character n-grams (1 to 3 letters, lower case, digits as one letter) are hashed into ``BUCKETS``.
Document frequencies are counted over all rows that may be learned from. The weights are fitted with
follow-the-regularised-leader steps, whose elastic net (L1 and L2) keeps most weights at exactly zero,
on a sample of at most ``SAMPLE`` rows, spread evenly over the languages and chosen by a hash of the
key; then one temperature is fitted on sampled rows that were kept out.

Defined cases: a text that is null or has no letter gets ``und`` with score 0; rows with a null label
or text are not learned from; with no row to learn from every text is ``und``; repeated rows
give repeated rows; an empty table gives no rows; other columns are ignored. Long texts are read
whole, a slice of letters at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldgauge.llm import flat

BUCKETS = 1 << 16
ORDERS = 3
SAMPLE = 4096
CALIBRATE_EVERY = 5
UNKNOWN = "und"
SCALE = 30.0  # lifts frequencies, which add up to one, to values of about one
PASSES = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.001
STRETCH = 1 << 19


@dataclass
class Model:
    """``weights`` are classes by buckets, inverse document frequencies included."""

    labels: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def letters(text: str) -> np.ndarray:
    """Code points in lower case; digits are one letter, white space is a blank."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    codes[(codes >= 48) & (codes < 58)] = 48
    codes[(codes < 33) | (codes == 0xA0)] = 32
    return codes


def grams(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of all n-grams, order by order."""
    h = codes * np.uint32(0x9E3779B1)
    joined = h
    for n in range(1, ORDERS + 1):
        if n > 1:
            joined = joined[:-1] * np.uint32(0x85EBCA6B) + h[n - 1 :]
        x = joined ^ (joined >> np.uint32(15))
        yield (x * np.uint32(0x2C1B3C6D)) >> np.uint32(16)


def stretches(codes: np.ndarray) -> Iterator[np.ndarray]:
    """The letters in overlapping parts; n-grams that lie wholly in the overlap are counted with the later part."""
    for i in range(0, max(len(codes) - ORDERS + 1, 1), STRETCH):
        yield codes[i : i + STRETCH + ORDERS - 1]


def counts(text: str) -> np.ndarray:
    """How often each bucket occurs in a text."""
    total = np.zeros(BUCKETS, np.int64)
    for part in stretches(letters(text)):
        for bucket in grams(part):
            total += np.bincount(bucket, minlength=BUCKETS)
    return total


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def document_frequency(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, over all rows; tasks send one sum per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                seen = np.zeros(BUCKETS, bool)
                for part in stretches(letters(t.as_py())):
                    for bucket in grams(part):
                        seen[bucket] = True
                found += seen
                n += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(found[at], n))], names=["bucket", "n"])

    rows = docs.select(text).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    table = rows.toPandas()  # at most BUCKETS + 1 rows
    df = np.zeros(BUCKETS, np.int64)
    real = table[table.bucket >= 0]
    df[real.bucket.to_numpy(np.int64)] = real.n.to_numpy(np.int64)
    return df, int(table[table.bucket < 0].n.sum())


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias after ``PASSES`` over rows of (buckets, values), each step one row."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))
    rng = np.random.Generator(np.random.PCG64(7))
    target = np.eye(classes)

    def weights(at: np.ndarray) -> np.ndarray:
        strong = np.abs(z[at]) > L1
        return np.where(strong, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    for _ in range(PASSES):
        for i in rng.permutation(len(rows)):
            at, x = np.append(rows[i][0], BUCKETS), np.append(rows[i][1], 1.0)
            w = weights(at)
            g = x[:, None] * (softmax(x @ w) - target[y[i]])[None, :]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    return w[:BUCKETS].T.copy(), w[BUCKETS].copy()


def fit_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section on its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(softmax(z / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()
    lo, hi, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(docs: DataFrame, label: str = "lang", key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """Learn from all rows given (frequencies) and a bounded, even sample of them (weights)."""
    known = docs.select(F.col(key).alias("k"), F.col(label).alias("l"), F.col(text).alias("t")).where("l IS NOT NULL AND t IS NOT NULL")
    sizes = {r["l"]: r["n"] for r in known.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    labels = sorted(sizes)
    if not labels:
        return Model([], np.zeros((0, BUCKETS)), np.zeros(0), 1.0)
    df, total = document_frequency(known, "t")
    idf = np.log((1 + total) / (1 + df)) + 1
    # a row is taken if its hash lies below its language's share; the limit only guards the bound
    share = F.lit(0.0)
    for name in labels:
        share = F.when(F.col("l") == name, min(1.0, 0.9 * sample / len(labels) / sizes[name])).otherwise(share)
    draw = F.pmod(F.xxhash64("k"), F.lit(1 << 20)) / float(1 << 20)
    taken = known.where(draw < share).select("l", "t", F.pmod(F.xxhash64(F.lit(1), "k"), F.lit(CALIBRATE_EVERY)).alias("c")).limit(sample)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = [], []
            for t in batch.column(1):
                n = counts(t.as_py())
                hit = np.flatnonzero(n)
                at.append(hit.astype(np.int32))
                x.append((n[hit] * idf[hit] * (SCALE / max(n.sum(), 1))).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(at, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float32()))],
                names=["l", "c", "at", "x"],
            )

    drawn = taken.mapInArrow(features, "l string, c bigint, at array<int>, x array<float>").toArrow()
    y = np.array([labels.index(v) for v in drawn.column("l").to_pylist()], int)
    rows = [(np.array(a.values), np.array(x.values, np.float64)) for a, x in zip(drawn.column("at"), drawn.column("x"))]
    order = np.lexsort(([float(x.sum()) for _, x in rows], [len(a) for a, _ in rows], y))  # however the rows arrived
    out = np.array(drawn.column("c").to_pylist()) == 0
    train, held = [i for i in order if not out[i]], [i for i in order if out[i]]
    if not train:
        train, held = list(order), []
    w, bias = fit_ftrl([rows[i] for i in train], y[train], len(labels))
    z = np.array([w[:, rows[i][0]] @ rows[i][1] + bias for i in held]).reshape(-1, len(labels))
    return Model(labels, w * (idf * SCALE)[None, :], bias, fit_temperature(z, y[held]))


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the ``carry`` columns, ``lang_pred, score`` of every row: one pass, no shuffle. Only the text is looked at."""
    own = {c: docs.schema[c].dataType.simpleString() for c in (key, *carry)}
    shared = docs.sparkSession.sparkContext.broadcast(model)  # labels × BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table = np.ascontiguousarray(m.weights.T, np.float32)

        def one(t: str | None) -> tuple[str, float]:
            if t is None or not m.labels or not has_letter(t):
                return UNKNOWN, 0.0
            z, n = np.zeros(len(m.labels)), 0
            for part in stretches(letters(t)):
                for bucket in grams(part):
                    z += table[bucket].sum(axis=0, dtype=np.float64)
                    n += len(bucket)
            p = softmax((z / max(n, 1) + m.bias) / m.temperature)
            best = int(p.argmax())
            return m.labels[best], float(p[best])

        for batch in batches:
            found = [one(t.as_py()) for t in batch.column(0)]
            names, scores = [a for a, _ in found], [b for _, b in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*own, "lang_pred", "score"]
            )

    schema = ", ".join([f"`{c}` {kind}" for c, kind in own.items()] + ["lang_pred string", "score double"])
    return docs.select(F.col(text).alias("_text"), *own).mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> Column:
    """The fold that is never learned from: crc32 of the key as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))
