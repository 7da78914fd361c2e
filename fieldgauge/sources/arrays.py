"""Row sets stored as NumPy archives."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A binary cell is limited to 2 GiB; refuse before that.
LARGEST = 1 << 30

NPZ = "path string, row bigint, traj bigint, x array<float>, y array<float>"
NPY = "path string, row bigint, x array<float>"


def _pieces(rows: int, step: int = 1024) -> Iterator[slice]:
    for lo in range(0, rows, step):
        yield slice(lo, min(rows, lo + step))


def decode_npz(files: DataFrame, content: str = "content") -> DataFrame:
    """``(path, row, traj, x, y)`` from archives holding X, Y and traj; one archive per step of a task."""

    def run(frames):
        for frame in frames:
            for path, blob in zip(frame["path"], frame[content]):
                with np.load(io.BytesIO(blob), allow_pickle=False) as held:
                    if not {"X", "Y", "traj"} <= set(held.files):
                        raise ValueError(f"{path}: expected X, Y and traj, found {held.files}")
                    x, y, traj = held["X"], held["Y"], held["traj"]
                if x.shape != y.shape or x.ndim != 2 or len(traj) != len(x):
                    raise ValueError(f"{path}: shapes {x.shape}, {y.shape}, {traj.shape} do not match")
                for at in _pieces(len(x)):
                    yield pd.DataFrame(
                        {
                            "path": path,
                            "row": np.arange(at.start, at.stop),
                            "traj": traj[at].astype(np.int64),
                            "x": list(x[at].astype(np.float32)),
                            "y": list(y[at].astype(np.float32)),
                        }
                    )

    return files.select("path", content).mapInPandas(run, NPZ)


def decode_npy(files: DataFrame, content: str = "content") -> DataFrame:
    """``(path, row, x)`` from single 2-D arrays."""

    def run(frames):
        for frame in frames:
            for path, blob in zip(frame["path"], frame[content]):
                x = np.load(io.BytesIO(blob), allow_pickle=False)
                if x.ndim != 2:
                    raise ValueError(f"{path}: expected a 2-D array, found {x.shape}")
                for at in _pieces(len(x)):
                    yield pd.DataFrame(
                        {"path": path, "row": np.arange(at.start, at.stop), "x": list(x[at].astype(np.float32))}
                    )

    return files.select("path", content).mapInPandas(run, NPY)


def ingest_npz(spark: SparkSession, path: str, glob: str = "*.npz") -> DataFrame:
    return decode_npz(_files(spark, path, glob))


def ingest_npy(spark: SparkSession, path: str, glob: str = "*.npy") -> DataFrame:
    return decode_npy(_files(spark, path, glob))


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    too_big = F.raise_error(F.concat(F.lit("archive too large for one cell: "), F.col("path")))
    return files.select(
        "path", F.when(F.col("length") > LARGEST, too_big).otherwise(F.col("content")).alias("content")
    )


def pack_npz(rows: DataFrame, traj: str, x: str, y: str) -> DataFrame:
    """``(path, content)``: archives of X, Y and traj, one per Arrow batch so none grows with the data."""

    def run(frames):
        for frame in frames:
            if len(frame):
                blob = io.BytesIO()
                np.savez(
                    blob,
                    X=np.vstack(frame[x].to_numpy()).astype(np.float32),
                    Y=np.vstack(frame[y].to_numpy()).astype(np.float32),
                    traj=frame[traj].to_numpy(dtype=np.int64),
                )
                name = f"rows-{frame[traj].iloc[0]}.npz"
                yield pd.DataFrame({"path": [name], "content": [blob.getvalue()]})

    return rows.select(traj, x, y).mapInPandas(run, "path string, content binary")
