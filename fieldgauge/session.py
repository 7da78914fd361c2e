"""Session settings the jobs rely on; on a cluster these belong in spark-defaults."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Anything broadcast by this library is measured first and must stay below this size.
BROADCAST_BYTES = 256 * 1024 * 1024

_LOCAL_FOLDERS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def local_session(cores: int | str = "*", app: str = "fieldgauge", **conf: str) -> SparkSession:
    """A session for tests and the bench on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("FIELDGAUGE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.executorEnv.OMP_NUM_THREADS", "1")
        .config("spark.executorEnv.OPENBLAS_NUM_THREADS", "1")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application.

    Functions that run in tasks are found by name there; an installed package or ``--py-files``
    does the same.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="fieldgauge-")) / "fieldgauge.zip"
    with zipfile.ZipFile(archive, "w") as held:
        for source in sorted(root.rglob("*.py")):
            held.write(source, source.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder for cut lineage and hand-over tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master without that setting gets
    a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="fieldgauge-")
    return _LOCAL_FOLDERS[app]


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    The lineage ends there, so a lost executor costs a re-read and nothing upstream; and unlike a
    checkpoint the rows are computed once and stay columnar.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)
