"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_kept: list[DataFrame] = []


def ship(spark: SparkSession) -> None:
    """Make the package importable on executors that don't share the driver's search path; once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    fd, target = tempfile.mkstemp(prefix="cuelake-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def keep(df: DataFrame) -> DataFrame:
    """``df`` kept for several readers within one query, until ``release``; a lost executor's part is computed again."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    _kept.append(df)
    return df


def release() -> None:
    """Lets go of what earlier queries kept. A result that is read afterwards is right, but computed anew."""
    while _kept:
        df = _kept.pop()
        if df.sparkSession.sparkContext._jsc is not None:
            df.unpersist()


#: Tasks for each core of the cluster in stages that compute much on little data.
TASKS_A_CORE = 3


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over more tasks, by ``key``, if its files are too few to keep all cores busy; else as it is, and no row moves."""
    least = TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(least, key) if df.rdd.getNumPartitions() < least else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Only a session without a cluster may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    folder = tempfile.mkdtemp(prefix="cuelake-shared-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def mounted(folder: str) -> Path:
    """The path of a folder that is mounted on every machine; object stores and the like aren't."""
    scheme, colon, rest = folder.partition(":")
    if not colon or len(scheme) == 1:
        return Path(folder)
    if scheme != "file":
        raise ValueError(f"{folder} isn't mounted as a file system")
    return Path("/" + rest.lstrip("/"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
