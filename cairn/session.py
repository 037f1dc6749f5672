"""Session helpers: table loading, reliable checkpoints and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast by :func:`broadcast_if_small`.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` (a file or a directory) below `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where none is set, a temporary one if all runs on this machine; on
    a cluster, where such a folder is another one on each machine, that is an error."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return known or current.get()
    if not known and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
    folder = known or os.path.join(tempfile.gettempdir(), "cairn-checkpoints")
    sc.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable, eagerly written checkpoint: lineage is cut and every executor can read it back."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `max_rows` rows (counted, with early exit); else `df` as it is,
    so the planner falls back to a shuffled join."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application (a zip sent like any --py-files)."""
    import shutil

    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="cairn-package-")
    parts = shutil.ignore_patterns("__pycache__", "*.pyc")
    shutil.copytree(root, os.path.join(folder, "tree", os.path.basename(root)), ignore=parts)
    archive = shutil.make_archive(os.path.join(folder, os.path.basename(root)), "zip", os.path.join(folder, "tree"))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)
