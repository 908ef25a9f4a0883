"""Session construction and durable materialisation."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "skeinflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect (UTC, AQE with skew joins).

    Nothing here is a hard requirement: operators run on any session whose time
    zone is UTC. Shuffle width is left to AQE coalescing from a generous start.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where none is named and the session runs in one process (tests) a temporary folder
    is made and set as the checkpoint directory of the session; on a cluster that is an error, as
    executors would write to folders of their own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {sc.master} share")
        named = tempfile.mkdtemp(prefix="skeinflow-")
        sc.setCheckpointDir(named)
    return named


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer partitions than there are cores, dealt to all of them: a small file of texts is otherwise read and worked on by one task.

    Larger scans stay as they are, so nothing that fills the cluster is shuffled. ``df`` must not stand on a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers of the session, once, so that they need no path of their own to it."""
    sc = spark.sparkContext
    if getattr(sc, "_skeinflow_shipped", False):
        return
    package = Path(__file__).resolve().parent
    where = os.path.join(tempfile.mkdtemp(prefix="skeinflow-"), "skeinflow.zip")
    with zipfile.ZipFile(where, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(where)  # the driver serves it to the executors
    sc._skeinflow_shipped = True


_made: list[str] = []


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut the lineage: write ``df`` as parquet to the shared folder and read it back.

    The files survive the loss of any executor, and later stages scan only the
    columns they need. Use it where a result is read several times or where an
    iteration would otherwise grow its plan.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._skeinflow_path = path
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for output that is not written by ``materialize``; ``release`` removes it."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _made.append(path)
    return path


def discard(df: DataFrame | None) -> None:
    """Remove the files behind a DataFrame of :func:`materialize` that no plan needs any more."""
    path = getattr(df, "_skeinflow_path", None)
    if path:
        _delete(df.sparkSession, path)


def release(spark: SparkSession) -> int:
    """Remove everything ``materialize`` still holds; call it when no result of this session is needed any more."""
    held = list(_made)
    for path in held:
        _delete(spark, path)
    return len(held)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _made:
        _made.remove(path)
