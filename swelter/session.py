"""Session set-up and the helpers every operator shares."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Folders that ``cut_lineage`` has written in this process.
_STEPS: list[str] = []

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.compression.codec": "zstd",
}


def build_session(app: str = "swelter", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; ``conf`` wins over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; one of our own only for a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured:
            sc.setCheckpointDir(configured)
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="swelter-ckpt-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return sc.getCheckpointDir()


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of any file system Spark can reach; nothing happens if it is not there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def temporary_steps(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that ``cut_lineage`` stores inside the block; for jobs whose results are written by then."""
    kept = len(_STEPS)
    try:
        yield
    finally:
        while len(_STEPS) > kept:
            delete_path(spark, _STEPS.pop())


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store ``df`` as a table in the checkpoint folder and read it back.

    Survives lost executors like a checkpoint. Unlike one, the result has a known size, so
    Spark itself decides on broadcasts; only the columns needed are read; and loops do not
    drag along the constraints of earlier rounds, which make planning time explode.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STEPS.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_swelter_shipped", False):
        return
    package = Path(__file__).resolve().parent
    if package.parent.is_dir():  # not already running from an archive
        target = tempfile.mkdtemp(prefix="swelter-pkg-")
        sc.addPyFile(shutil.make_archive(f"{target}/swelter", "zip", package.parent, package.name))
    sc._swelter_shipped = True
