"""Session defaults and table access."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, **more: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the session comes from outside."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tesserae")
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": str(partitions), **more}.items():
        builder = builder.config(key, value)
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table. Spark reads the path, so any store that it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset (one machine, as in tests) a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is unset: a folder that driver and executors share is needed")
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tesserae-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again, so that later steps see fixed rows whatever executor is lost."""
    path = f"{shared_dir(df.sparkSession)}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once an application, so that it need not be installed there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tesserae-"), "tesserae.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("tesserae", os.path.relpath(path, root)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)
