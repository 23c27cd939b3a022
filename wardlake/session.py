"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # parquet filters on timestamps and strings prune row groups at scan time
    "spark.sql.parquet.filterPushdown": "true",
}


def local_session(cores: int | str = 8, app: str = "wardlake", checkpoint_dir: str | None = None) -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
    )
    builder = builder.config("spark.checkpoint.dir", checkpoint_dir or tempfile.mkdtemp(prefix="wardlake-"))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver found it (as ``--py-files`` would)."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix="wardlake-code-")
        context.addPyFile(shutil.make_archive(f"{folder}/wardlake", "zip", home, "wardlake"))
        _SHIPPED.add(context.applicationId)


_SHIPPED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names, or one in the session's warehouse where that is unset.

    Both are the session's own settings and reachable for all executors; nothing here depends on the kind of cluster.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (root or f"{spark.conf.get('spark.sql.warehouse.dir')}/wardlake-shared").rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/wardlake-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, in the application's own part of it."""
    return f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; to be called when its results are written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
