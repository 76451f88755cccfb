"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
}
_local_folder: str | None = None
_shipped_to = None
_made: list[str] = []


def build_session(master: str | None = None, app: str = "folioscan", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_DEFAULTS, **settings}.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once for each context.

    They need it for the few Python functions, wherever the driver was started.
    """
    global _shipped_to
    context = spark.sparkContext
    if _shipped_to is not context:
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")  # Spark's file server takes it from here
        context.addPyFile(shutil.make_archive(f"{folder}/{root.name}", "zip", root.parent, root.name))
        _shipped_to = context
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables and stream checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a temporary folder.
    """
    global _local_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _local_folder


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no one else uses, for ``drop_tables`` to remove."""
    _made.append(f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}")
    return _made[-1]


def drop_tables(spark: SparkSession) -> int:
    """Delete the intermediate tables that this process has written; frames over them can be read no more."""
    gone = 0
    while _made:
        gone += drop_path(spark, _made.pop())
    return gone


def drop_path(spark: SparkSession, path: str) -> bool:
    """Delete a folder, wherever Spark can reach it; whether it was there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write the table to the shared folder and read it back.

    Cuts lineage, survives the loss of executors, and lets later steps prune
    columns and push filters into the files.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
