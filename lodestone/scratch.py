"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one ``spark.checkpoint.dir`` names.

    Only where the session has none (unit tests in local mode) a temporary
    folder is made and set, so that a cluster never falls back to a local disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of it.

    This cuts lineage: what follows never recomputes ``df`` if an executor is
    lost, and each of several readers costs a scan instead of a recomputation.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def release(*frames: DataFrame) -> None:
    """Delete the tables of frames that nothing reads any more."""
    for frame in frames:
        path = _PATHS.pop(frame, None)
        if path:
            spark = frame.sparkSession
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
