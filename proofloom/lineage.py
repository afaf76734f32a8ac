"""Cutting lineage in storage that every executor can read.

``cut`` writes a table below the folder that ``spark.checkpoint.dir`` names and reads it back, so a lost
executor costs a re-read, never a recomputation of the whole history, and later steps see real sizes.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def _remember(spark: SparkSession, path: str) -> None:
    if not _made:  # registered after the gateway's own handler, so it runs before the JVM is gone
        atexit.unregister(_drop_all)
        atexit.register(_drop_all)
    _made.append((spark, path))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one is made only for a local master without a setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="proofloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, in folders of the columns ``by`` if given, and return the written table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/proofloom/{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    _remember(spark, path)
    again = spark.read.schema(df.schema).parquet(path)
    again._proofloom_path = path
    return again


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_folder(spark)}/proofloom/{name}-{uuid.uuid4().hex}"
    _remember(spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop(df: DataFrame | None) -> None:
    """Delete a table that ``cut`` wrote and that nothing needs any more."""
    path = getattr(df, "_proofloom_path", None)
    if path:
        _delete(df.sparkSession, path)
        _made[:] = [x for x in _made if x[1] != path]


def _drop_all() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the session is gone, and with it the way to the files
            return
