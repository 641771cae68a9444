"""Durable intermediates: written tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []
#: What this process has written: paths, with the name of the table over each where there is one.
_MADE: dict[str, str | None] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; an own one only where none is set and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master", "").startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="plumbline-shared-"))
    return _OWN_DIR[0]


def made(spark: SparkSession, label: str, table: str | None = None) -> str:
    """A fresh path in the shared folder; ``release`` removes what is written there, and the table of this name."""
    path = f"{shared_dir(spark)}/plumbline/{label}-{uuid.uuid4().hex}"
    _MADE[path] = table
    return path


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Cuts the lineage of ``df``: writes it as Parquet to the shared folder and reads it back.

    A lost executor then costs no stage above, and every later reader sees the same rows. The table
    stays until ``release``, as the result may be read at any time.
    """
    spark = df.sparkSession
    path = made(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Removes what was written to a path of ``made``, with its table; nothing may read it any more."""
    if table := _MADE.pop(path, None):
        spark.sql(f"DROP TABLE IF EXISTS `{table}`")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> int:
    """Removes all that this process has written by ``made`` and ``cut``; results that still read it are void.

    Gives the number of paths.
    """
    paths = list(_MADE)
    for path in paths:
        discard(spark, path)
    return len(paths)
