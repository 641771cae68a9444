"""A log of committed versions beside the tables they belong to.

A version is a folder of Parquet files that counts from the moment its entry is in the log. Entries are numbered; number n + 1 is
put only if it is not there yet, so of two writers that saw the same log one wins and the other learns of it, and the order
of versions is that of the log, not of any clock. A checkpoint is a version that stands for all before it.

The put is a rename that fails where the name is taken (a hard link on local files), so the folder has to be in a store
whose rename does so, as HDFS; a store without it needs one writer at a time.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class ConflictError(RuntimeError):
    """Another writer committed first."""


@dataclass(frozen=True)
class Entry:
    sequence: int
    version: str
    checkpoint: bool = False


def _place(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    log, fs = _place(spark, f"{path}/_log")
    if not fs.exists(log):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(log)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")


def entries(spark: SparkSession, path: str) -> list[Entry]:
    """What counts now, oldest first: the newest checkpoint and the versions after it; nothing where there is no log."""
    jvm, found = spark.sparkContext._jvm, []
    for n in reversed(_numbers(spark, path)):
        place, fs = _place(spark, f"{path}/_log/{n:020d}.json")
        stream = fs.open(place)
        try:
            body = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        found.append(Entry(n, body["version"], body["checkpoint"]))
        if body["checkpoint"]:
            break
    return found[::-1]


def last(spark: SparkSession, path: str) -> int:
    """The number of the newest entry, 0 for none."""
    return max(_numbers(spark, path), default=0)


def append(spark: SparkSession, path: str, version: str, after: int, checkpoint: bool = False) -> int:
    """Commits a version as the entry after number ``after``; ConflictError if that is there already."""
    body = json.dumps({"version": version, "checkpoint": checkpoint})
    target, fs = _place(spark, f"{path}/_log/{after + 1:020d}.json")
    draft, _ = _place(spark, f"{path}/_log/.{uuid.uuid4().hex}.draft")
    stream = fs.create(draft, False)
    stream.write(bytearray(body.encode()))
    stream.close()
    try:
        _put(spark, fs, draft, target)
    finally:
        fs.delete(draft, False)
    return after + 1


def _put(spark: SparkSession, fs, draft, target) -> None:
    taken = ConflictError(f"{target.toString()} is there already")
    if fs.getUri().getScheme() == "file":
        try:
            os.link(draft.toUri().getPath(), target.toUri().getPath())
        except FileExistsError:
            raise taken from None
        return
    jvm = spark.sparkContext._jvm
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, target, none)
    except Exception as e:  # the gateway has one class for all errors of the JVM
        if fs.exists(target):
            raise taken from e
        raise


def remove(spark: SparkSession, path: str) -> None:
    place, fs = _place(spark, path)
    fs.delete(place, True)


def folder(table: str, version: str) -> str:
    return f"{table}/version={version}"


def read(spark: SparkSession, table: str, schema, versions: list[str]) -> DataFrame:
    """The rows of these versions of a table, with the column version; no other folder is opened."""
    return spark.read.schema(schema).option("basePath", table).parquet(*(folder(table, v) for v in versions))


def forget(spark: SparkSession, path: str, before: int) -> None:
    """Removes the entries below a checkpoint's number."""
    for n in _numbers(spark, path):
        if n < before:
            remove(spark, f"{path}/_log/{n:020d}.json")
