"""Cutting a plan at a table in the folder that driver and executors share.

A written table outlives the executor that made it, is read back column by column, and
gives the planner real sizes to choose joins by.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[object, str]] = []
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where none is named and all runs on one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
    return _own[app]


def cut(df: DataFrame, name: str = "part") -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends there.

    On a local file system without native Hadoop libraries every folder and marker that the driver makes starts a `chmod`, which until it begins is
    an image of the whole JVM. So the folders of the write are there before, and no marker is left: nobody else reads the table.
    """
    path = scratch(df.sparkSession, name)
    if path.startswith("file:"):
        os.makedirs(f"{path.removeprefix('file:')}/_temporary/0/_temporary")
    out = df.write.mode("append").option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    out.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it is cleared when the session's process ends."""
    path = f"{shared_dir(spark)}/lodestrata-{uuid.uuid4().hex}-{name}"
    _written.append((spark, path))
    return path


def cut_narrow(df: DataFrame, name: str = "part") -> DataFrame:
    """cut() of the few columns that a scan of wide rows leaves: dealt out anew by size first, so that the table has as
    many files as its bytes ask for and not as many as the scan had tasks."""
    return cut(df.hint("rebalance"), name)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a table that cut() returned."""
    spark = df.sparkSession
    jvm, total = spark._jvm, 0
    for file in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(file)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return total


def release(df: DataFrame) -> None:
    """Deletes the files of a table that cut() returned, once nothing reads it any more."""
    for file in df.inputFiles()[:1]:
        _delete(df.sparkSession, file.rsplit("/", 1)[0])


def _delete(spark, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; its shared folder is the cluster's to clear
            return


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that no column of df has, in any case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found
