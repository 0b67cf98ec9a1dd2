"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, else one set by SparkContext.setCheckpointDir, else (local runs and tests only) a folder of this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return str(held.get()).rstrip("/")
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _FALLBACK:
        folder = tempfile.TemporaryDirectory(prefix="tessera-")
        atexit.register(folder.cleanup)
        _FALLBACK[sc.applicationId] = folder.name
    return _FALLBACK[sc.applicationId]


#: What this process has written, by application.
_WRITTEN: dict[str, list[str]] = {}


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop has them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def sweep(spark: SparkSession) -> int:
    """Remove all that materialise() has written in this application, and say how many tables that was. DataFrames that still rest on them can't be read any more, so write results first."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        fs, p = _files(spark, path)
        fs.delete(p, True)
    return len(paths)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text to a file of any file system that Spark knows; an old file is replaced."""
    fs, p = _files(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def get_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, or None if there's none."""
    fs, p = _files(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def names_in(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _files(spark, folder)
    return sorted(str(s.getPath().getName()) for s in fs.listStatus(p)) if fs.exists(p) else []


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: its lineage ends at those files, which outlive any executor. sweep() removes them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)
