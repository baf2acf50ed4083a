"""Cutting lineage: intermediate tables in the folder that driver and executors share.

A staged table survives the loss of an executor, so a job that reads one several times
never recomputes what stands before it. Nothing here uses executor-local storage.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from uuid import uuid4
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_own_roots: dict[str, str] = {}
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
#: The tables staged inside each running ``stage_result``.
_scopes: list[list[str]] = []


def staging_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one only for a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _own_roots:
        _own_roots[app] = "file://" + tempfile.mkdtemp(prefix="tessella-staging-")
    return _own_roots[app]


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path in its terms."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and return a reader of what was written.

    The table goes when the application ends, or before that with ``unstage`` or ``stage_result``.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{label}-{uuid4().hex}"
    df.write.parquet(path)
    system, at = file_system(spark, path)
    system.deleteOnExit(at)
    if _scopes:
        _scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more, as returned by ``stage_table``; others stay."""
    for table in tables:
        path = _paths.pop(table, None)
        if path:
            system, at = file_system(table.sparkSession, path)
            system.delete(at, True)


def stage_result(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """Stage what ``make`` returns and delete all tables staged on the way."""
    _scopes.append([])
    try:
        out = stage_table(make(), label)
    finally:
        inner = _scopes.pop()
    if _scopes:
        _scopes[-1].append(_paths[out])
    for path in inner:
        if path != _paths[out]:
            system, at = file_system(out.sparkSession, path)
            system.delete(at, True)
    return out
