"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables written inside the scopes that are open, innermost last.
_SCOPES: list[list[str]] = []


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="wakeline-")


def shared_folder(spark: SparkSession) -> str:
    """Value of ``spark.checkpoint.dir``; only a local session (tests) may do without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return (folder or _own_folder()).rstrip("/")


def _path(spark: SparkSession, path: str):
    """A path and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def delete_at_end(spark: SparkSession, path: str) -> None:
    where, files = _path(spark, path)
    files.deleteOnExit(where)


def staged(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Later jobs start from the files, whichever executors were lost meanwhile, so the shuffles
    behind them go as soon as the table is written. The files go when :func:`dropped` or the
    scope they were written in says so, or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLE_CLEANUP)
        else:
            spark.conf.set(_SHUFFLE_CLEANUP, before)
    delete_at_end(spark, path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that :func:`staged` gave and nothing will read any more."""
    for table in tables:
        where, files = _path(table.sparkSession, table._staged_at)
        files.delete(where, True)


@contextmanager
def scope(tables: list[str]) -> Iterator[None]:
    """Note the tables staged inside in ``tables``."""
    _SCOPES.append(tables)
    try:
        yield
    finally:
        _SCOPES.pop()


def drop_unread(spark: SparkSession, tables: list[str], alive: DataFrame) -> None:
    """Delete all ``tables`` that ``alive`` does not read, and take them off the list."""
    read = alive.inputFiles()
    for path in [p for p in tables if not any(p.rsplit("/", 1)[1] in f for f in read)]:
        where, files = _path(spark, path)
        files.delete(where, True)
        tables.remove(path)


def unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name
