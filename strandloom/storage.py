"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session (tests) may lack the setting; it then gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="strandloom-"))
    return "file://" + _LOCAL[0]


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later reads survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folder(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder for files that tasks write."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def put(uri: str, arrays: Iterable[np.ndarray]) -> None:
    """Writes arrays one after another as a file; it is there whole or not at all, also if a task is run twice."""
    where, path = fs.FileSystem.from_uri(uri)
    where.create_dir(os.path.dirname(path))
    part = f"{path}.{uuid.uuid4().hex}"
    with where.open_output_stream(part) as f:
        for a in arrays:
            if len(a):
                f.write(np.ascontiguousarray(a).data.cast("B"))
    where.move(part, path)


def mapped(uri: str, kind: type | str) -> np.ndarray:
    """A file of the shared folder mapped into memory; one that isn't on a mounted disk is copied to this machine first."""
    where, path = fs.FileSystem.from_uri(uri)
    if not isinstance(where, fs.LocalFileSystem):
        version = f"{uri} {where.get_file_info(path).mtime_ns}"
        near = f"{tempfile.gettempdir()}/strandloom-{hashlib.sha1(version.encode()).hexdigest()}"
        if not os.path.exists(near):
            fs.copy_files(path, part := f"{near}.{uuid.uuid4().hex}", source_filesystem=where, destination_filesystem=fs.LocalFileSystem())
            os.replace(part, near)
        path = near
    # a plain array over the map, as each slice of a memmap object costs much more
    return np.memmap(path, kind, "r").view(np.ndarray) if os.path.getsize(path) else np.empty(0, kind)


def there(uri: str) -> bool:
    where, path = fs.FileSystem.from_uri(uri)
    return where.get_file_info(path).type != fs.FileType.NotFound


def drop(uri: str) -> None:
    """Deletes a file, if it is there."""
    if there(uri):
        where, path = fs.FileSystem.from_uri(uri)
        where.delete_file(path)


def clear(spark: SparkSession) -> int:
    """Deletes the tables written so far; results that still read them must be saved before."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    n = 0
    while _WRITTEN:
        where = files.Path(_WRITTEN.pop())
        n += where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return n
