"""Files that tasks open by ranges or write themselves, in any store that pyarrow knows (shared folders, HDFS, object stores).

What Spark's own readers and writers can do is left to them.
"""

from __future__ import annotations

import os
import uuid
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql import SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark understands it: tasks get the same place, whatever their folder is."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.makeQualified(found).toString()


def exists(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path, and the path in it."""
    scheme, _, rest = path.partition(":")
    if not rest or "/" in scheme:
        return fs.LocalFileSystem(), os.path.abspath(path)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")


def opened(path: str) -> BinaryIO:
    """A file for reading by ranges: only what is asked for is read."""
    store, inner = located(path)
    return store.open_input_file(inner)


def size(path: str) -> int:
    """Bytes of a file; 0 if there is none."""
    store, inner = located(path)
    return store.get_file_info(inner).size or 0


def put(path: str, content: bytes) -> None:
    """Write a file that is there whole or not at all: under another name first."""
    store, inner = located(path)
    folder, _, name = inner.rpartition("/")
    store.create_dir(folder, recursive=True)
    other = f"{folder}/.{name}.{uuid.uuid4().hex}.tmp"
    try:
        with store.open_output_stream(other) as out:
            out.write(content)
        store.move(other, inner)
    except BaseException:
        if store.get_file_info(other).type == fs.FileType.File:
            store.delete_file(other)
        raise


def remove(path: str) -> None:
    store, inner = located(path)
    if store.get_file_info(inner).type == fs.FileType.File:
        store.delete_file(inner)
