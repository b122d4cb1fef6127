"""Directory listing through the cluster's own file system client."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    jvm_path, fs = _path(spark, path)
    return fs.exists(jvm_path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as readers report it."""
    jvm_path, fs = _path(spark, path)
    return fs.makeQualified(jvm_path).toString()


def files(spark: SparkSession, path: str) -> list[str]:
    """The data files below ``path`` (or the file itself), in name order; hidden names are left out."""
    jvm_path, fs = _path(spark, path)
    status = fs.getFileStatus(jvm_path)
    if not status.isDirectory():
        return [path]
    found = [s.getPath() for s in fs.listStatus(jvm_path) if not s.getPath().getName().startswith(("_", "."))]
    return sorted(name for p in found for name in files(spark, p.toString()))


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file."""
    jvm_path, fs = _path(spark, path)
    stream = fs.open(jvm_path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small text file unless there is one of this name; True if this call made it.

    The file appears whole: it is written beside and then renamed, which no file system that Hadoop
    calls consistent does over an existing file.
    """
    target, fs = _path(spark, path)
    beside, _ = _path(spark, f"{path}.{uuid.uuid4().hex}")
    if fs.exists(target):
        return False
    fs.mkdirs(target.getParent())
    stream = fs.create(beside, False)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), spark._jsc.hadoopConfiguration())
    options = spark._jvm.java.lang.reflect.Array.newInstance(
        spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0
    )
    try:
        context.rename(fs.makeQualified(beside), fs.makeQualified(target), options)  # refuses to overwrite
    except Py4JJavaError:
        fs.delete(beside, False)
        if not fs.exists(target):
            raise
        return False
    return True


def first_line(spark: SparkSession, path: str) -> str:
    """The first line of a text file; nothing else of it is read."""
    jvm_path, fs = _path(spark, path)
    codecs = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration())
    stream, codec = fs.open(jvm_path), codecs.getCodec(jvm_path)
    reader = spark._jvm.java.io.BufferedReader(
        spark._jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8")
    )
    try:
        return reader.readLine() or ""
    finally:
        reader.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies directly below a folder, in order; nothing if there is none."""
    jvm_path, fs = _path(spark, path)
    if not fs.exists(jvm_path):
        return []
    return sorted(n for s in fs.listStatus(jvm_path) if not (n := s.getPath().getName()).startswith((".", "_")))


def partition_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of one partition column directly below ``path``: directory names, no file is opened."""
    jvm_path, fs = _path(spark, path)
    if not fs.exists(jvm_path):
        return []
    prefix = f"{column}="
    names = [status.getPath().getName() for status in fs.listStatus(jvm_path)]
    return sorted(name[len(prefix):] for name in names if name.startswith(prefix))


def newest_file_time(spark: SparkSession, path: str) -> int:
    """When the newest data file below ``path`` was written, in milliseconds; 0 where there is none."""
    jvm_path, fs = _path(spark, path)
    found = [s for s in fs.listStatus(jvm_path) if not s.getPath().getName().startswith(("_", "."))]
    return max(
        (newest_file_time(spark, s.getPath().toString()) if s.isDirectory() else s.getModificationTime() for s in found), default=0
    )


def is_complete(spark: SparkSession, path: str) -> bool:
    """A finished write leaves a ``_SUCCESS`` marker."""
    return exists(spark, f"{path}/_SUCCESS")
