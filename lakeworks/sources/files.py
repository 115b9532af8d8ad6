"""File system helpers that work on any storage Spark can reach."""

from __future__ import annotations

import os

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, text: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(text)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, text: str) -> bool:
    fs, path = _path(spark, text)
    return fs.exists(path)


def delete(spark: SparkSession, text: str) -> None:
    fs, path = _path(spark, text)
    fs.delete(path, True)


def read_text(spark: SparkSession, text: str) -> str:
    fs, path = _path(spark, text)
    stream = fs.open(path)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, text: str, content: str) -> None:
    """Write a new small file; it must not exist."""
    fs, path = _path(spark, text)
    stream = fs.create(path, False)
    try:
        stream.write(bytearray(content.encode()))
    finally:
        stream.close()


def move_new(spark: SparkSession, source: str, target: str) -> bool:
    """Move a file to a name that must be free, in one step; False if it is not."""
    jvm = spark._jvm
    fs, source_path = _path(spark, source)
    _, target_path = _path(spark, target)
    if fs.getUri().getScheme() == "file":
        # Renaming within a POSIX folder replaces; a second link to the file does not.
        try:
            os.link(source_path.toUri().getPath(), target_path.toUri().getPath())
        except FileExistsError:
            return False
        fs.delete(source_path, False)
        return True
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target_path.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(source_path, target_path, options)
        return True
    except Py4JJavaError:
        if exists(spark, target):
            return False
        raise


def names(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    """Names of the entries that begin with the prefix, sorted."""
    fs, path = _path(spark, folder)
    found = [status.getPath().getName() for status in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(n for n in found if n.startswith(prefix))
