"""Folders in any store that Spark reads: looked up, published whole, and removed, through Hadoop's file systems."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str) -> tuple[object, object]:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(target), system


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its store and its absolute folder, the same for driver and executors."""
    return _place(spark, path)[0].toString()


def exists(spark: SparkSession, path: str) -> bool:
    target, system = _place(spark, path)
    return system.exists(target)


def removed(spark: SparkSession, path: str) -> None:
    target, system = _place(spark, path)
    system.delete(target, True)


def copied(spark: SparkSession, local: str, path: str) -> None:
    """A file of the driver's own disk into a store, replacing what is there."""
    target, system = _place(spark, path)
    system.copyFromLocalFile(False, True, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{local}"), target)


def joined(spark: SparkSession, folder: str, path: str, head: bytes = b"", tail: bytes = b"", skip: int = 0) -> None:
    """The part files of a folder, in the order of their names, as one file with ``head`` and ``tail``, less the first ``skip`` bytes of the parts.

    The driver's JVM copies bytes from store to store through a small buffer; no row is read. A path without a store is on the driver's disk.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, store = _place(spark, folder)
    if "://" in path:
        target, system = _place(spark, path)
    else:
        target, system = jvm.org.apache.hadoop.fs.Path(os.path.abspath(path)), jvm.org.apache.hadoop.fs.FileSystem.getLocal(conf).getRaw()
    parts = sorted((f.getPath().getName(), f.getPath()) for f in store.listStatus(source) if f.getPath().getName().startswith("part-") and f.getLen())
    out = system.create(target, True)
    try:
        out.write(bytearray(head))
        for i, (_, part) in enumerate(parts):
            rows = store.open(part)
            try:
                rows.seek(0 if i else skip)
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(rows, out, 1 << 20, False)
            finally:
                rows.close()
        out.write(bytearray(tail))
    finally:
        out.close()


def published(spark: SparkSession, path: str, build: Callable[[str], None]) -> str:
    """``path``, made by ``build(folder)`` in a folder beside it that is then renamed, unless it is there already.

    Readers see the whole folder or none: a build that is killed leaves only its own
    hidden folder. Of several builders at once the first to end gives the folder;
    the others remove theirs, and all read the same. In stores whose renames copy
    files (object stores without directories), publication is as atomic as that.
    """
    target, system = _place(spark, path)
    if system.exists(target):
        return target.toString()
    own = f"{target.getParent().toString()}/.building-{uuid.uuid4().hex}"
    try:
        build(own)
        jvm = spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        options = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        context.rename(jvm.org.apache.hadoop.fs.Path(own), target, options)
    except Py4JJavaError:
        # Another builder was first; anything else is an error.
        if not system.exists(target):
            raise
    finally:
        removed(spark, own)
    return target.toString()
