"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a task where a table is dealt anew.
PART = 16_384
_SETTING = "spark.checkpoint.dir"
#: Paths of the tables written within each open ``scratch()``.
_open: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is absent a local session, as in tests, gets a temporary
    folder; on a cluster that is an error, as other machines could not see it.
    """
    folder = spark.sparkContext.getConf().get(_SETTING) or spark.conf.get(_SETTING, None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"set {_SETTING} to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="fragsieve-")
        spark.conf.set(_SETTING, folder)
    return folder.rstrip("/")


def _place(spark: SparkSession, path: str) -> tuple[object, object]:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession) -> str:
    """A new path in a folder of its own in the shared folder; that folder is removed when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/fragsieve/{uuid.uuid4().hex}"
    target, system = _place(spark, path)
    # Only a folder that is there already is remembered for removal.
    system.mkdirs(target)
    system.deleteOnExit(target)
    return f"{path}/made"


def written(df: DataFrame, keep: bool = False) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    This cuts the lineage: a lost executor costs a reread, not a recomputation,
    and values that depend on the partitioning (row keys) stay as they are.
    The files are removed when the ``scratch()`` around the call ends (with
    ``keep``: the one around that), or else when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/fragsieve/{uuid.uuid4().hex}"
    df.write.parquet(path)
    target, system = _place(spark, path)
    system.deleteOnExit(target)
    if len(_open) > keep:
        _open[-1 - keep].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables written inside at its end; what is still to be read then must be written with ``keep``."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            target, system = _place(spark, path)
            system.delete(target, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if its rows come in fewer partitions than there are (a file of one row group is one task), in parts of ``PART`` rows at most, so that a task does not grow with the table. Only counts are read to tell."""
    most = df.sparkSession.sparkContext.defaultParallelism
    counted = df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.count("*").alias("filled"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows")).first()
    return df.repartition(max(most, -(-counted["rows"] // PART))) if counted["filled"] < most else df
