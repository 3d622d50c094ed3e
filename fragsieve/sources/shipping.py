"""Readies a session: the package on the executors, and batches that stay small with long texts."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


#: Rows of an Arrow batch, unless the session sets its own number; whole texts can be long.
BATCH_ROWS = "1000"
_SETTING, _DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip file to the session, once for each Spark application."""
    context = spark.sparkContext
    if spark.conf.get(_SETTING, _DEFAULT) == _DEFAULT:
        spark.conf.set(_SETTING, BATCH_ROWS)
    if getattr(context, "_fragsieve_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="fragsieve-")) / "fragsieve_package.zip"
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(target))
    context._fragsieve_shipped = True
