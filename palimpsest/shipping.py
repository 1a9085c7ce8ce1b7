"""Sends this package's code to the Python workers, which may not have it installed."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile

from pyspark.sql import SparkSession

#: Rows and bytes a Python worker gets at once; texts are whole, so a batch is one text at least.
ARROW_ROWS, ARROW_BYTES = 500, 32 << 20

_shipped: set[str] = set()
_lock = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't have it, and bound their batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    # segments are indexed by several threads at once
    with _lock:
        if spark.sparkContext.applicationId not in _shipped:
            _send(spark)
            _shipped.add(spark.sparkContext.applicationId)


def _send(spark: SparkSession) -> None:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(), "palimpsest_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "palimpsest")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(archive)
