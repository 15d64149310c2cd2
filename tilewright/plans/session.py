"""Session helpers."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of an Arrow batch, unless the session names another number than Spark's default: rows hold whole documents.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "1048576b")


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the executors' Python workers, whatever their path; once per application. Arrow batches stay small."""
    key, default, small = BATCH
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, small)
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        stem = str(Path(tempfile.mkdtemp(prefix="tilewright-")) / "tilewright_code")
        context.addPyFile(shutil.make_archive(stem, "zip", package.parent, package.name))
        _shipped.add(context.applicationId)
    return spark
