"""The Spark session with the settings that the engine expects."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
    # Checkpoints go when no frame needs them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cpus: int = 8, partitions: int = 8, memory: str = "8g", **more: str) -> SparkSession:
    """A local session for tests and benchmarks, with more settings if given; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.ui.enabled", "false")
    builder = builder.config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in {**DEFAULTS, **more}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors once a session, for clusters on which it isn't installed, and bounds Arrow batches."""
    # Rows may hold very long texts: small batches, by rows and bytes, bound what a Python worker and its buffers hold at once.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    if spark.sparkContext.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, str(file.relative_to(root.parent)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(spark.sparkContext.applicationId)
