"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


#: Rows of a batch between the JVM and Python: texts are long, and both sides hold a batch more than once.
ARROW_ROWS = 500


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once an application, so that Python workers need no installation.

    Arrow batches are set to ARROW_ROWS rows unless the session has a setting of its own.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lodestack-"), "lodestack.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, dirs, files in os.walk(root):
            dirs[:] = sorted(d for d in dirs if d != "__pycache__")
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(at, f)
                    z.write(full, os.path.join("lodestack", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def build(master: str = "local[*]", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators are written for; a running one is returned as it is."""
    b = SparkSession.builder.master(master).appName("lodestack").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", shuffle_partitions)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
