"""Spark sessions with the settings that the library is tested under."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXTS_IN_BATCH = 1000


def session(app: str = "textmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults; ``conf`` keys have ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context, so that Python workers can import it anywhere; bound Arrow batches."""
    context = spark.sparkContext
    # Rows hold whole texts: Spark's 10,000 of them in an Arrow batch are too many for a worker's memory.
    if int(spark.conf.get(_BATCH)) > TEXTS_IN_BATCH:
        spark.conf.set(_BATCH, TEXTS_IN_BATCH)
    if getattr(context, "_textmill_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="textmill-code-"))
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(folder / "textmill_code.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for at in sorted(root.rglob("*.py")):
            z.write(at, f"{root.name}/{at.relative_to(root)}")
    context.addPyFile(str(folder / "textmill_code.zip"))
    context._textmill_shipped = True
