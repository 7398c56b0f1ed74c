"""Tables and files in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_written: list[Path] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as a URI or path.

    It is the one that the session names in ``spark.checkpoint.dir``.  Only a
    session without one (tests, a single machine) gets a temporary folder, and
    only if it runs in local mode.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(spark.sparkContext, "_textmill_shared", None)
    if made is None:
        made = tempfile.mkdtemp(prefix="textmill-")
        _written.append(Path(made))
        spark.sparkContext._textmill_shared = made
    return made


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new name in the shared folder; a local one is removed when Python ends."""
    at = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if (local := local_path(at)) is not None:
        _written.append(local)
    return at


def local_path(uri: str) -> Path | None:
    """The POSIX path of a ``file:`` URI or plain path, else None."""
    parts = urlparse(uri)
    if parts.scheme == "file":
        return Path(parts.path)
    return Path(uri) if parts.scheme == "" else None


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    Loss of an executor then costs a re-read, never a recomputation of the
    steps before.
    """
    at = shared_path(df.sparkSession, tag)
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._textmill_at = at
    return out


def discard(*written: DataFrame | None) -> None:
    """Delete tables that ``materialize`` wrote, once no plan that will still run reads them."""
    for df in written:
        if at := getattr(df, "_textmill_at", None):
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            df._textmill_at = None


@atexit.register
def _clean() -> None:
    for at in _written:
        shutil.rmtree(at, ignore_errors=True)
