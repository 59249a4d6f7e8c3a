"""Cutting lineage in loops."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import weakref
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_own: list = []
_written: list[str] = []
_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def _remove(path: str) -> None:
    if urlparse(path).scheme in ("", "file"):
        shutil.rmtree(urlparse(path).path, ignore_errors=True)
    elif (spark := SparkSession.getActiveSession()) is not None:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _drop() -> None:
    for path in _written:
        _remove(path)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session that has none, as in tests, gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        if not _own:
            own = tempfile.TemporaryDirectory(prefix="lodestone-")
            _own.append(own)
            atexit.register(own.cleanup)
        found = f"file://{_own[0].name}"
    return found.rstrip("/")


def forget_folder(path: str) -> None:
    """Delete a folder of files beside the tables."""
    _remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete settled tables before this process ends, once all that was computed from them is written too."""
    for t in tables:
        if (path := _paths.pop(t, None)) is not None:
            _remove(path)
            _written.remove(path)


def settle(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back; a lost executor doesn't undo it.

    The folder is that of ``shared_folder``. A written table has true sizes, while a checkpoint keeps estimates that
    grow with every join of a loop.
    """
    path = f"{shared_folder(df.sparkSession)}/lodestone/settled-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out
