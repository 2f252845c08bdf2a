"""Tables that a piece of work writes into the shared folder and reads again."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_PATHS: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, the folder that driver and executors share; a temporary one for a local session without it."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if spark.conf.get("spark.master", "").startswith("local") and "cluster" not in spark.conf.get("spark.master"):
        spark.conf.set("spark.checkpoint.dir", made := tempfile.mkdtemp(prefix="codicil-"))
        return made
    raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends, or by ``release``."""
    path = f"{shared_folder(spark)}/codicil-{name}-{uuid.uuid4().hex}"
    _PATHS.add(path)
    return path


def stored(df: DataFrame, name: str = "kept") -> DataFrame:
    """``df`` written as Parquet and read back, so that several readers don't make it again and lost executors don't either."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(path: str) -> None:
    from pyarrow import fs

    where, at = fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
    where.delete_dir(at)


def release(*paths: str) -> None:
    for path in paths or tuple(_PATHS):
        _PATHS.discard(path)
        with contextlib.suppress(OSError, ValueError):  # not written, or a store that only Spark reaches
            delete(path)


atexit.register(release)
