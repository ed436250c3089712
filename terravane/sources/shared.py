"""Tables written in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; a folder of this machine only where one machine does all."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="terravane-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through its own file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again, as the stored table that it stands for; what reads it does not compute it anew.

    ``forget`` deletes it as soon as nothing will read it; what is left goes when the driver ends.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    _written[path] = df.sparkSession
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete what ``stored`` has written for these."""
    for df in frames:
        path = getattr(df, "_stored_path", None)
        if path in _written:
            remove(_written.pop(path), path)


@atexit.register
def _forget_all() -> None:
    while _written:
        path, spark = _written.popitem()
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return
