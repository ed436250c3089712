"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, through Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, _UPPER, _LOWER)


def crc_mod(col: Column, m: int) -> Column:
    """crc32 of the id's decimal text, modulo ``m`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % m


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until ``df`` has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def columns(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever stands in their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def text_id(text: Column) -> Column:
    """The 128 bits by which equal texts are known."""
    return F.unhex(F.md5(text.cast("binary")))


def limit_batches(spark: SparkSession) -> None:
    """Arrow batches of 1000 rows and 4 MB at most in this session, unless its owner has set other limits.

    Whole texts are large rows; with Spark's limits a batch of them takes 64 MB
    in each task and again in its Python worker.
    """
    for key, usual, small in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m")):
        if spark.conf.get(key) == usual:
            spark.conf.set(key, small)


def tidied(run):
    """A function for mapInArrow that gives freed memory back at a task's end; workers stay idle between stages."""

    @functools.wraps(run)
    def task(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library

    return task


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, set here only where it is unset and one machine does all."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="terravane-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found


class Scratch:
    """Tables written in the shared folder to cut lineage; a lost executor rereads them.

    ``keep`` writes a DataFrame as Parquet and returns its reader; ``drop``
    deletes tables that nothing will read again. What is left goes when the
    driver ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        limit_batches(spark)
        self.root = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self._end)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n}-{name}"

    def keep(self, df: DataFrame, name: str = "t", partitions: tuple[str, ...] = ()) -> DataFrame:
        path = self.path(name)
        writer = df.write.option("compression", "zstd")
        if partitions:
            writer = writer.partitionBy(*partitions)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = getattr(df, "_scratch_path", None)
            if path:
                self._delete(path)

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)

    def _end(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass


def connected_components(edges: DataFrame, scratch: Scratch, limit: int = 60) -> DataFrame:
    """(id, component) for the ids in ``edges`` (columns a, b): the smallest id reachable.

    Every round gives each id the smallest label among its own and its
    neighbours', then follows the label's own label (pointer jumping), so a
    star ends in two rounds and a chain in about the logarithm of its length.
    The labels are written to the shared folder each round. ``limit`` only
    guards against an endless loop; reaching it raises.
    """
    both = scratch.keep(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges"
    )
    labels = scratch.keep(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    for _ in range(limit):
        near = (
            both.join(labels.withColumnRenamed("id", "b"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("label").alias("near"))
        )
        step = labels.join(near, "id", "left").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        moved = scratch.keep(
            step.join(jump, "label", "left").select("id", F.least("label", F.coalesce("further", "label")).alias("label"), "old"), "labels"
        )
        changed = moved.where("label <> old").limit(1).count()
        scratch.drop(labels)
        labels = moved.select("id", "label")
        labels._scratch_path = moved._scratch_path
        if not changed:
            scratch.drop(both)
            return labels.select("id", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {limit} rounds")
