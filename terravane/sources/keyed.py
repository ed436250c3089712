"""A stored table in buckets of its key, of which a batch rewrites only those that it touches.

``path/data`` holds the buckets' folders, ``path/versions`` a manifest for each
version: which folder each bucket is in, and the batch that made it. A manifest
is written under another name and renamed, so readers see a whole version or
the one before. A batch that is run again finds its number and changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravane.sources.shared import forget, remove, stored


class KeyedTable:
    """Rows of ``schema``, one for each value of ``key``, in ``buckets`` parts by the key's hash."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = 64) -> None:
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        where = self._path("versions")
        found = self._fs.listStatus(where) if self._fs.exists(where) else []
        return sorted(int(f.getPath().getName()) for f in found if f.getPath().getName().isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """``folders`` by bucket, ``batch`` and ``version`` of a version, the newest if none is given."""
        known = self.versions()
        if not known:
            return {"version": -1, "batch": None, "folders": {}}
        text = self.spark.read.text(f"{self.path}/versions/{known[-1] if version is None else version}").first()[0]
        return json.loads(text)

    def _publish(self, folders: dict[str, str], batch: int | None) -> int:
        version = self.manifest()["version"] + 1
        made = f"versions/.{uuid.uuid4().hex}"
        self.spark.createDataFrame([(json.dumps({"version": version, "batch": batch, "folders": folders}),)], "value string").coalesce(1).write.text(f"{self.path}/{made}")
        if not self._fs.rename(self._path(made), self._path(f"versions/{version}")):
            raise RuntimeError(f"another writer has made version {version}")
        return version

    def bucket(self, column: str):
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _read(self, folders: dict[str, str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders.values()])

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.manifest(version)["folders"])

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Rows in new folders, one for each bucket that has any."""
        name = f"data/{uuid.uuid4().hex}"
        names = [f.name for f in self.schema]
        laid = rows.select(*names, self.bucket(self.key).alias("_bucket")).repartition("_bucket")
        laid.write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
        found = self._fs.listStatus(self._path(name))
        parts = [f.getPath().getName() for f in found if f.getPath().getName().startswith("_bucket=")]
        return {p.removeprefix("_bucket="): f"{name}/{p}" for p in parts}

    def replace(self, rows: DataFrame, batch: int | None = None) -> int:
        """A version that holds ``rows`` and nothing else."""
        return self._publish(self._write(rows), batch)

    def apply(self, changed: DataFrame, gone: DataFrame, batch: int | None = None) -> int:
        """Rows of ``changed`` take the place of those with their keys, rows with keys of ``gone`` go; what stands in other buckets is not read.

        ``changed`` is unique by key and wins over ``gone``. A batch number that
        the newest version, or a later one, was made by changes nothing.
        """
        now = self.manifest()
        if batch is not None and now["batch"] is not None and batch <= now["batch"]:
            return now["version"]
        changed = stored(changed.select(*[f.name for f in self.schema]), "changed")
        keys = changed.select(self.key).unionByName(gone.select(self.key))
        touched = {str(r[0]) for r in keys.select(self.bucket(self.key).alias("b")).distinct().collect()}  # as many as there are buckets at most
        if not touched:
            return self._publish(now["folders"], batch)
        old = self._read({b: f for b, f in now["folders"].items() if b in touched})
        kept = old.join(keys.distinct(), self.key, "left_anti")
        made = self._write(kept.unionByName(changed))
        forget(changed)
        return self._publish({b: f for b, f in now["folders"].items() if b not in touched} | made, batch)

    def clean(self, keep: int = 2) -> None:
        """Delete all but the newest ``keep`` versions, and folders that none of them names."""
        versions = self.versions()
        kept = versions[-keep:]
        used = {f for v in kept for f in self.manifest(v)["folders"].values()}
        for v in versions[:-keep]:
            remove(self.spark, f"{self.path}/versions/{v}")
        where = self._path("data")
        for made in self._fs.listStatus(where) if self._fs.exists(where) else []:
            name = f"data/{made.getPath().getName()}"
            for part in self._fs.listStatus(made.getPath()):
                inner = part.getPath().getName()
                if inner.startswith("_bucket=") and f"{name}/{inner}" not in used:
                    remove(self.spark, f"{self.path}/{name}/{inner}")
            if not any(f.startswith(f"{name}/") for f in used):
                remove(self.spark, f"{self.path}/{name}")
