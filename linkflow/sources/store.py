"""Snapshots of tables: immutable Parquet folders and a pointer to the newest; the swap of the pointer commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class SnapshotStore:
    """Versions of one table under ``path`` (any Hadoop file system)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Committed versions, oldest first: those whose folder has a commit mark."""
        if not self._fs.exists(self._path(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        found = [int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit()]
        return sorted(v for v in found if self._fs.exists(self._path(f"{self.path}/v={v}/_SUCCESS")))

    def read(self, version: int | None = None) -> DataFrame:
        """The newest version, or the one asked for; ``LookupError`` if there is none."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise LookupError(f"no version {version or ''} in {self.path}")
        return self.spark.read.parquet(f"{self.path}/v={known[-1] if version is None else version}")

    def write(self, df: DataFrame) -> int:
        """Write the next version and return its number; readers see it once it is complete."""
        known = self.versions()
        version = known[-1] + 1 if known else 1
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")
        return version

    def trim(self, keep: int = 2) -> None:
        """Delete all but the newest ``keep`` versions."""
        for v in self.versions()[:-keep]:
            self._fs.delete(self._path(f"{self.path}/v={v}"), True)
