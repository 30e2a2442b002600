"""Versioned tables: a version is written whole, then the pointer to it moves."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import Files


class Snapshots:
    """Versions of a table under a folder on any file system of Spark's.

    A version is visible once its marker is in place, a file that is named by the
    version alone: of two commits from one version the second is refused.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def versions(self) -> list[int]:
        return [int(n) for n in self.files.names(f"{self.root}/versions")]

    def version(self) -> int:
        return max(self.versions(), default=0)

    def _marker(self, version: int) -> str:
        return f"{self.root}/versions/{version:012d}"

    def commit(self, rows: DataFrame, expected: int | None = None) -> int:
        """Writes rows as the next version; ``expected`` is the one they were made from."""
        now = self.version() if expected is None else expected
        if now != self.version():
            raise RuntimeError(f"version {self.version()} was committed since {now}")
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/rows/{name}")
        if not self.files.put(self._marker(now + 1), name):
            self.files.remove(f"{self.root}/rows/{name}")
            raise RuntimeError("another commit came first")
        return now + 1

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/rows/{self.files.get(self._marker(self.version() if version is None else version))}")

    def prune(self, keep: int = 3) -> None:
        """Removes the rows of all but the last versions, the current one never."""
        for version in self.versions()[: -max(keep, 1)]:
            self.files.remove(f"{self.root}/rows/{self.files.get(self._marker(version))}")
            self.files.remove(self._marker(version))

    def remove_graph(self, graph_id, column: str = "graph_id") -> int:
        """A version without one graph's rows."""
        now = self.version()
        return self.commit(self.read(now).filter(~F.col(column).eqNullSafe(F.lit(graph_id))), now)

    def remove(self) -> None:
        self.files.remove(self.root)


def graph_ids(commands: DataFrame) -> DataFrame:
    return commands.select("graph_id").distinct()
