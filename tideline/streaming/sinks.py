"""Sinks that take a batch's rows whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import Files


class BatchSink:
    """Effects or messages under a folder: begin, consume, then commit or rollback.

    A batch is written aside and becomes visible when its marker, named by the
    batch alone, is put in place; a batch that was committed before, as after a
    restart, is dropped. Readers see whole batches only.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files, self.root = spark, Files(spark), root.rstrip("/")
        self._open: tuple[int, list[str]] | None = None

    def begin(self, batch_id: int) -> None:
        if self._open:
            raise RuntimeError("a batch is open")
        self._open = (batch_id, [])

    def consume(self, rows: DataFrame) -> None:
        if not self._open:
            raise RuntimeError("no batch is open")
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/rows/{name}")
        self._open[1].append(name)

    def rollback(self) -> None:
        if self._open:
            for name in self._open[1]:
                self.files.remove(f"{self.root}/rows/{name}")
        self._open = None

    def commit(self) -> bool:
        """Whether the batch is new; one that was committed before is rolled back."""
        if not self._open:
            raise RuntimeError("no batch is open")
        batch_id, names = self._open
        if not self.files.put(f"{self.root}/batches/{batch_id:020d}", "\n".join(names)):
            self.rollback()
            return False
        self._open = None
        return True

    def batches(self) -> list[int]:
        return sorted(int(n) for n in self.files.names(f"{self.root}/batches"))

    def read(self) -> DataFrame:
        """The rows of all committed batches."""
        names = [n for b in self.batches() for n in self.files.get(f"{self.root}/batches/{b:020d}").split("\n") if n]
        return self.spark.read.parquet(*[f"{self.root}/rows/{n}" for n in names])

    def writer(self, effects):
        """A foreachBatch function; effects maps a micro-batch to the rows to keep,
        and if it or the write fails nothing of the batch is kept."""

        def run(batch: DataFrame, batch_id: int) -> None:
            self.begin(batch_id)
            try:
                self.consume(effects(batch))
            except Exception:
                self.rollback()
                raise
            self.commit()

        return run
