"""Small marker files on any file system of Spark's."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm, self._gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _system(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def names(self, folder: str) -> list[str]:
        fs = self._system(folder)
        if not fs.exists(self._path(folder)):
            return []
        found = [x.getPath().getName() for x in fs.listStatus(self._path(folder))]
        return sorted(n for n in found if not n.startswith((".", "_")))

    def get(self, path: str) -> str:
        stream = self._system(path).open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, path: str, text: str) -> bool:
        """Whether the file is new: it is written aside and renamed, and the rename
        fails where the name is taken, so of two writers one loses."""
        folder, _, name = path.rpartition("/")
        aside = f"{folder}/_{name}-{uuid.uuid4().hex}"
        stream = self._system(aside).create(self._path(aside), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._system(path).getUri(), self._conf)
        keep = self._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self._system(aside).makeQualified(self._path(aside)), self._system(path).makeQualified(self._path(path)), keep)
        except Exception as e:
            self.remove(aside)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def remove(self, path: str) -> None:
        self._system(path).delete(self._path(path), True)
