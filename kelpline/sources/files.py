"""Small files on whatever file system Spark can reach, through Hadoop's interface."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """Operations on paths of any file system; the driver only."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.conf), where

    def names(self, folder: str) -> list[str]:
        """Names in *folder*; none if there is no such folder."""
        fs, where = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def read(self, path: str) -> str:
        fs, where = self._at(path)
        stream = fs.open(where)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a whole new file at once: beside it, then renamed.  False if another is there by then."""
        fs, where = self._at(path)
        _, beside = self._at(f"{path}.{self.jvm.java.util.UUID.randomUUID()}.part")
        if fs.exists(where):
            return False
        stream = fs.create(beside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        done = fs.rename(beside, where)
        if not done:
            fs.delete(beside, False)
        return done

    def remove(self, path: str) -> None:
        fs, where = self._at(path)
        fs.delete(where, True)
