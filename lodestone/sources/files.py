"""Small files and folders wherever Spark can write, through Hadoop's file systems."""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession


class Folder:
    """A folder and what stands in it, by relative names."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str = ""):
        jvm = self.spark.sparkContext._jvm
        return jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _system(self):
        return self.path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str = "") -> bool:
        return self._system().exists(self.path(name))

    def names(self, name: str = "") -> list[str]:
        fs = self._system()
        return sorted(s.getPath().getName() for s in fs.listStatus(self.path(name))) if fs.exists(self.path(name)) else []

    def read(self, name: str) -> str:
        """A small file's text."""
        source = self._system().open(self.path(name))
        try:
            return bytes(source.readAllBytes()).decode("utf-8")
        finally:
            source.close()

    def write(self, name: str, text: str) -> None:
        """Writes a small file whole, under another name first, and then moves it to its place."""
        fs, tmp = self._system(), self.path(f"{name}.tmp")
        sink = fs.create(tmp, True)
        try:
            sink.write(bytearray(text.encode("utf-8")))
        finally:
            sink.close()
        if fs.exists(self.path(name)):
            fs.delete(self.path(name), False)
        if not fs.rename(tmp, self.path(name)):
            raise OSError(f"{self.root}/{name} could not be written")

    def rename(self, old: str, new: str) -> None:
        if not self._system().rename(self.path(old), self.path(new)):
            raise OSError(f"{self.root}/{old} could not be renamed")

    def remove(self, name: str = "") -> None:
        try:
            self._system().delete(self.path(name), True)
        except (Py4JError, OSError, AttributeError):  # the session has already ended
            return
