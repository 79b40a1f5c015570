"""Paths of any file system that the cluster knows, through Hadoop's interface."""

from __future__ import annotations

from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """A path and what lies below it; relative names are joined with a slash."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/") or "/"
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def at(self, name: str = "") -> str:
        return f"{self.root}/{name}" if name else self.root

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(self.at(name)))

    def is_folder(self, name: str = "") -> bool:
        return self.exists(name) and self._fs.getFileStatus(self._path(self.at(name))).isDirectory()

    def names(self, name: str = "") -> list[str]:
        """Names directly below, sorted; none where there is no folder."""
        path = self._path(self.at(name))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def files(self) -> Iterator[str]:
        """Names of all files below, with their folders."""
        base = self._fs.makeQualified(self._path(self.root)).toString().rstrip("/") + "/"
        found = self._fs.listFiles(self._path(self.root), True)
        while found.hasNext():
            yield found.next().getPath().toString().removeprefix(base)

    def make(self) -> None:
        self._fs.mkdirs(self._path(self.root))

    def read_text(self, name: str) -> str:
        stream = self._fs.open(self._path(self.at(name)))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str, draft: str) -> bool:
        """Writes a file as a whole, unless there is one of this name; whether it did. ``draft`` is a name of its own."""
        stream = self._fs.create(self._path(self.at(draft)), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(self._path(self.at(draft)), self._path(self.at(name)), plain)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            self._fs.delete(self._path(self.at(draft)), False)
            return False
        return True
