"""Small text files on any Hadoop path, with atomic replacement and exclusive creation."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class SharedFiles:
    """Markers, manifests and pointers; tables themselves are read and written by Spark."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def _at(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _place(self, path: str, text: str, overwrite: bool) -> None:
        folder, name = path.rsplit("/", 1)
        aside = f"{folder}/_{name}.{uuid.uuid4().hex}.tmp"  # readers of the folder skip it
        fs, source = self._at(aside)
        stream = fs.create(source, True)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        _, target = self._at(path)
        hadoop, gateway = self.spark._jvm.org.apache.hadoop.fs, self.spark.sparkContext._gateway
        kinds = getattr(hadoop, "Options$Rename")
        option = gateway.new_array(kinds, 1)
        option[0] = kinds.OVERWRITE if overwrite else kinds.NONE
        context = hadoop.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(source), fs.makeQualified(target), option)
        finally:
            fs.delete(source, False)

    def write(self, path: str, text: str) -> None:
        """Write aside and rename, so readers see the old or the new content."""
        self._place(path, text, True)

    def create(self, path: str, text: str) -> bool:
        """Write whole content to a new path; False if another writer was first."""
        if self.exists(path):
            return False
        try:
            self._place(path, text, False)
        except Exception:
            if self.exists(path):
                return False
            raise
        return True

    def read(self, path: str) -> str | None:
        fs, target = self._at(path)
        if not fs.exists(target):
            return None
        stream = fs.open(target)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def exists(self, path: str) -> bool:
        fs, target = self._at(path)
        return fs.exists(target)

    def names(self, folder: str) -> list[str]:
        """Names directly below ``folder``, sorted, without hidden ones; none if it doesn't exist."""
        fs, target = self._at(folder)
        if not fs.exists(target):
            return []
        found = (s.getPath().getName() for s in fs.listStatus(target))
        return sorted(n for n in found if n[0] not in "._")

    def remove(self, path: str) -> None:
        fs, target = self._at(path)
        fs.delete(target, True)
