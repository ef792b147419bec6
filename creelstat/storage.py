"""Small files and moves below one folder of whatever file system Spark writes results to."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    """Names are relative to the folder. Only marker files of a few bytes pass through the driver."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm = spark._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark._jsc.hadoopConfiguration()
        root = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = root.getFileSystem(self._conf)
        self._root = self._fs.makeQualified(root)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._root, name)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def rename(self, old: str, new: str) -> None:
        if not self._fs.rename(self._at(old), self._at(new)):
            raise OSError(f"{self._at(old)} can't be moved to {self._at(new)}")

    def write_new(self, name: str, text: str) -> None:
        """A small file that must not exist yet."""
        out = self._fs.create(self._at(name), False)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()

    def read(self, name: str) -> str | None:
        """A small file's text, None where there is none."""
        if not self.exists(name):
            return None
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """A small file replaced in one step: readers see the old text or the new one."""
        fresh = f".{name}-{uuid.uuid4().hex}"
        self.write_new(fresh, text)
        fs = self._jvm.org.apache.hadoop.fs
        options = self._gateway.new_array(getattr(fs, "Options$Rename"), 1)
        options[0] = getattr(fs, "Options$Rename").OVERWRITE
        fs.FileContext.getFileContext(self._root.toUri(), self._conf).rename(self._at(fresh), self._at(name), options)
