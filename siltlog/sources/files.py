"""Small files of the driver, on any file system that Spark reads."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """Text files below a root folder, by Hadoop's FileSystem."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.root = root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self._path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self.at(name))

    def folder(self, name: str = "") -> None:
        self._fs.mkdirs(self.at(name))

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.at(folder))) if self.exists(folder) else []

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self.at(name)).getLength()

    def read(self, name: str) -> str:
        stream = self._fs.open(self.at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a new file; False if there is one already."""
        try:
            stream = self._fs.create(self.at(name), False)
        except Exception as e:
            if "already exists" in str(e) or "FileAlreadyExists" in str(e):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.hsync()  # on disk before another file names it
        stream.close()
        return True

    def replace(self, name: str, text: str) -> None:
        """Writes a file whole or not at all: to another name first, which then takes its place."""
        other = f"{name}.{uuid.uuid4().hex}.tmp"
        self.create(other, text)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at("").toUri())
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        options[0] = rename.OVERWRITE
        context.rename(context.makeQualified(self.at(other)), context.makeQualified(self.at(name)), options)

    def delete(self, name: str) -> None:
        """Missing files are no error."""
        self._fs.delete(self.at(name), True)
