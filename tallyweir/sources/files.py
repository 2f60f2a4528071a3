"""Small files on any file system that Spark reaches, through Hadoop's interface."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """Reads, writes and lists by full path (``hdfs://``, ``s3a://``, ``file://``, a plain local path)."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        found = self._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self._conf), found

    def qualified(self, path: str) -> str:
        fs, found = self._at(path)
        return fs.makeQualified(found).toString()

    def exists(self, path: str) -> bool:
        fs, found = self._at(path)
        return fs.exists(found)

    def names(self, folder: str) -> list[str]:
        fs, found = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(found)) if fs.exists(found) else []

    def make(self, folder: str) -> None:
        fs, found = self._at(folder)
        fs.mkdirs(found)

    def delete(self, path: str) -> None:
        fs, found = self._at(path)
        fs.delete(found, True)

    def read(self, path: str) -> str:
        """The whole file; ValueError if it can't be read or is damaged."""
        fs, found = self._at(path)
        try:
            stream = fs.open(found)
            try:
                return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
        except Py4JJavaError as error:
            raise ValueError(f"{path} can't be read") from error

    def write(self, path: str, text: str) -> None:
        """A new file that appears whole or not at all; OSError if it can't be written or is there."""
        fs, found = self._at(path)
        _, part = self._at(f"{path}.{uuid.uuid4().hex}.part")
        try:
            stream = fs.create(part, False)
            try:
                stream.write(bytearray(text.encode()))
                stream.hsync()
            finally:
                stream.close()
            if fs.exists(found) or not fs.rename(part, found):
                raise OSError(f"{path} can't be written")
        except Py4JJavaError as error:
            raise OSError(f"{path} can't be written") from error

    def claim(self, path: str) -> bool:
        """Makes an empty file unless it is there."""
        fs, found = self._at(path)
        try:
            return fs.createNewFile(found)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error):
                return False
            raise
