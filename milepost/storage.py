"""Small files and folders through Hadoop's file system, so that they may lie
on any store that Spark reads."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    """Files below ``base``; paths are relative to it."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._hadoop.Path(self.base).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._hadoop.Path(f"{self.base}/{path}" if path else self.base)

    def names(self, path: str = "") -> list[str]:
        """Names in a folder, sorted; none if it isn't there."""
        at = self._path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_new(self, path: str, text: str, replace: bool = False) -> bool:
        """Write a file whole or not at all; False if it is there already
        (``replace``: take its place)."""
        folder, _, _ = path.rpartition("/")
        draft = self._path(f"{folder}/.{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf)
        rename = self._hadoop.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1 if replace else 0)
        if replace:
            options[0] = rename.OVERWRITE
        try:
            context.rename(draft, self._path(path), options)
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)
