"""Control files of one folder, on the file system that its path names."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class Files:
    """Small files and folders under ``folder``: a local path, or any that Hadoop knows, as for the tables themselves.

    ``publish`` creates a name once and whole: by a hard link on local file systems, by a rename that refuses to replace
    on others."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, str(folder).rstrip("/")
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._at("").getFileSystem(self._conf)
        self.local = self._fs.getUri().getScheme() == "file"

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))

    def path(self, name: str = "") -> str:
        return f"{self.folder}/{name}" if name else self.folder

    def make(self) -> None:
        self._fs.mkdirs(self._at(""))

    def list(self, name: str = "") -> dict[str, tuple[bool, int, float]]:
        """Names in a folder: whether it is one, its bytes, and seconds of its last change; nothing if there is no folder."""
        if not self._fs.exists(self._at(name)):
            return {}
        return {s.getPath().getName(): (s.isDirectory(), s.getLen(), s.getModificationTime() / 1000) for s in self._fs.listStatus(self._at(name))}

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        stream = self._fs.create(self._at(name), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def publish(self, name: str, text: str) -> None:
        """Create a file that readers never see in part; FileExistsError if the name is taken."""
        part = f".part-{uuid.uuid4().hex}"
        self.put(part, text)
        try:
            if self.local:
                plain = [self._at(n).toUri().getPath() for n in (part, name)]
                os.link(*plain)
            else:
                self._rename(part, name)
        finally:
            self.remove(part)

    def _rename(self, old: str, new: str) -> None:
        jvm = self.spark._jvm
        if self._fs.exists(self._at(new)):
            raise FileExistsError(new)
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self._conf).rename(self._at(old), self._at(new), none)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise FileExistsError(new) from None
            raise

    def remove(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)

    def copy(self, name: str, other: Files) -> None:
        self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(self._fs, self._at(name), other._fs, other._at(name), False, self._conf)
