"""Small files (metadata) through Hadoop's file systems, so any store that Spark reaches will do."""

from __future__ import annotations

import gzip
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..errors import ConcurrentModification, NotFound

#: Hadoop file systems that refuse to rename to a file that exists.
RENAMES = ("hdfs", "viewfs", "ofs", "o3fs", "abfs", "abfss")


class Storage:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self._conf), at

    def exists(self, path: str) -> bool:
        files, at = self._at(path)
        return files.exists(at)

    def make_folder(self, path: str) -> None:
        files, at = self._at(path)
        files.mkdirs(at)

    def names(self, path: str, folders: bool | None = None) -> list[str]:
        """Names in a folder, in order; none if it doesn't exist."""
        files, at = self._at(path)
        if not files.exists(at):
            return []
        return sorted(s.getPath().getName() for s in files.listStatus(at) if folders is None or s.isDirectory() == folders)

    def read(self, path: str) -> str:
        """A text file; gzipped ones are told by their names."""
        files, at = self._at(path)
        if not files.exists(at):
            raise NotFound(path)
        stream = files.open(at)
        try:
            data = bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()
        return (gzip.decompress(data) if path.endswith((".gz.metadata.json", ".gz")) else data).decode()

    def create(self, path: str, text: str) -> None:
        """Write a file that mustn't exist, whole or not at all; if another was faster, it's a concurrent modification.

        Local files are written aside and linked, on file systems whose rename
        doesn't overwrite (RENAMES) they are written aside and renamed: a reader
        never sees a part, and of two writers one fails.  Object stores show a
        file only when it is closed, and refuse one that exists if they support
        conditional writes.
        """
        files, at = self._at(path)
        scheme = files.getUri().getScheme()
        exists = ConcurrentModification(f"{path} exists already")
        if files.exists(at):
            raise exists
        try:
            if scheme != "file" and scheme not in RENAMES:
                self._write(files, at, text)
                return
            files.mkdirs(at.getParent())
            aside = self._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.{uuid.uuid4().hex}.tmp")
            self._write(files, aside, text)
            try:
                if scheme == "file":
                    to_local = lambda x: self._jvm.java.io.File(x.toUri().getPath()).toPath()
                    self._jvm.java.nio.file.Files.createLink(to_local(at), to_local(aside))
                elif not files.rename(aside, at):
                    raise exists
            finally:
                files.delete(aside, False)
        except Py4JJavaError as why:
            if "exist" in str(why.java_exception).lower():
                raise exists from None
            raise

    def _write(self, files, at, text: str) -> None:
        stream = files.create(at, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def move(self, old: str, new: str) -> None:
        files, a = self._at(old)
        _, b = self._at(new)
        files.mkdirs(b.getParent())
        if not files.rename(a, b):
            raise ConcurrentModification(f"can't move {old} to {new}")

    def copy(self, old: str, new: str) -> None:
        from_files, a = self._at(old)
        to_files, b = self._at(new)
        to_files.mkdirs(b.getParent())
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(from_files, a, to_files, b, False, self._conf)

    def delete(self, path: str) -> None:
        files, at = self._at(path)
        files.delete(at, True)
