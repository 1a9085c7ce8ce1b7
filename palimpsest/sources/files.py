"""Files of a folder that all of a cluster shares, by Hadoop's file systems: listing, reading, and creating a file only once."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.hadoop = spark, spark._jvm.org.apache.hadoop.fs

    def _at(self, path: str):
        jpath = self.hadoop.Path(path)
        return jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()), jpath

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def names(self, path: str) -> dict[str, int]:
        """The names in a folder, with the milliseconds of their last change; none if there is no folder."""
        fs, at = self._at(path)
        if not fs.exists(at):
            return {}
        return {f.getPath().getName(): f.getModificationTime() for f in fs.listStatus(at)}

    def read(self, path: str) -> str | None:
        fs, at = self._at(path)
        try:
            opened = fs.open(at)
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() in ("FileNotFoundException", "NoSuchFileException"):
                return None
            raise
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8")
        finally:
            opened.close()

    def _write(self, path: str, text: str):
        fs, new = self._at(f"{path}.{uuid.uuid4().hex}.tmp")
        out = fs.create(new, True)
        out.write(bytearray(text.encode()))
        out.close()
        return fs, new

    def create(self, path: str, text: str) -> bool:
        """Makes the file, whole at once, unless there is one; whether it did. Of several that try, one does.

        On a local file system that is a hard link to a finished file, elsewhere a rename that doesn't overwrite."""
        fs, new = self._write(path, text)
        _, at = self._at(path)
        try:
            if fs.getScheme() == "file":
                jvm = self.spark._jvm
                local = lambda p: jvm.java.nio.file.Paths.get(jvm.java.net.URI.create("file://" + p.toUri().getRawPath()))
                jvm.java.nio.file.Files.createLink(local(at), local(new))
            else:
                self._rename(fs, new, at, "NONE")
            return True
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        finally:
            fs.delete(new, False)

    def replace(self, path: str, text: str) -> None:
        """Makes the file or replaces it in one step."""
        fs, new = self._write(path, text)
        self._rename(fs, new, self._at(path)[1], "OVERWRITE")

    def _rename(self, fs, a, b, how: str) -> None:
        options = self.spark._sc._gateway.new_array(self.hadoop.Options.Rename, 1)
        options[0] = getattr(self.hadoop.Options.Rename, how)
        self.hadoop.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(a, b, options)

    def delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)

    def size(self, path: str) -> int:
        fs, at = self._at(path)
        return fs.getContentSummary(at).getLength() if fs.exists(at) else 0
