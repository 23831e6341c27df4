"""Small files of a folder that all executors see, through Hadoop's file systems: listing, whole reads and atomic writes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset, on a local master, one is made."""
    context = spark.sparkContext
    at = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not at:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="shared-")
        context.setCheckpointDir(at)
    return at


class Files:
    """Files below one root; the driver's only work on them is with manifests of a few kilobytes."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(root).getFileSystem(self.conf)

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        """Names in a folder; none if it isn't there."""
        at = self._path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def age(self, path: str) -> float:
        """Seconds since the last change, by the clock of this machine."""
        return (self.jvm.java.lang.System.currentTimeMillis() - self.fs.getFileStatus(self._path(path)).getModificationTime()) / 1000

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, path: str, text: str) -> bool:
        """Whether the file was made: it appears with its whole text by one rename, and never in place of another one."""
        aside = f"{path}.{uuid.uuid4().hex}.part"
        stream = self.fs.create(self._path(aside), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        none = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._path(aside), self._path(path), none)
        except Exception:
            self.remove(aside)
            if self.fs.exists(self._path(path)):
                return False
            raise
        return True

    def remove(self, path: str) -> None:
        self.fs.delete(self._path(path), True)
