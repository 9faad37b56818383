"""Tables in a folder that the driver and all executors share."""

from __future__ import annotations

import hashlib
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Where it is unset, a local session gets a folder of its own; a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Files:
    """The few file operations that Spark has no reader for, in whatever file system a path belongs to."""

    def __init__(self, spark: SparkSession, top: str):
        self.jvm = spark._jvm
        self.fs = self._path(top).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(path))) if self.exists(path) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str = "") -> bool:
        """False if there is such a file."""
        if self.exists(path):
            return False
        try:
            out = self.fs.create(self._path(path), False)
        except Exception:  # noqa: BLE001  another writer was there first
            return False
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def rename(self, old: str, new: str) -> bool:
        return not self.exists(new) and self.fs.rename(self._path(old), self._path(new))

    def age(self, path: str) -> float:
        """Seconds since a file was written."""
        return time.time() - self.fs.getFileStatus(self._path(path)).getModificationTime() / 1000

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)

    def state(self, path: str) -> str:
        """Names, sizes and times of the files of a table."""
        found, each = [], self.fs.listFiles(self._path(path), True)
        while each.hasNext():
            f = each.next()
            found.append(f"{f.getPath().toUri().getPath()}:{f.getLen()}:{f.getModificationTime()}")
        return ";".join(sorted(found))


def kept(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """A table that is built once for the state that its inputs (paths) are in, and read from then on. Of writers at the same time the first wins."""
    top = folder(spark)
    where = [Files(spark, p).state(p) for p in inputs]
    key = hashlib.sha1(repr((name, inputs, where)).encode()).hexdigest()[:16]
    path = f"{top}/kept/{name}-{key}"
    files = Files(spark, path)
    if not files.exists(f"{path}/_SUCCESS"):
        new = f"{top}/kept/.{name}-{uuid.uuid4().hex}"
        build().write.parquet(new)
        if not files.rename(new, path):
            files.delete(new)
    return spark.read.parquet(path)


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written and read again: cuts the lineage of a round."""
    path = f"{folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
