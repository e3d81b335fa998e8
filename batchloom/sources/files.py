"""Small metadata files on any Hadoop file system, published whole or not at all."""

from __future__ import annotations

import uuid

from pyspark import SparkContext
from pyspark.sql import SparkSession

from ..errors import StateError


class Files:
    """Text files below a root folder, through Hadoop's FileContext."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)
        # A root without a scheme belongs to the default file system, as for Spark's own readers.
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def modified(self, name: str) -> float:
        """Seconds since 1970 of the last change."""
        return self._fs.getFileStatus(self._path(name)).getModificationTime() / 1000

    def read(self, name: str) -> str | None:
        path = self._path(name)
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str, replace: bool = False) -> None:
        """Write beside the target and rename; StateError if it exists and may not be replaced."""
        folder = name.rpartition("/")[0]
        hidden = self._path(f"{folder}/_tmp-{uuid.uuid4().hex}" if folder else f"_tmp-{uuid.uuid4().hex}")
        stream = self._fs.create(hidden, True)
        try:
            stream.write(bytearray(text.encode()))
            stream.hflush()
        finally:
            stream.close()
        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = _array(kind, [kind.OVERWRITE] if replace else [kind.NONE])
        try:
            self._context.rename(hidden, self._path(name), how)
        except Exception as e:
            self._fs.delete(hidden, False)
            if "exist" in str(e).lower():
                raise StateError(f"{name} exists already: another writer was first") from None
            raise

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


def _array(kind, values: list):
    out = SparkContext._gateway.new_array(kind, len(values))
    for i, v in enumerate(values):
        out[i] = v
    return out
