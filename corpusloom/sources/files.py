"""Files on any file system that Spark reads: listing, reading and writing small ones, renaming."""

from __future__ import annotations

from pyspark.sql import SparkSession


class FileSystem:
    """Through the session's Hadoop configuration; without a session the active one."""

    def __init__(self, spark: SparkSession | None = None) -> None:
        spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        self._jvm, self._conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def is_file(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isFile()

    def is_dir(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isDirectory()

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p))

    def walk(self, path: str) -> list[str]:
        """All files below, by name; hidden ones (``_`` or ``.`` in front) are left out."""
        fs, p = self._at(path)
        out = []
        for s in sorted(fs.listStatus(p), key=lambda s: s.getPath().getName()):
            name = s.getPath().getName()
            if name[0] in "._":
                continue
            child = f"{path.rstrip('/')}/{name}"
            out += self.walk(child) if s.isDirectory() else [child]
        return out

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Whole or not at all: written beside and renamed over."""
        fs, p = self._at(path)
        beside = self._jvm.org.apache.hadoop.fs.Path(path + ".tmp")
        out = fs.create(beside, True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        fs.delete(p, False)
        if not fs.rename(beside, p):
            raise OSError(f"cannot rename {path}.tmp")

    def move(self, old: str, new: str) -> None:
        fs, p = self._at(old)
        _, q = self._at(new)
        fs.delete(q, False)
        if not fs.rename(p, q):
            raise OSError(f"cannot rename {old} to {new}")

    def remove(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)
