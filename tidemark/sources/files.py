"""Small files through Hadoop's file system, so any store that Spark reads will do."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """Text files and folders below any URI."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _open(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._open(path)
        return fs.exists(p)

    def read_text(self, path: str) -> str:
        fs, p = self._open(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        """Writes beside the target under a name of its own, then renames over it.

        Where a rename is atomic readers see the old or the new file; a store that copies
        instead may show none for a moment.
        """
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._jvm.org.apache.hadoop.fs.Path(path).toUri(), self._conf
        )
        fs, target = self._open(path)
        beside = self._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
        fs.mkdirs(target.getParent())
        stream = fs.create(beside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        overwrite = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        array = self._gateway_array(overwrite)
        context.rename(beside, target, array)

    def _gateway_array(self, option):
        from pyspark import SparkContext

        array = SparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        array[0] = option
        return array

    def names(self, folder: str) -> list[str]:
        """What lies directly in a folder; nothing where there is none."""
        fs, p = self._open(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self._open(path)
        fs.delete(p, True)
