"""Small files in the shared file system: manifests that are put only where there is none yet."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Store:
    """A folder of the shared file system.

    A commit is one small file, put under its final name only if there is none: of two writers one wins, and readers see
    the whole file or none. Folders are never renamed, so nothing depends on renames of many objects being atomic.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str = "") -> list[str]:
        """Sorted names in a folder, without hidden ones; none if it isn't there."""
        at = self._at(folder)
        found = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(n for n in found if n[:1] not in "._")

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """Put a file if there is none of that name; False if there is one."""
        part = self._at(f"_pending-{uuid.uuid4().hex}")
        self._fs.mkdirs(self._at(name).getParent())
        stream = self._fs.create(part)
        stream.write(bytearray(text.encode()))
        stream.close()
        gateway = self.spark.sparkContext._gateway
        options = gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self._context.rename(part, self._at(name), options)
            return True
        except Exception as e:
            self._fs.delete(part, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


class Versions:
    """Numbered JSON manifests; the newest is the table."""

    def __init__(self, store: Store, folder: str = "versions"):
        self.store, self.folder = store, folder

    def newest(self) -> dict | None:
        names = self.store.names(self.folder)
        return json.loads(self.store.read(f"{self.folder}/{names[-1]}")) if names else None

    def commit(self, number: int, manifest: dict) -> None:
        if not self.store.put_new(f"{self.folder}/v{number:010d}", json.dumps(manifest)):
            raise RuntimeError(f"another writer has committed version {number}")
