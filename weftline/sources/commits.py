"""A folder of numbered commits: what tables that change by whole versions share.

Commit N is a small JSON file; creating it is the one step that makes a version
visible, and a number can be created once. Data folders are written before
under names of their own, so readers see whole versions and a lost job leaves
nothing half done. Paths go through Spark's file systems.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class OtherWriter(RuntimeError):
    """Another writer committed what this one can't be put after."""


class Commits:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, name: str = "") -> list[str]:
        fs, path = self._fs(), self._path(name)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def size(self, name: str) -> int:
        """Bytes under a folder."""
        fs, path = self._fs(), self._path(name)
        return fs.getContentSummary(path).getLength() if fs.exists(path) else 0

    def numbers(self) -> list[int]:
        return sorted(int(n.removeprefix("commit-")) for n in self.names() if n.startswith("commit-"))

    def newest(self) -> int | None:
        return max(self.numbers(), default=None)

    def content(self, number: int) -> dict:
        fs, path = self._fs(), self._path(f"commit-{number:012d}")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def add(self, number: int, content: dict) -> int:
        """Commit under this number; OtherWriter if it is taken."""
        try:
            out = self._fs().create(self._path(f"commit-{number:012d}"), False)
        except Py4JJavaError as error:
            if "AlreadyExists" in str(error.java_exception):
                raise OtherWriter(f"version {number} is there already") from error
            raise
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        return number

    def fresh_folder(self, kind: str) -> str:
        return f"{kind}-{uuid.uuid4().hex}"

    def clean(self, keep: int, named: set[str], kinds: tuple[str, ...]) -> list[str]:
        """Delete all commits but the newest ``keep``, and folders of these kinds
        that none of the ``named`` is; returns what went. A writer that has not
        committed yet loses its folder, so clean while none is at work."""
        gone = [f"commit-{n:012d}" for n in self.numbers()[:-keep]]
        gone += [n for n in self.names() if n.partition("-")[0] in kinds and n not in named]
        for name in gone:
            self._fs().delete(self._path(name), True)
        return gone
