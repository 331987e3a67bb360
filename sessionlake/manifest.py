"""Which folders make up a table that grows in parts.

A commit writes one small file, `_manifest/<version>`, with the names of all folders that
count, and removes an old version. Nobody lists the folders themselves: a reader lists the few
versions and reads the newest, so the file calls of a commit and of a reader do not depend on
how many commits came before. A folder that no version names does not exist for a reader, so
a writer that fails in between leaves nothing to see.

There is one writer at a time. Folders that a commit replaces stay for `RETAINED` seconds, for
readers that go on with an earlier version.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterable

from pyspark.sql import SparkSession

FAN = 10  # parts of one level that are merged into one of the next
KEPT = 3  # versions that stay
RETAINED = 3600.0
MOST_REMOVED = 2 * FAN  # folders one commit removes: more than it replaces, so none are left over


class Files:
    """The file calls of a manifest, on the file system of its path."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._root = spark.sparkContext._jvm, path
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self._root}/{name}" if name else self._root)

    def names(self, folder: str) -> list[str]:
        if not self._fs.exists(self._at(folder)):
            return []
        return [f.getPath().getName() for f in self._fs.listStatus(self._at(folder))]

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Whole or not at all: the file gets its name when it is complete."""
        unnamed = self._at(f"{name}.part")
        stream = self._fs.create(unnamed, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self._fs.rename(unnamed, self._at(name)):
            raise OSError(f"{self._root}/{name} is there already: a manifest has one writer at a time")

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


class Manifest:
    """The newest version of a folder's list; `content` is None before the first commit."""

    def __init__(self, spark: SparkSession, path: str, files: Files | None = None):
        self.path, self._files = path, files or Files(spark, path)
        self._versions = sorted(int(n) for n in self._files.names("_manifest") if n.isdigit())
        self._version = self._versions[-1] if self._versions else 0
        stored = json.loads(self._files.read(f"_manifest/{self._version}")) if self._versions else {}
        self.content: dict | None = stored.get("content")
        self._replaced: list[list] = stored.get("replaced", [])

    def commit(self, content: dict, replaced: Iterable[str] = (), retained: float = RETAINED) -> None:
        """Make `content` the newest version. The folders in `replaced` are removed by a later
        commit, once they have been out of use for so many seconds."""
        now = time.time()
        expired = [name for name, since in self._replaced if since <= now - retained][:MOST_REMOVED]
        for name in expired:
            self._files.delete(name)
        kept = [[n, t] for n, t in self._replaced if n not in expired] + [[n, now] for n in replaced]
        self._version += 1
        self._files.write(f"_manifest/{self._version}", json.dumps({"content": content, "replaced": kept}))
        for old in [v for v in self._versions if v <= self._version - KEPT]:
            self._files.delete(f"_manifest/{old}")
            self._versions.remove(old)
        self._versions.append(self._version)
        self.content, self._replaced = content, kept


def full_level(sizes: dict[str, int]) -> list[str]:
    """The oldest parts of the lowest level that has `FAN` of them, in the given order; none
    while no level is full. A part's level is the number of digits of its size."""
    levels: dict[int, list[str]] = {}
    for name, size in sizes.items():
        levels.setdefault(len(str(size)), []).append(name)
    full = [level for level, names in levels.items() if len(names) >= FAN]
    return levels[min(full)][:FAN] if full else []
