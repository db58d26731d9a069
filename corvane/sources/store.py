"""Folders and small documents in any store that Spark reads, and results that appear whole or not at all.

Everything goes through Hadoop's file system of the path, so a report folder may lie on a disk, in HDFS or in an object
store, and names may hold blanks, percent signs and the signs of patterns.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Entry:
    name: str
    path: str
    folder: bool
    size: int


class Store:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._hadoop = spark._jvm.org.apache.hadoop
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self._hadoop.fs.Path(str(path))
        return where.getFileSystem(self._conf), where

    def entries(self, folder: str) -> list[Entry]:
        """What a folder holds, by name; nothing if there is none."""
        fs, where = self._at(folder)
        if not fs.exists(where):
            return []
        found, out = fs.listStatusIterator(where), []
        while found.hasNext():
            s = found.next()
            out.append(Entry(s.getPath().getName(), s.getPath().toString(), s.isDirectory(), s.getLen()))
        return sorted(out, key=lambda e: e.name)

    def exists(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.exists(where)

    def holds_something(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.exists(where) and (not fs.getFileStatus(where).isDirectory() or fs.listStatusIterator(where).hasNext())

    def read_bytes(self, path: str, most: int = (1 << 31) - 9) -> bytes:
        """The first bytes of a file, all by default: for documents and artefacts, not for data."""
        fs, where = self._at(path)
        stream = fs.open(where)
        try:
            return bytes(stream.readNBytes(most))
        finally:
            stream.close()

    def read_text(self, path: str) -> str:
        return self.read_bytes(path).decode("utf-8-sig")

    def write_text(self, text: str, path: str) -> None:
        self.write_bytes(text.encode(), path)

    def write_bytes(self, data: bytes, path: str) -> None:
        """Under its name only when it is whole."""
        fs, where = self._at(path)
        part = self._hadoop.fs.Path(where.getParent(), f".{where.getName()}.{uuid.uuid4().hex}")
        stream = fs.create(part, True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        self._put(fs, part, where)

    def load_json(self, path: str):
        return json.loads(self.read_text(path))

    def save_json(self, data, path: str) -> None:
        self.write_text(json.dumps(data, ensure_ascii=False, indent=2), path)

    def delete(self, path: str) -> None:
        fs, where = self._at(path)
        fs.delete(where, True)

    def rename(self, source: str, target: str) -> None:
        (fs, a), (_, b) = self._at(source), self._at(target)
        fs.mkdirs(b.getParent())
        if not fs.rename(a, b):
            raise OSError(f"{source} could not be renamed to {target}")

    def _put(self, fs, part, where) -> None:
        if fs.exists(where):
            fs.delete(where, True)
        if not fs.rename(part, where):
            raise OSError(f"{part} could not be renamed to {where}")

    @contextlib.contextmanager
    def published(self, *targets: str, overwrite: bool = True) -> Iterator[list[str]]:
        """Folders to write in place of the targets. When all that is within ends well, they take the targets' names one
        after the other; what stood there is kept beside until the last one has, and comes back if one cannot. If anything
        fails before, the targets are as they were."""
        for t in targets:
            if not overwrite and self.holds_something(t):
                raise FileExistsError(f"{t} holds something")
        mark = uuid.uuid4().hex
        beside = lambda t, kind: f"{str(t).rstrip('/')}.{kind}-{mark}"
        staged, done = [beside(t, "staged") for t in targets], []
        try:
            yield staged
            for t, s in zip(targets, staged):
                if not self.exists(s):
                    continue
                if was := self.exists(t):
                    self.rename(t, beside(t, "before"))
                done.append((t, was))
                self.rename(s, t)
        except BaseException:
            for t, was in reversed(done):
                self.delete(t)
                if was:
                    self.rename(beside(t, "before"), t)
            raise
        finally:
            for s in staged:
                self.delete(s)
        for t, was in done:
            if was:
                self.delete(beside(t, "before"))
