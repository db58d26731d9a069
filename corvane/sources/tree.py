"""A data source of files below a folder: planned by folder, pruned by path before anything is opened.

    spark.dataSource.register(FileTree)
    spark.read.format("file_tree").option("root", "/data/raw").option("suffixes", ".jpg,.png").load()

Rows are (src_path, raw_rel_path, length, content) of all files, hidden ones included. The driver lists folders only
until there is a part for every task; the parts are folders, and shares of folders with many files or bytes, which tasks
list further and read in batches of bounded size. Filters on raw_rel_path that fix how it begins or name it prune folders
that cannot hold such a path, and with the others files before they are opened. Option sha256=true adds each file's hash,
taken piece by piece, so that a file of any size needs the memory of one piece. With option content=false no content is
held, and without sha256 no file is opened at all; files above max_bytes come without content, yet with their hash. Roots
are paths that all machines share or URIs that Arrow's file systems read (file, s3, gs, hdfs).
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql import types as T

BATCH_BYTES, BATCH_ROWS = 32 << 20, 10_000
SHARE, SHARE_BYTES = 5_000, 128 << 20  # files of one folder in a task, and their bytes where they are read
PIECE = 4 << 20  # bytes of a file that are hashed at a time


def wants(options: dict[str, str], name: str, default: str = "false") -> bool:
    return options.get(name, default).lower() == "true"


def located(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it."""
    if "://" in root or root.startswith("file:"):
        if root.startswith("file:") and not root.startswith("file://"):
            root = "file://" + root[len("file:") :]
        if root.startswith("file://"):  # as written: a percent sign is itself
            return pafs.LocalFileSystem(), root[len("file://") :]
        return pafs.FileSystem.from_uri(root)
    return pafs.LocalFileSystem(), os.path.abspath(root)


@dataclass
class Wanted:
    """What paths can be: all of the tests hold."""

    begins: list[tuple[str, ...]] = field(default_factory=list)  # one of each
    names: list[frozenset[str]] = field(default_factory=list)
    ends: list[str] = field(default_factory=list)
    holds: list[str] = field(default_factory=list)
    suffixes: tuple[str, ...] = ()

    def file(self, rel: str) -> bool:
        if self.suffixes:
            name = rel.rsplit("/", 1)[-1]
            stem, dot, ext = name.rpartition(".")
            if not (stem and ext and (dot + ext).lower() in self.suffixes):
                return False
        return (
            all(rel.startswith(b) for b in self.begins)
            and all(rel in n for n in self.names)
            and all(rel.endswith(e) for e in self.ends)
            and all(h in rel for h in self.holds)
        )

    def folder(self, rel: str) -> bool:
        """Whether a file below may pass."""
        below = rel + "/"
        return all(below.startswith(b) or b[0].startswith(below) for b in self.begins) and all(any(n.startswith(below) for n in names) for names in self.names)


@dataclass
class Part(InputPartition):
    folders: list[str]  # to walk to the bottom
    shallow: list[tuple[str, int, int]]  # (folder, share, shares): files of the folder itself only


def hashed(fs: pafs.FileSystem, path: str) -> str:
    """The SHA-256 of a file of any size; one piece of it is in memory."""
    said = hashlib.sha256()
    with fs.open_input_file(path) as file:
        while piece := file.read(PIECE):
            said.update(piece)
    return said.hexdigest()


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.content, self.sha256 = options["root"].rstrip("/") or "/", wants(options, "content", "true"), wants(options, "sha256")
        self.parts, self.most = int(options.get("parts", 64)), int(options.get("max_bytes", 1 << 31))
        self.wanted = Wanted(suffixes=tuple(x.strip().lower() for x in options.get("suffixes", "").split(",") if x.strip()))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != ("raw_rel_path",):
                yield f
            elif isinstance(f, StringStartsWith):
                self.wanted.begins.append((f.value,))
            elif isinstance(f, EqualTo):
                self.wanted.names.append(frozenset([f.value]))
            elif isinstance(f, In):
                self.wanted.names.append(frozenset(f.value))
            elif isinstance(f, StringEndsWith):
                self.wanted.ends.append(f.value)
            elif isinstance(f, StringContains):
                self.wanted.holds.append(f.value)
            else:
                yield f

    def _list(self, fs: pafs.FileSystem, base: str, rel: str) -> tuple[list[str], list[tuple[str, int]]]:
        """Folders and (file, length) directly in a folder, in order, as far as they may count."""
        where = f"{base}/{rel}" if rel else base
        folders, files = [], []
        for info in fs.get_file_info(pafs.FileSelector(where, allow_not_found=False)):
            path = f"{rel}/{info.base_name}" if rel else info.base_name
            if info.type == pafs.FileType.Directory:
                if self.wanted.folder(path):
                    folders.append(path)
            elif info.type == pafs.FileType.File and self.wanted.file(path):
                files.append((path, info.size))
        return sorted(folders), sorted(files)

    def partitions(self) -> list[Part]:
        fs, base = located(self.root)
        if fs.get_file_info(base).type == pafs.FileType.File:
            return [Part([], [("", 0, 1)])]
        level, shallow, found = [""], [], 0
        while level and len(level) + found < self.parts:
            following = []
            for rel in level:
                folders, files = self._list(fs, base, rel)
                shares = -(-len(files) // SHARE)
                found += shares
                if self.content or self.sha256:
                    shares = max(shares, min(len(files), -(-sum(size for _, size in files) // SHARE_BYTES)))
                shallow += [(rel, k, shares) for k in range(shares)]
                following += folders
            level = following
        out = [Part([f], []) for f in level[: self.parts]]
        for i, f in enumerate(level[self.parts :]):
            out[i % self.parts].folders.append(f)
        return out + [Part([], [s]) for s in shallow] or [Part([], [])]

    def _files(self, part: Part, fs: pafs.FileSystem, base: str) -> Iterator[tuple[str, int]]:
        if fs.get_file_info(base).type == pafs.FileType.File:
            name = base.rsplit("/", 1)[-1]
            if self.wanted.file(name):
                yield name, fs.get_file_info(base).size
            return
        for rel, share, shares in part.shallow:
            # the largest first: no share holds more than its largest file and an even share of the rest
            yield from sorted(self._list(fs, base, rel)[1], key=lambda f: (-f[1], f[0]))[share::shares]
        waiting = list(part.folders)
        while waiting:
            folders, files = self._list(fs, base, waiting.pop())
            waiting += folders
            yield from files

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        fs, base = located(self.root)
        single = fs.get_file_info(base).type == pafs.FileType.File
        kinds = [("src_path", pa.string()), ("raw_rel_path", pa.string()), ("length", pa.int64())]
        kinds += [("sha256", pa.string())] * self.sha256 + [("content", pa.binary())] * self.content
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], [n for n, _ in kinds])

        for rel, size in self._files(part, fs, base):
            path = base if single else f"{base}/{rel}"
            row, data = [path, rel, size], None
            if self.content and size <= self.most:
                if rows and held + size > BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
                with fs.open_input_file(path) as file:
                    data = file.read()
                held += size
            if self.sha256:
                row.append(hashed(fs, path) if data is None else hashlib.sha256(data).hexdigest())
            rows.append(row + [data] * self.content)
            if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        more = ", sha256 string" * wants(self.options, "sha256") + ", content binary" * wants(self.options, "content", "true")
        return "src_path string, raw_rel_path string, length bigint" + more

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def scan(spark: SparkSession, root: str, suffixes=(), content: bool = True, parts: int = 64, sha256: bool = False) -> DataFrame:
    """The files below root, or root itself if it is a file. Turns on the session's pushing of filters to Python sources,
    which is off by default."""
    spark.dataSource.register(FileTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"root": str(root), "suffixes": ",".join(suffixes), "content": str(content).lower(), "sha256": str(sha256).lower(), "parts": str(parts)}
    return spark.read.format("file_tree").options(**options).load()


def with_content(rows: DataFrame, root: str, path: str) -> DataFrame:
    """Adds the content of each row's file `path` below root, read where the row is: nothing is listed, joined or shuffled."""
    kept = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = located(root.rstrip("/"))
        for batch in batches:
            at, held, data = 0, 0, []
            names = batch.column(path).to_pylist()
            for i, name in enumerate(names):
                data.append(fs.open_input_file(f"{base}/{name}").read())
                held += len(data[-1])
                if held >= BATCH_BYTES or i + 1 == len(names):
                    part = batch.slice(at, i + 1 - at)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())], [*kept, "content"])
                    at, held, data = i + 1, 0, []

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("content", T.BinaryType())]))
