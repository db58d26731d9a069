"""Scalar logs as event files: framed records with masked CRC-32C checksums, as training dashboards read them.

A record is its length (8 bytes, little-endian), the masked checksum of those, the data, and the masked checksum of the
data. The data are the fields of one event: wall time (1, double), step (2, varint), file version (3, text), and a
summary (5) of values (1), each with a tag (1, text) and a number (2, float of 32 bits).
"""

from __future__ import annotations

import os
import struct
import time
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources.tree import located, scan

#: The reversed polynomial of CRC-32C, what is added to mask a checksum, the first record's text.
POLYNOMIAL, MASK, VERSION = 0x82F63B78, 0xA282EAD8, "brain.Event:2"


@lru_cache(1)
def _table() -> list[int]:
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = (byte >> 1) ^ (POLYNOMIAL if byte & 1 else 0)
        out.append(byte)
    return out


def crc32c(data: bytes) -> int:
    table, crc = _table(), 0xFFFFFFFF
    for b in data:
        crc = table[(crc ^ b) & 0xFF] ^ (crc >> 8)
    return crc ^ 0xFFFFFFFF


def masked(data: bytes) -> bytes:
    crc = crc32c(data)
    return struct.pack("<I", ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF)


def framed(data: bytes) -> bytes:
    size = struct.pack("<Q", len(data))
    return size + masked(size) + data + masked(data)


def varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _text(number: int, data: bytes) -> bytes:
    return bytes([number << 3 | 2]) + varint(len(data)) + data


def event(wall: float, step: int | None = None, tag: str | None = None, value: float = 0.0, version: str | None = None) -> bytes:
    out = b"\x09" + struct.pack("<d", wall)
    if step:
        out += b"\x10" + varint(step)
    if version is not None:
        out += _text(3, version.encode())
    if tag is not None:
        out += _text(5, _text(1, _text(1, tag.encode()) + b"\x15" + struct.pack("<f", value)))
    return out


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7)
        if size is None:
            size = number()
        yield key >> 3, data[at : at + size]
        at += size


def records(data: bytes) -> Iterator[bytes]:
    """The records of a file; a ValueError names the offset of the first damaged one."""
    at = 0
    while at < len(data):
        if len(data) < at + 12 or masked(data[at : at + 8]) != data[at + 8 : at + 12]:
            raise ValueError(f"record at byte {at}: its length is damaged")
        size = struct.unpack_from("<Q", data, at)[0]
        body = data[at + 12 : at + 12 + size]
        if len(body) < size or masked(body) != data[at + 12 + size : at + 16 + size]:
            raise ValueError(f"record at byte {at}: its data are damaged")
        yield body
        at += 16 + size


def scalars(data: bytes) -> Iterator[tuple[int, str, float]]:
    """(step, tag, value) of a file."""
    for record in records(data):
        fields = list(_fields(record))
        step = next((v for k, v in fields if k == 2), 0)
        for summary in (v for k, v in fields if k == 5):
            for value in (v for k, v in _fields(summary) if k == 1):
                parts = dict(_fields(value))
                if 2 in parts:
                    yield step, parts[1].decode(), struct.unpack("<f", parts[2])[0]


def write_events(log: DataFrame, folder: str, run: str = "run", wall: float | None = None) -> DataFrame:
    """(run string, if there is one, epoch, tag, value) rows to a file a run, in the order of epoch and tag, in a folder
    that all machines share. A run's log is one task's file: a row an epoch and tag, whatever the data it was trained on.
    Returns (run, path, rows)."""
    rows = log if "run" in log.columns else log.withColumn("run", F.lit(run))
    now = time.time() if wall is None else wall

    def put(table: pa.Table) -> pa.Table:
        name = table["run"][0].as_py()
        ordered = table.sort_by([("epoch", "ascending"), ("tag", "ascending")])
        data = [framed(event(now, version=VERSION))]
        for epoch, tag, value in zip(*(ordered[c].to_pylist() for c in ("epoch", "tag", "value"))):
            if value is not None:
                data.append(framed(event(now, epoch, tag, value)))
        fs, base = located(folder)
        fs.create_dir(f"{base}/{name}", recursive=True)
        path = f"{base}/{name}/events.out.tfevents.{int(now)}.{os.uname().nodename}"
        part = f"{base}/{name}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(part, compression=None) as out:
            out.write(b"".join(data))
        fs.move(part, path)
        return pa.table({"run": [name], "path": [path], "rows": pa.array([table.num_rows], pa.int64())})

    kept = rows.select("run", F.col("epoch").cast("long").alias("epoch"), "tag", F.col("value").cast("double").alias("value"))
    return kept.groupBy("run").applyInArrow(put, "run string, path string, rows long")


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """(run, epoch, tag, value, error) of all event files below a folder; a damaged file gives what stands before the
    damage and one row that says where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("raw_rel_path").to_pylist(), batch.column("content").to_pylist()):
                name, rows = path.rpartition("/")[0], []
                try:
                    for step, tag, value in scalars(data):
                        rows.append((name, step, tag, value, None))
                except ValueError as e:
                    rows.append((name, None, None, None, f"{path}: {e}"))
                columns = list(zip(*rows)) or [()] * 5
                kinds = (pa.string(), pa.int64(), pa.string(), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["run", "epoch", "tag", "value", "error"])

    files = scan(spark, folder).where(F.col("raw_rel_path").contains("events.out"))
    return files.select("raw_rel_path", "content").mapInArrow(run, "run string, epoch long, tag string, value double, error string")
