"""Whether image files are whole, by their structure: every segment, chunk or block is walked to the end of the file.

A fault says the byte where the file stops making sense and why. Nothing is decoded; what a format secures by checksums
(PNG) is verified by them. Bytes after the end count as a fault, as those of a torn or overwritten file do.
"""

from __future__ import annotations

import re
import struct
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What follows FF in a JPEG: markers without a segment, start of a frame, and what may stand in a scan.
ALONE = {0x01, *range(0xD0, 0xD8)}
FRAMES = set(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
_AFTER_SCAN = re.compile(rb"\xff+[^\x00\xd0-\xd7\xff]", re.S)
PNG = b"\x89PNG\r\n\x1a\n"


def _jpeg(data: bytes) -> str | None:
    at, frame, scan = 2, False, False
    while True:
        if at >= len(data):
            return f"byte {at}: the file ends without an end marker"
        if data[at] != 0xFF:
            return f"byte {at}: no marker, but {data[at]:02X}"
        while at < len(data) and data[at] == 0xFF:
            at += 1
        if at >= len(data):
            return f"byte {at}: the file ends within a marker"
        marker = data[at]
        at += 1
        if marker == 0xD9:
            if not (frame and scan):
                return f"byte {at - 2}: the image ends without {'a scan' if frame else 'a frame'}"
            return None if at == len(data) else f"byte {at}: {len(data) - at} bytes after the end"
        if marker in ALONE:
            continue
        if marker in (0x00, 0xD8):
            return f"byte {at - 2}: marker {marker:02X} where a segment begins"
        size = int.from_bytes(data[at : at + 2])
        if at + 2 > len(data) or at + size > len(data):
            return f"byte {at - 2}: segment {marker:02X} goes beyond the end"
        if size < 2:
            return f"byte {at - 2}: segment {marker:02X} of length {size}"
        if marker in FRAMES:
            height, width = struct.unpack_from(">HH", data, at + 3) if size >= 8 else (0, 0)
            if not width:
                return f"byte {at - 2}: a frame of {width} x {height}"
            frame = True
        at += size
        if marker == 0xDA:
            if not frame:
                return f"byte {at}: a scan before any frame"
            found = _AFTER_SCAN.search(data, at)
            if not found:
                return f"byte {len(data)}: the file ends within a scan"
            at, scan = found.start(), True


def _png(data: bytes) -> str | None:
    at, seen = len(PNG), []
    while True:
        if at == len(data):
            return f"byte {at}: the file ends without an end chunk"
        if at + 12 > len(data):
            return f"byte {at}: the file ends within a chunk"
        size, kind = struct.unpack_from(">I4s", data, at)
        name = kind.decode("latin-1")
        if not name.isalpha() or not name.isascii():
            return f"byte {at + 4}: {kind.hex()} names no chunk"
        if at + 12 + size > len(data):
            return f"byte {at}: chunk {name} goes beyond the end"
        if zlib.crc32(data[at + 4 : at + 8 + size]) != int.from_bytes(data[at + 8 + size : at + 12 + size]):
            return f"byte {at}: the checksum of chunk {name} is wrong"
        if not seen and (name != "IHDR" or size != 13):
            return f"byte {at}: chunk {name} of {size} bytes instead of the header"
        if name == "IHDR" and 0 in struct.unpack_from(">II", data, at + 8):
            return f"byte {at}: an image without pixels"
        if name in ("IHDR", "IEND") and name in seen:
            return f"byte {at}: a second chunk {name}"
        seen.append(name)
        at += 12 + size
        if name == "IEND":
            if "IDAT" not in seen:
                return f"byte {at - 12 - size}: the image ends without data"
            return None if at == len(data) else f"byte {at}: {len(data) - at} bytes after the end"


def _gif(data: bytes) -> str | None:
    if len(data) < 13:
        return f"byte {len(data)}: the file ends within the header"
    at = 13 + (3 << (data[10] & 7) + 1 if data[10] & 0x80 else 0)
    pictures = 0

    def blocks(at: int) -> int:
        while at < len(data) and data[at]:
            at += data[at] + 1
        return at + 1

    while at < len(data):
        kind, begin = data[at], at
        if kind == 0x3B:
            if not pictures:
                return f"byte {at}: the file ends without a picture"
            return None if at + 1 == len(data) else f"byte {at + 1}: {len(data) - at - 1} bytes after the end"
        if kind == 0x21:
            at = blocks(at + 2)
        elif kind == 0x2C:
            if at + 10 > len(data):
                break
            local = data[at + 9]
            at = blocks(at + 11 + (3 << (local & 7) + 1 if local & 0x80 else 0))
            pictures += 1
        else:
            return f"byte {at}: {kind:02X} begins no block"
        if at > len(data):
            return f"byte {begin}: a block goes beyond the end"
    return f"byte {len(data)}: the file ends without a trailer"


def _bmp(data: bytes) -> str | None:
    if len(data) < 26:
        return f"byte {len(data)}: the file ends within the header"
    size, begin = struct.unpack_from("<I4xI", data, 2)
    if size != len(data):
        return f"byte 2: {size} bytes said, {len(data)} there"
    return None if 26 <= begin <= len(data) else f"byte 10: pixels begin at {begin}"


def _webp(data: bytes) -> str | None:
    said = struct.unpack_from("<I", data, 4)[0] + 8
    if said != len(data):
        return f"byte 4: {said} bytes said, {len(data)} there"
    at, picture = 12, False
    while at < len(data):
        if at + 8 > len(data):
            return f"byte {at}: the file ends within a chunk"
        kind, size = struct.unpack_from("<4sI", data, at)
        picture |= kind in (b"VP8 ", b"VP8L", b"ANMF")
        if at + 8 + size > len(data):
            return f"byte {at}: a chunk goes beyond the end"
        at += 8 + size + size % 2
    return None if picture else f"byte {at}: the file ends without a picture"


def _tiff(data: bytes) -> str | None:
    order = "<" if data[:2] == b"II" else ">"
    at, seen = struct.unpack_from(order + "I", data, 4)[0] if len(data) >= 8 else 0, set()
    if not at:
        return "byte 4: no directory"
    while at:
        if at in seen:
            return f"byte {at}: a directory that leads back"
        seen.add(at)
        if at + 2 > len(data) or at + 6 + 12 * struct.unpack_from(order + "H", data, at)[0] > len(data):
            return f"byte {at}: a directory goes beyond the end"
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * struct.unpack_from(order + "H", data, at)[0])[0]
    return None


def fault(data: bytes | None) -> str | None:
    """Where and why a file is no whole image; None of one that is."""
    if data is None:
        return "not read"
    if not data:
        return "byte 0: an empty file"
    if data[:2] == b"\xff\xd8":
        return _jpeg(data)
    if data[:8] == PNG:
        return _png(data)
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return _gif(data)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return _webp(data)
    if data[:4] in (b"II*\0", b"MM\0*"):
        return _tiff(data)
    if data[:2] == b"BM":
        return _bmp(data)
    return f"byte 0: no image begins with {data[:4].hex().upper()}"


def image_faults(content: Column) -> Column:
    """fault() over Arrow batches of contents."""

    @F.pandas_udf("string")
    def run(contents: pd.Series) -> pd.Series:
        return contents.map(fault, na_action=None).astype(object).where(lambda s: s.notna(), None)

    return run(content)
