"""PNG media columns: lossless storage of bytes as RGB samples, checked reading, cosine-transform hashes.

Cases: a null text is an empty one and is stored as one row of padding; null media give null columns; damaged media
raise. A null id stays null. Equal texts give equal media, so ties and repeated rows give repeated results; an empty
table gives an empty one; other columns are ignored. Every row is handled by itself: nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import id_text, read, slices

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64  # pixels of three 8-bit samples: one row of the picture holds 192 bytes
ROW = 3 * WIDTH
LENGTH = b"lnGt"  # our private chunk: the payload's bytes before padding
SIDE, LOW = 32, 8  # the picture is averaged to SIDE x SIDE; LOW x LOW low frequencies make the hash


def _chunk(kind: bytes, data: bytes) -> bytes:
    return len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")


def encode_png(payload: bytes, length: int | None = None, level: int = 1) -> bytes:
    """An RGB picture of 64 pixels a row; each row takes the filter (none, sub or up) of the least absolute sum.

    `length`, the bytes before padding, goes into a private ancillary chunk."""
    if not payload or len(payload) % ROW:
        raise ValueError(f"a payload is a positive multiple of {ROW} bytes")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    sub, up = rows.copy(), rows.copy()
    sub[:, 3:] -= rows[:, :-3]
    up[1:] -= rows[:-1]
    filtered = np.stack([rows, sub, up])
    cost = np.abs(filtered.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int32)
    best = cost.argmin(axis=0).astype(np.uint8)
    lines = np.concatenate([best[:, None], filtered[best, np.arange(len(rows))]], axis=1)
    head = WIDTH.to_bytes(4, "big") + len(rows).to_bytes(4, "big") + bytes([8, 2, 0, 0, 0])
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(LENGTH, (len(payload) if length is None else length).to_bytes(8, "big")) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(lines: np.ndarray, bpp: int) -> np.ndarray:
    """Undoes the five filters; runs of rows with the filters none, sub and up are undone as whole arrays."""
    kinds, rows = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter")
    sub = np.flatnonzero(kinds == 1)
    pixels = (len(sub), rows.shape[1] // bpp, bpp)
    rows[sub] = np.cumsum(rows[sub].reshape(pixels), axis=1, dtype=np.uint8).reshape(len(sub), rows.shape[1])
    starts = np.flatnonzero(np.diff(kinds, prepend=255) != 0)
    for start, end in zip(starts, [*starts[1:], len(rows)]):
        if kinds[start] == 2:
            first = max(start - 1, 0)
            rows[first:end] = np.cumsum(rows[first:end], axis=0, dtype=np.uint8)
        elif kinds[start] in (3, 4):
            for y in range(start, end):
                above = rows[y - 1].astype(np.int16) if y else np.zeros(rows.shape[1], np.int16)
                row = rows[y].astype(np.int16)
                left, corner = np.zeros(bpp, np.int16), np.zeros(bpp, np.int16)
                for x in range(0, len(row), bpp):
                    b = above[x : x + bpp]
                    if kinds[y] == 3:
                        guess = (left + b) // 2
                    else:
                        p = left + b - corner
                        pa_, pb, pc = abs(p - left), abs(p - b), abs(p - corner)
                        guess = np.where((pa_ <= pb) & (pa_ <= pc), left, np.where(pb <= pc, b, corner))
                    left = (row[x : x + bpp] + guess) & 255
                    row[x : x + bpp], corner = left, b
                rows[y] = row
    return rows


def decode_png(data: bytes) -> tuple[np.ndarray, int, int]:
    """(samples, channels, bytes before padding): the samples, height x (width * channels), of an 8-bit grey, RGB or RGBA picture without interlace.

    Every chunk's checksum is tested, as is that of the zlib stream; damage raises ValueError."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, body, head, length = 8, [], None, None
    while at < len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        part, crc = data[at + 8 : at + 8 + n], data[at + 8 + n : at + 12 + n]
        if len(part) != n or len(crc) != 4 or zlib.crc32(kind + part) != int.from_bytes(crc, "big"):
            raise ValueError(f"checksum of chunk {kind!r}")
        at += 12 + n
        if kind == b"IHDR":
            head = part
        elif kind == b"IDAT":
            body.append(part)
        elif kind == LENGTH:
            length = int.from_bytes(part, "big")
        elif kind == b"IEND":
            break
    else:
        raise ValueError("no end chunk")
    if head is None:
        raise ValueError("no header chunk")
    width, height, depth, colour = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), head[8], head[9]
    channels = {0: 1, 2: 3, 6: 4}.get(colour)
    if depth != 8 or channels is None or head[10:] != b"\0\0\0":
        raise ValueError("not an 8-bit grey, RGB or RGBA picture without interlace")
    try:
        raw = zlib.decompress(b"".join(body))
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if len(raw) != height * (1 + width * channels):
        raise ValueError("sample count")
    samples = _unfilter(np.frombuffer(raw, np.uint8).reshape(height, -1), channels)
    return samples, channels, samples.size if length is None else length


@lru_cache(1)
def _cosines() -> np.ndarray:
    k, n = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * k * (2 * n + 1) / (2 * SIDE))


def _averaged(plane: np.ndarray, side: int, axis: int) -> np.ndarray:
    """Area means over `side` equal parts of the axis; an axis shorter than that repeats its lines."""
    n = plane.shape[axis]
    starts = np.arange(side) * n // side
    if n < side:
        return plane.take(starts, axis=axis)
    sums = np.add.reduceat(plane, starts, axis=axis)
    counts = np.diff(np.append(starts, n))
    return sums / (counts[:, None] if axis == 0 else counts)


def cosine_hash(samples: np.ndarray, channels: int = 3) -> bytes:
    """Eight bytes: which of the lowest 64 cosine coefficients of the grey picture lie over their median."""
    grey = samples.reshape(len(samples), -1, channels).sum(axis=2, dtype=np.float64)
    small = _averaged(_averaged(grey, SIDE, 0), SIDE, 1)
    low = (_cosines() @ small @ _cosines().T).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "payload"):
        media = [None if x is None else encode_png(x, n) for x, n in zip(batch.column("payload").to_pylist(), batch.column("n_bytes").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(media, pa.binary())], ["doc_id", "media"])


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "media"):
        out = {"payload": [], "n_bytes": [], "dct_hash": []}
        for x in batch.column("media").to_pylist():
            samples, channels, n = (None, 0, None) if x is None else decode_png(x)
            for name, value in zip(out, (None, None, None) if x is None else (samples.tobytes(), n, cosine_hash(samples, channels))):
                out[name].append(value)
        kinds = (pa.binary(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, out.values(), kinds)], ["doc_id", "media", *out])


def encode_media(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, media binary): one PNG a row.

    The payload is the text's UTF-8 with bytes 32 appended up to a positive multiple of 192."""
    n = F.octet_length("text")
    pad = F.repeat(F.lit(" "), F.greatest(F.lit(ROW), F.ceil(n / ROW) * ROW).cast("int") - n)
    payload = F.concat(F.col("text").cast("binary"), pad.cast("binary"))
    return docs.select("doc_id", n.cast("long").alias("n_bytes"), payload.alias("payload")).mapInArrow(_encode, "doc_id long, media binary")


def decode_media(media: DataFrame) -> DataFrame:
    """(doc_id, media binary) to (doc_id, media, payload binary, n_bytes long, dct_hash binary)."""
    return media.select("doc_id", "media").mapInArrow(_decode, "doc_id long, media binary, payload binary, n_bytes long, dct_hash binary")


def op2_media(spark, sf_dir: str) -> DataFrame:
    return decode_media(encode_media(id_text(read(spark, sf_dir, "documents")))).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("dct_hash")).alias("feature"),
    )
