"""Whole files have no fault, and every torn, cut or overwritten one has one that says where."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F
from test_library import jpeg

from corvane.operators.integrity import fault, image_faults


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png() -> bytes:
    rows = zlib.compress(b"\0" + bytes(range(64)) * 3)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 1, 8, 2, 0, 0, 0)) + chunk(b"tEXt", b"a\0b") + chunk(b"IDAT", rows[:20]) + chunk(b"IDAT", rows[20:]) + chunk(b"IEND", b"")


def gif() -> bytes:
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"\x21\xf9\x04\0\0\0\0\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x4c\x01\x00\x3b"


def webp() -> bytes:
    body = b"WEBP" + b"VP8L" + struct.pack("<I", 5) + b"\x2f\0\0\0\0\0"
    return b"RIFF" + struct.pack("<I", len(body)) + body


def bmp() -> bytes:
    return b"BM" + struct.pack("<IHHI", 58, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\xff\0"


def tiff(order: str) -> bytes:
    mark = b"II*\0" if order == "<" else b"MM\0*"
    return mark + struct.pack(order + "IHHHII", 8, 1, 256, 3, 1, 1) + struct.pack(order + "I", 0)


WHOLE = {"jpeg": jpeg(b"hello"), "png": png(), "gif": gif(), "webp": webp(), "bmp": bmp(), "tiff le": tiff("<"), "tiff be": tiff(">")}


@pytest.mark.parametrize("kind", WHOLE)
def test_whole_files_have_no_fault(kind):
    assert fault(WHOLE[kind]) is None


@pytest.mark.parametrize("kind", [k for k in WHOLE if "tiff" not in k])
def test_every_cut_and_every_tail_is_a_fault(kind):
    data = WHOLE[kind]
    for n in range(len(data)):
        assert fault(data[:n]), n
    for tail in (b"\0", b"garbage", data):
        assert fault(data + tail)


def test_cut_directories_are_faults():
    for order in "<>":
        assert all(fault(tiff(order)[:n]) for n in range(4, len(tiff(order))))
        looped = tiff(order)[:-4] + struct.pack(order + "I", 8)
        assert "leads back" in fault(looped)


def test_any_changed_byte_of_a_png_is_found():
    data, rng = png(), random.Random(2)
    for at in range(8, len(data)):
        changed = bytearray(data)
        changed[at] ^= rng.randint(1, 255)
        assert fault(bytes(changed)), at


@pytest.mark.parametrize(
    "data, said",
    [
        (b"", "byte 0: an empty file"),
        (None, "not read"),
        (b"text of a page", "byte 0: no image begins with 74657874"),
        (jpeg(b"x")[:-2], f"byte {len(jpeg(b'x')) - 2}: the file ends within a scan"),
        (jpeg(b"x") + b"zz", f"byte {len(jpeg(b'x'))}: 2 bytes after the end"),
        (b"\xff\xd8\xff\xd9", "byte 2: the image ends without a frame"),
        (b"\xff\xd8\xff\xe0\x00\x40abc", "byte 2: segment E0 goes beyond the end"),
        (b"\xff\xd8abc", "byte 2: no marker, but 61"),
        (png()[:40], "byte 33: the file ends within a chunk"),
        (png().replace(b"a\0b", b"a\0c"), "byte 33: the checksum of chunk tEXt is wrong"),
        (png() + b"!", f"byte {len(png())}: 1 bytes after the end"),
        (bmp()[:-1], "byte 2: 58 bytes said, 57 there"),
    ],
)
def test_faults_say_where_and_why(data, said):
    assert fault(data) == said


def test_faults_in_batches(spark):
    rows = [(k, d) for k, d in WHOLE.items()] + [("cut", png()[:-3]), ("null", None), ("empty", b"")]
    df = spark.createDataFrame(rows, "name string, content binary").repartition(3)
    got = {r.name: r.said for r in df.select("name", image_faults(F.col("content")).alias("said")).collect()}
    assert got == {k: fault(d) for k, d in rows}
