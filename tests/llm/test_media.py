import hashlib
import math
import zlib

import numpy as np
import pytest
from fixtures_docs import ODD, documents, odd_documents

from corvane.llm import media
from corvane.llm.common import id_text


def test_round_trip_of_odd_documents(spark):
    out = media.decode_media(media.encode_media(id_text(odd_documents(spark)))).collect()
    assert len(out) == len(ODD) + 1
    for r in out:
        raw = (ODD[r.doc_id] or "").encode()
        assert r.n_bytes == len(raw)
        assert bytes(r.payload) == raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
    twins = [bytes(r.dct_hash) for r in out if r.doc_id >= len(ODD) - 2]
    assert len(twins) == 3 and len(set(twins)) == 1


def test_empty_table(spark):
    assert media.decode_media(media.encode_media(id_text(documents(spark, [])))).count() == 0


def picture(kinds):
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 256, (len(kinds), 12), dtype=np.uint8)
    lines = bytearray()
    for y, kind in enumerate(kinds):
        lines.append(kind)
        for x in range(12):
            a = int(rows[y, x - 3]) if x >= 3 else 0
            b = int(rows[y - 1, x]) if y else 0
            c = int(rows[y - 1, x - 3]) if y and x >= 3 else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            lines.append((int(rows[y, x]) - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
    head = (4).to_bytes(4, "big") + len(kinds).to_bytes(4, "big") + bytes([8, 2, 0, 0, 0])
    parts = media._chunk(b"IHDR", head), media._chunk(b"IDAT", zlib.compress(bytes(lines))), media._chunk(b"IEND", b"")
    return rows, media.SIGNATURE + b"".join(parts)


@pytest.mark.parametrize("kinds", [[0, 1, 2, 3, 4, 2, 2, 1, 1, 4, 3], [4, 4], [3], [2, 2, 0, 2]])
def test_all_five_filters_are_undone(kinds):
    rows, data = picture(kinds)
    samples, channels, n = media.decode_png(data)
    assert channels == 3 and n == rows.size and (samples == rows).all()


def test_damage_is_found():
    data = bytearray(media.encode_png(b"x" * 192))
    for at in (0, 20, 60, len(data) - 1):
        broken = data.copy()
        broken[at] ^= 1
        with pytest.raises(ValueError):
            media.decode_png(bytes(broken))
    with pytest.raises(ValueError):
        media.encode_png(b"x")


def test_hash_is_near_for_near_pictures():
    rng = np.random.default_rng(3)
    picture = rng.integers(0, 256, (64, 192), dtype=np.uint8)
    near = picture.copy()
    near[5, :6] ^= 3
    bits = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a, b))
    assert bits(media.cosine_hash(picture), media.cosine_hash(near)) <= 2
    assert bits(media.cosine_hash(picture), media.cosine_hash(rng.integers(0, 256, (64, 192), dtype=np.uint8))) > 10


@pytest.mark.parametrize("height", [1, 7, 32, 64, 100])
def test_hash_equals_the_plain_transform(height):
    samples = np.random.default_rng(height).integers(0, 256, (height, 64 * 3), dtype=np.uint8)
    grey = [[sum(int(v) for v in samples[y, 3 * x : 3 * x + 3]) for x in range(64)] for y in range(height)]
    cut = lambda i, n: range(i * n // 32, max((i + 1) * n // 32, i * n // 32 + 1))
    small = [[np.mean([grey[y][x] for y in cut(i, height) for x in cut(j, 64)]) for j in range(32)] for i in range(32)]
    cos = lambda k, n: math.cos(math.pi * k * (2 * n + 1) / 64)
    low = [sum(small[i][j] * cos(u, i) * cos(v, j) for i in range(32) for j in range(32)) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    got = np.unpackbits(np.frombuffer(media.cosine_hash(samples), np.uint8))
    near = 1e-6 * max(map(abs, low))  # rounding may decide a coefficient at the median
    assert all(bool(bit) == (c > middle) for bit, c in zip(got, low) if abs(c - middle) > near)


def test_query_of_null_ids_texts_and_repeated_rows(spark, tmp_path):
    df = spark.createDataFrame([(None, None, "u"), (None, "a", "v"), (1, "a", None), (1, "a", None)], "doc_id long, text string, media string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = media.op2_media(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.n_bytes) for r in rows) == [(0, 0), (0, 1), (1, 1), (1, 1)]
    assert len({(r.payload_sha256, r.media_bytes, r.media_sha256, r.feature) for r in rows}) == 2


def test_query(spark, tmp_path):
    odd_documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    for r in media.op2_media(spark, str(tmp_path)).collect():
        raw = (ODD[r.doc_id] or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        stored = media.encode_png(payload, len(raw))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r.feature == media.cosine_hash(np.frombuffer(payload, np.uint8).reshape(-1, 192)).hex()
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
