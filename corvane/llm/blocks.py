"""Blocks and buckets: how a table of texts asks a keyed question without a row for each key.

The texts are dealt once into blocks of a few MB by a hash of id and text. A block sends one packed row to each bucket
with the keys that it asks about; a bucket sees the keys of all blocks that belong to it and sends one packed row back
to each block, where it meets the texts again. A key in a third of all texts costs one entry a block, never a row an
occurrence. The exchange of the texts is the same in every branch of such a plan, so Spark shuffles them once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import give_back, total_bytes

BLOCK_BYTES = 8 << 20


def blocked(docs: DataFrame, block_bytes: int = BLOCK_BYTES, by: Column | None = None) -> tuple[DataFrame, int]:
    """(block, doc_id, text, rest struct) and the number of blocks, by the bytes of text; buckets are as many."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    n = max(8, math.ceil(total_bytes(docs) / block_bytes))
    packed = F.struct(*rest) if rest else F.struct(F.lit(0).alias("_none"))
    block = F.pmod(F.xxhash64("doc_id", "text") if by is None else by, F.lit(n)).cast("int")
    return docs.select(block.alias("block"), "doc_id", "text", packed.alias("rest")).repartition(n, "block"), n


def rows_of(table: pa.Table) -> pa.Table:
    """The rows of a block in an order that every branch repeats: by id, then by text."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays of numbers, or bytes, as one compressed value."""
    parts = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    return zstandard.compress(b"".join([np.array([len(p) for p in parts], np.int64).tobytes(), *parts]), 3)


def unpack(data: bytes, *kinds: type) -> list:
    raw = zstandard.decompress(data)
    sizes = np.frombuffer(raw, np.int64, len(kinds))
    at, out = 8 * len(kinds), []
    for size, kind in zip(sizes.tolist(), kinds):
        out.append(raw[at : at + size] if kind is bytes else np.frombuffer(raw[at : at + size], kind))
        at += size
    return out


PACKED = "bucket int, block int, data binary"


def packed_table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    bucket, block, data = zip(*rows) if rows else ((), (), ())
    return pa.table({"bucket": pa.array(bucket, pa.int32()), "block": pa.array(block, pa.int32()), "data": pa.array(data, pa.binary())})


def ask(base: DataFrame, question: Callable[[pa.Table], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """Each block's (bucket, packed question)."""

    def run(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        out = packed_table([(bucket, block, data) for bucket, data in question(rows_of(table))])
        give_back()
        return out

    return base.groupBy("block").applyInArrow(run, PACKED)


def answer(asked: DataFrame, reply: Callable[[list[bytes]], list[bytes]], buckets: int | None = None) -> DataFrame:
    """Each bucket's packed answers to the blocks, in the order of their questions. Rows of a bucket from `buckets` on
    are a block's notes to itself and pass."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        bucket, blocks = table["bucket"][0].as_py(), table["block"].to_pylist()
        if buckets is not None and bucket >= buckets:
            return table.select(["bucket", "block", "data"])
        out = packed_table([(bucket, b, data) for b, data in zip(blocks, reply(table["data"].to_pylist()))])
        give_back()
        return out

    return asked.groupBy("bucket").applyInArrow(run, PACKED)


def settle(base: DataFrame, answers: DataFrame, use: Callable[[pa.Table, dict[int, bytes]], pa.Table], schema) -> DataFrame:
    """What each block makes of its rows and of the answers by bucket."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = use(rows_of(left), dict(zip(right["bucket"].to_pylist(), right["data"].to_pylist())))
        give_back()
        return out

    return base.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
