"""Byte-pair encoding and decoding through a table of distinct words.

Each block of texts is split into words and sends its distinct ones to the words' buckets (blocks.py). A bucket merges
the words of all blocks, encodes each distinct word once with the tokenizers library, and sends the ids back; the block
joins them to its texts by position. Decoding joins ids to their pieces; the table of pieces has one row for each id of
the vocabulary (a bound that no input raises), so every task holds it.

Cases: a null text is empty and has no ids. Texts with a special token's string, or with code points that are
unassigned here, are encoded whole by the library. Words are told apart by a 64-bit hash; a text whose ids do not
decode to it again is encoded whole too. Ids outside the vocabulary decode to nothing, as in the library. Repeated
rows, rows that share an id and null ids are encoded each. An empty table gives an empty one; other columns are
carried in `rest`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.blocks import answer, ask, blocked, pack, settle, unpack
from corvane.llm.common import id_text, read, slices
from corvane.llm.tokens import distinct_words, encode_words, gather, odd, tokenizer

WORD_BLOCK_BYTES = 16 << 20  # larger blocks repeat fewer words


@lru_cache(2)
def pieces(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The id-to-piece table: the bytes of all pieces in a row, and where the piece of each id begins."""
    stand_ins = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    others = [b for b in range(256) if b not in stand_ins]
    byte_of = {chr(b): b for b in stand_ins} | {chr(256 + i): b for i, b in enumerate(others)}
    found = tokenizer(path)
    added = {t.content for t in found.get_added_tokens_decoder().values()}
    out = []
    for i in range(found.get_vocab_size(with_added_tokens=True)):
        piece = found.id_to_token(i)
        plain = piece is None or piece in added or any(c not in byte_of for c in piece)
        out.append((piece or "").encode() if plain else bytes(byte_of[c] for c in piece))
    return np.frombuffer(b"".join(out), np.uint8), np.cumsum([0] + [len(p) for p in out])


def decode_ids(path: str, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The bytes of ids[bounds[i]:bounds[i + 1]]."""
    table, begins = pieces(path)
    ids = np.where(ids < len(begins) - 1, ids, len(begins) - 1)
    sizes = np.append(np.diff(begins), 0)
    data, at = gather(ids, sizes, table)
    at = at[bounds]
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


Part = tuple[list[str], list[bool], np.ndarray, np.ndarray, np.ndarray]


def _split(rows: pa.Table) -> tuple[dict[str, int], list[Part]]:
    """A block's distinct words with their numbers, and its slices: texts, which are plain, numbers of the slice's
    distinct words, place among these at each position, bounds."""
    seen: dict[str, int] = {}
    parts = []
    for batch in slices(rows.select(["text"]).to_batches(), limit=1 << 19):
        texts = batch.column("text").to_pylist()
        plain = [not odd(t) for t in texts]
        words, inverse, bounds = distinct_words([t if p else "" for t, p in zip(texts, plain)], spaced=True)
        numbers = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))
        parts.append((texts, plain, numbers, inverse, bounds))
    return seen, parts


def _by_bucket(words: dict[str, int], n: int) -> list[list[tuple[bytes, int]]]:
    """The block's distinct words, with their numbers, by bucket, in an order that both branches repeat."""
    out: list[list[tuple[bytes, int]]] = [[] for _ in range(n)]
    for w, number in words.items():
        raw = w.encode()
        out[xxhash.xxh32_intdigest(raw) % n].append((raw, number))
    for part in out:
        part.sort()
    return out


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text, ...) to (doc_id, ids array<int>, rest struct)."""
    base, n = blocked(docs, WORD_BLOCK_BYTES)

    def question(rows: pa.Table) -> Iterator[tuple[int, bytes]]:
        for b, words in enumerate(_by_bucket(_split(rows)[0], n)):
            if words:
                yield b, pack(np.array([len(w) for w, _ in words], np.uint32), b"".join(w for w, _ in words))

    def reply(questions: list[bytes]) -> list[bytes]:
        asked, table = [], {}
        for q in questions:
            sizes, raw = unpack(q, np.uint32, bytes)
            ends = np.cumsum(sizes).tolist()
            asked.append(np.array([table.setdefault(raw[a:b], len(table)) for a, b in zip([0, *ends], ends)], np.int64))
        ids = encode_words(path, [w.decode() for w in table])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        values = np.fromiter((i for one in ids for i in one), np.int64, int(sizes.sum()))
        return [pack(sizes[places].astype(np.uint32), gather(places, sizes, values)[0].astype(np.uint32)) for places in asked]

    def use(rows: pa.Table, answers: dict[int, bytes]) -> pa.Table:
        seen, parts = _split(rows)
        by_bucket = _by_bucket(seen, n)
        place, at_word = np.zeros(len(seen), np.int64), 0
        sizes, chunks = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
        for b, data in answers.items():
            size, ids = unpack(data, np.uint32, np.uint32)
            sizes.append(size), chunks.append(ids)
            place[[number for _, number in by_bucket[b]]] = np.arange(at_word, at_word + len(size))
            at_word += len(size)
        del seen, by_bucket
        size, ids = np.concatenate(sizes).astype(np.int64), np.concatenate(chunks)
        out = []
        for texts, plain, numbers, inverse, bounds in parts:
            here = place[numbers]
            values, at = gather(here[inverse], size, ids)
            cuts = at[bounds]
            for text, p, back, a, b in zip(texts, plain, decode_ids(path, values, cuts), cuts[:-1], cuts[1:]):
                good = p and back == text.encode()
                out.append(values[a:b].astype(np.int32) if good else np.array(encode_words(path, [text])[0], np.int32))
        return pa.table({"doc_id": rows["doc_id"], "ids": pa.array(out, pa.list_(pa.int32())), "rest": rows["rest"]})

    schema = T.StructType.fromDDL("doc_id long, ids array<int>").add("rest", base.schema["rest"].dataType)
    return settle(base, answer(ask(base, question), reply), use, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>, ...) with the decoded text added, malformed bytes replaced as the library does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lists = part.column("ids")
                sizes = pc.list_value_length(lists).fill_null(0).to_numpy()
                raw = decode_ids(path, lists.flatten().to_numpy(), np.cumsum(np.append(0, sizes)))
                text = [r.decode("utf-8", "replace") if ok else None for r, ok in zip(raw, lists.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string())], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType(list(encoded.schema.fields)).add("decoded", "string"))


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    out = decode(encode(id_text(read(spark, sf_dir, "documents")), path).select("doc_id", "ids"), path)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
