"""Best-fit packing of tokenised documents into sequences, after dominance reduction by Martello and Toth.

Lengths lie between 1 and the capacity, so an instance is its count of pieces by length: at most `capacity` numbers,
whatever the number of documents. The driver reduces and packs those counts; it never sees a piece. Pieces are ranked
within their length on the executors (a length with very many pieces is dealt into parts by numbers drawn for each
piece, so that no length and no repeated row fills one task) and read their place from the plan, whose size is bounded
by the capacity too: each of its steps uses a length up.

Cases: a null text is empty and gives one piece, of the closing id alone. Repeated rows and rows that share an id are
packed each. Null ids stay null. An empty table gives an empty one; other columns are ignored. Ties in length are
dealt by id, piece and content.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Scratch, id_text, numbered, read, slices
from corvane.llm.tokens import Encoder

CAPACITY = 2048
CLOSE = 0  # the id that ends each document


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, text) to (doc_id, piece int, start long, length long, ids binary: little-endian unsigned 32-bit, drawn int)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, chance = Encoder(tokenizer_path), np.random.default_rng()
        for batch in slices(batches):
            ids, cuts = encoder.flat([t or "" for t in batch.column("text").to_pylist()])
            ids = np.insert(ids, cuts[1:], CLOSE).astype("<u4")
            size = np.diff(cuts) + 1
            of = np.repeat(np.arange(len(size)), -(-size // capacity))
            piece = np.arange(len(of)) - np.searchsorted(of, of)
            start = piece * capacity
            length = np.minimum(size[of] - start, capacity)
            ends = np.append(0, np.cumsum(length)).astype(np.int32) * 4
            data = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
            drawn = pa.array(chance.integers(0, 1 << 30, len(of), dtype=np.int32))
            columns = [batch.column("doc_id").take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), data, drawn]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids", "drawn"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary, drawn int")


Pattern = tuple[tuple[int, int], ...]  # (length, how many), from offset 0 on


def reduce_dominated(counts: np.ndarray, capacity: int) -> list[tuple[int, Pattern]]:
    """Takes from counts, and returns as (times, pattern), sets that some best packing holds.

    With a piece of length j goes the set that dominates all others that fit beside it: nothing, if nothing fits; the
    one longest piece i, if it fills the rest, if no two others fit, or if no two together are longer than it where no
    three fit; a pair a >= b, where no three fit, if a is the longest that fits and no fitting pair has a longer second.
    """
    fixed: list[tuple[int, Pattern]] = []

    def take(*lengths: int) -> None:
        """As often as there are pieces for it: taking pieces away never breaks a condition that led here, so the set
        stays dominant until one of its lengths is used up. That bounds the plan by the lengths, not by the pieces."""
        times = int(min(counts[x] // lengths.count(x) for x in lengths))
        for x in lengths:
            counts[x] -= times
        fixed.append((times, tuple((x, 1) for x in lengths)))

    again = True
    while again:
        again = False
        for j in range(capacity, 0, -1):
            while counts[j] > 0:
                rest = capacity - j
                counts[j] -= 1  # the others beside one piece of length j
                fitting = np.flatnonzero(counts[1 : rest + 1] > 0) + 1 if rest else np.zeros(0, int)
                least = np.repeat(fitting[:3], np.minimum(counts[fitting[:3]], 3))[:3]
                best, pair, second = (int(fitting[-1]) if len(fitting) else 0), (0, 0), 0
                if best and best != rest and len(least) >= 2 and least[:2].sum() <= rest and not (len(least) == 3 and least.sum() <= rest):
                    for b in fitting:
                        a = int(min(best, rest - b))
                        while a >= b and counts[a] < 1 + (a == b):
                            a -= 1
                        if a >= b:
                            pair, second = max(pair, (a + int(b), a)), max(second, int(b))
                counts[j] += 1
                if not best:
                    take(j)
                elif best == rest or len(least) < 2 or least[:2].sum() > rest or 0 < pair[0] <= best:
                    take(j, best)
                elif pair[0] and pair[1] == best and second <= pair[0] - pair[1]:
                    take(j, best, pair[0] - pair[1])
                else:
                    break
                again = True
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, Pattern]]:
    """Best-fit decreasing over counts by length; sequences of equal content are held once, with how many there are."""
    open_: dict[int, list[tuple[int, Pattern]]] = {}
    for size in range(capacity, 0, -1):
        left = int(counts[size])
        for rest in sorted(r for r in open_ if r >= size):
            each, groups = rest // size, open_.pop(rest)
            while left and groups:
                times, pattern = groups.pop()
                whole = min(times, left // each)
                if whole:
                    open_.setdefault(rest - each * size, []).append((whole, (*pattern, (size, each))))
                    left, times = left - whole * each, times - whole
                if left and times and left < each:
                    open_.setdefault(rest - left * size, []).append((1, (*pattern, (size, left))))
                    left, times = 0, times - 1
                if times:
                    groups.append((times, pattern))
            if groups:
                open_.setdefault(rest, []).extend(groups)
        each = capacity // size
        if whole := left // each:
            open_.setdefault(capacity - each * size, []).append((whole, ((size, each),)))
        if more := left % each:
            open_.setdefault(capacity - more * size, []).append((1, ((size, more),)))
    return [g for groups in open_.values() for g in groups]


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """By length, rows (first rank, first sequence, pieces in each sequence, offset of the first of those)."""
    rest = counts.astype(np.int64).copy()
    fixed = reduce_dominated(rest, capacity)
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks, sequence = np.zeros(capacity + 1, np.int64), 0
    for times, pattern in fixed + best_fit(rest, capacity):
        at = 0
        for size, each in pattern:
            runs.setdefault(size, []).append((int(ranks[size]), sequence, each, at))
            ranks[size] += times * each
            at += size * each
        sequence += times
    return {size: np.array(rows, np.int64) for size, rows in runs.items()}


def place(pieces: DataFrame, capacity: int = CAPACITY, part_rows: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (doc_id, piece, length, ..., drawn) that can be read twice; columns
    of these names are replaced, and `drawn` goes. Without it a hash of all columns stands for it."""
    pieces = pieces.drop("sequence_id", "offset", "_row", "_part", "_sub", "_parts", "_before", "_size")
    drawn = F.col("drawn") if "drawn" in pieces.columns else F.xxhash64(*pieces.columns)
    by_length = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `capacity` rows at most
    counts = np.zeros(capacity + 1, np.int64)
    counts[list(by_length)] = list(by_length.values())
    runs = plan(counts, capacity)
    order = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns]
    ranked = numbered(pieces, "length", by_length, order, drawn, part_rows=part_rows).drop("drawn")
    kept = [c for c in pieces.columns if c != "drawn"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_row"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length):
                mine, table = np.flatnonzero(length == size), runs[int(size)]
                first, base, each, at = table[np.searchsorted(table[:, 0], rank[mine], "right") - 1].T
                nth = rank[mine] - first
                sequence[mine], offset[mine] = base + nth // each, at + nth % each * size
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    names = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in kept)
    return ranked.mapInArrow(run, f"{names}, sequence_id long, offset long")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = tokenised_pieces(id_text(read(spark, sf_dir, "documents")), public_tokenizers.path("word_bpe_49k.json"))
    # The digest of the ids goes through the packing; the ids themselves would only be moved about.
    return place(Scratch(spark).table(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")))
