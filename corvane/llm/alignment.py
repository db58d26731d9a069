"""Aligning the tokens of two public tokenizers over the same bytes, and how often each pair of ids is linked.

Both read a blank and the text. A segment begins at a blank or line feed that follows something other than white space;
neither tokenizer forms a token across such a place (`parts_at_blanks` looks that up in the second one's vocabulary; the
first one's pattern splits there), so each distinct segment is encoded and merged once while a worker holds it. The
merge runs two pointers over the cumulative ends of both sides' tokens, for many segments in one go; where they meet, a
group ends. A document's groups, links and digest follow from its segments.

mapInPandas emits a row for each document, with its distinct pairs packed, and for each block of texts its distinct pairs
with the number of documents; both are written once. Spark sums the pairs over all blocks, finds each id's highest count
on either side, and joins the sums back to the blocks, where they meet the documents. The texts are never shuffled, and a
pair costs one row a block, however many documents hold it. An id has at most as many pairs as the other vocabulary ids.

Cases: null and empty texts have no tokens, nor have texts whose tokens on either side do not give the text back (as one
with U+2581); their numbers are zero and their digest empty. Strings of special tokens are plain text. Null ids, repeated
rows and rows that share an id are documents each. An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.blocks import pack, unpack
from corvane.llm.bpe import pieces
from corvane.llm.common import Scratch, give_back, id_text, read
from corvane.llm.tokens import gather

BLOCK_BYTES = 8 << 20
HELD_SEGMENTS, HELD_BYTES = 400_000, 32 << 20  # of a worker; a slice with more holds its own only
BLANK = "▁"
#: Pairs of ids as one number, by the second vocabulary's greatest size.
SECOND = 1 << 15
LARGE = 4096  # links of a group


@lru_cache(1)
def first_side(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    found.encode_special_tokens = True
    return found


@lru_cache(1)
def second_side(path: str):
    """(processor, the bytes of each id's piece)."""
    from sentencepiece import SentencePieceProcessor

    found = SentencePieceProcessor(model_file=path)
    ids = range(found.get_piece_size())
    if len(ids) > SECOND:
        raise ValueError(f"the second vocabulary has more than {SECOND} ids")
    return found, [bytes([int(found.id_to_piece(i)[3:5], 16)]) if found.is_byte(i) else found.id_to_piece(i).replace(BLANK, " ").encode() for i in ids]


@lru_cache(1)
def parts_at_blanks(path: str) -> bool:
    """Whether no piece of the second tokenizer holds a blank after another character, or a line feed at all."""
    found = second_side(path)[0]
    return not any(BLANK in p.lstrip(BLANK) or "\n" in p for p in map(found.id_to_piece, range(found.get_piece_size())))


def segment_starts(data: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where the segments of texts of UTF-8 begin: at blanks and line feeds after a byte that ends no white space."""
    before, two = np.append(0, data[:-1]), np.append([0, 0], data[:-2])
    white = ((before >= 9) & (before <= 13)) | ((before >= 28) & (before <= 32))
    # Last bytes of white space beyond ASCII: U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
    white |= (two == 0xC2) & ((before == 0x85) | (before == 0xA0)) | (two == 0x9A) & (before == 0x80) | (two == 0x81) & (before == 0x9F)
    white |= (two == 0x80) & ((before <= 0x8A) & (before >= 0x80) | (before == 0xA8) | (before == 0xA9) | (before == 0xAF))
    cut = ((data == 32) | (data == 10)) & ~white
    cut[text_starts] = True
    return np.flatnonzero(cut)


def merged(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """The ends of the groups: where tokens of both sides end. Each pointer skips the ends that the other does not meet."""
    at = np.minimum(np.searchsorted(ends_b, ends_a), len(ends_b) - 1)
    return ends_a[ends_b[at] == ends_a] if len(ends_b) else ends_a[:0]


def linked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of a large group, and how often each is linked."""
    (x, n), (y, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    return (x[:, None] * SECOND + y).ravel(), (n[:, None] * m).ravel()


def summed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sums of runs of these sizes, empty ones included."""
    ends = np.cumsum(sizes)
    total = np.append(0, np.cumsum(values))
    return total[ends] - total[ends - sizes]


def first_last(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(sizes)
    return ends - sizes, ends


def together(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sums of their numbers."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


class Aligner:
    """Encodes and merges segments; a distinct one once while it is held."""

    def __init__(self, first: str, second: str):
        self.paths, self.a, (self.b, pieces_b) = (first, second), first_side(first), second_side(second)
        table, begins = pieces(first)
        self.pieces_a = table, np.diff(begins)
        self.pieces_b = np.frombuffer(b"".join(pieces_b), np.uint8), np.fromiter(map(len, pieces_b), np.int64, len(pieces_b))
        numbers = [b"%d," % i for i in range(max(len(begins) - 1, len(pieces_b)))]
        self.written = np.frombuffer(b"".join(numbers), np.uint8), np.fromiter(map(len, numbers), np.int64, len(numbers))
        self.blank = self.b.piece_to_id(BLANK)
        self.forget()

    def forget(self) -> None:
        self.places: dict[bytes, int] = {}
        self.bytes = 0
        self.numbers = np.zeros((0, 5), np.int64)  # tokens of either side, groups, links, whether they give the segment back
        nothing = np.zeros(0, np.int64)
        self.begin, self.size, self.pairs, self.times = nothing, nothing, nothing, nothing
        self.texts, self.text_size = np.zeros(0, np.uint8), nothing  # the groups as written, each with ; after it

    def _second(self, segments: list[bytes]) -> list[list[int]]:
        """The tokenizer puts a blank before what it reads: that of the segment, or one more, which goes."""
        fed = [(s[1:] if s.startswith(b" ") else s).decode() for s in segments]
        return [ids[1:] if s.startswith(b"\n") else ids or [self.blank] for s, ids in zip(segments, self.b.encode(fed, num_threads=1))]

    @staticmethod
    def _given_back(ids: np.ndarray, sizes: np.ndarray, table: tuple[np.ndarray, np.ndarray], raw: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Whether the tokens' bytes are the segment."""
        same = summed(table[1][ids], sizes) == lengths
        data, _ = gather(ids[np.repeat(same, sizes)], table[1], table[0])
        wrong = np.flatnonzero(data != raw[np.repeat(same, lengths)])
        same[np.flatnonzero(same)[np.searchsorted(np.cumsum(lengths[same]), wrong, "right")]] = False
        return same

    def _hold(self, segments: list[bytes]) -> None:
        lists = [e.ids for e in self.a.encode_batch_fast([s.decode() for s in segments], add_special_tokens=False)], self._second(segments)
        (n_a, n_b) = (np.fromiter(map(len, x), np.int64, len(x)) for x in lists)
        (a, b) = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in zip(lists, (n_a, n_b)))
        raw, lengths = np.frombuffer(b"".join(segments), np.uint8), np.fromiter(map(len, segments), np.int64, len(segments))
        good = self._given_back(a, n_a, self.pieces_a, raw, lengths) & self._given_back(b, n_b, self.pieces_b, raw, lengths)
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        ends_a, ends_b = np.cumsum(self.pieces_a[1][a]), np.cumsum(self.pieces_b[1][b])
        ends = merged(ends_a, ends_b)
        of_a, of_b = np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b)
        in_a, in_b = np.bincount(of_a, minlength=len(ends)), np.bincount(of_b, minlength=len(ends))
        segment = np.flatnonzero(good)[np.searchsorted(np.cumsum(lengths[good]), ends)]
        groups = np.bincount(segment, minlength=len(segments))
        links = summed(in_a * in_b, groups)
        self.numbers = np.concatenate([self.numbers, np.stack([n_a, n_b, groups, links, good], axis=1)])

        # Written out: of each group the ids of one side, then of the other.
        (first_a, last_a), (first_b, last_b) = first_last(in_a), first_last(in_b)
        place_a, place_b = np.arange(len(a)) + first_b[of_a], np.arange(len(b)) + last_a[of_b]
        ids, mark = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = a, b
        mark[place_a[last_a - 1]], mark[place_b[last_b - 1]] = ord("|"), ord(";")
        text, at = gather(ids, self.written[1], self.written[0])
        text[at[1:] - 1] = mark
        self.texts = np.concatenate([self.texts, text])
        self.text_size = np.concatenate([self.text_size, summed(self.written[1][ids], summed(in_a + in_b, groups))])

        # Linked pairs: one by one in small groups, by distinct ids in large ones.
        large = np.flatnonzero(in_a * in_b > LARGE)
        times = np.where(np.isin(of_a, large), 0, in_b[of_a])
        mine = np.repeat(np.arange(len(a)), times)
        other = np.arange(len(mine)) - np.repeat(np.cumsum(times) - times, times) + first_b[of_a[mine]]
        keys, counts = [segment[of_a[mine]] << 32 | (a[mine] * SECOND + b[other])], [np.ones(len(mine), np.int64)]
        for g in large.tolist():
            pairs, n = linked(a[first_a[g] : last_a[g]], b[first_b[g] : last_b[g]])
            keys.append(segment[g] << 32 | pairs), counts.append(n)
        key, n = together(np.concatenate(keys), np.concatenate(counts))
        size = np.bincount(key >> 32, minlength=len(segments))
        self.begin = np.concatenate([self.begin, len(self.pairs) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.pairs, self.times = np.concatenate([self.pairs, key & 0xFFFFFFFF]), np.concatenate([self.times, n])
        self.places.update(zip(segments, range(len(self.places), len(self.places) + len(segments))))
        self.bytes += len(raw)

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """For each text its numbers (tokens of either side, groups, links) and digest; and by text, from bounds[i] to
        bounds[i + 1], its distinct pairs in order and how often each is linked."""
        if len(self.places) > HELD_SEGMENTS or self.bytes > HELD_BYTES:
            self.forget()
        raw = [b" " + t.encode() for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        text_starts = np.cumsum([0] + [len(r) for r in raw[:-1]]) if raw else np.zeros(0, np.int64)
        starts = segment_starts(data, text_starts) if parts_at_blanks(self.paths[1]) else text_starts
        offsets = np.append(starts, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        segments = coded.dictionary.to_pylist()
        new = [s for s in segments if s not in self.places]
        for at in range(0, len(new), 20_000):
            self._hold(new[at : at + 20_000])
        place = np.fromiter(map(self.places.__getitem__, segments), np.int64, len(segments))[coded.indices.to_numpy()]
        bounds = np.append(np.searchsorted(starts, text_starts), len(starts))
        numbers = np.add.reduceat(self.numbers[place], bounds[:-1]) if len(texts) else np.zeros((0, 5), np.int64)
        good = (numbers[:, 4] == np.diff(bounds)) & np.array([len(r) > 1 for r in raw], bool)
        numbers = numbers[:, :4] * good[:, None]
        text, at = gather(place, self.text_size, self.texts)
        text, at = memoryview(text), at[bounds].tolist()
        digests = [hashlib.sha256(text[x : y - 1]).hexdigest() if g else "" for g, x, y in zip(good.tolist(), at, at[1:])]
        # The distinct segments of each text, then their pairs.
        of = np.repeat(np.arange(len(texts)), np.diff(bounds))
        seg, n = np.unique((of * len(self.places) + place)[good[of]], return_counts=True)
        of, place = np.divmod(seg, max(1, len(self.places)))
        size = self.size[place]
        ends = np.cumsum(size)
        at = np.repeat(self.begin[place] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        key = (np.repeat(of, size) << 32) | self.pairs[at]  # both vocabularies together need 31 bits
        key, times = together(key, np.repeat(n, size) * self.times[at])
        return numbers, digests, np.searchsorted(key, np.arange(len(texts) + 1) << 32), key & 0xFFFFFFFF, times


ALIGNED = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, a int, b int, docs long"


def aligned(docs: DataFrame, first: str, second: str, block_bytes: int = BLOCK_BYTES, slice_bytes: int = 1 << 20) -> DataFrame:
    """Rows of documents, with their packed pairs in `links`, and rows (block, a, b, docs) of the pairs of each block."""

    def pair_rows(block: int, found: list[np.ndarray]) -> pd.DataFrame:
        pair, n = np.unique(np.concatenate(found), return_counts=True)
        nothing = {c: pd.array([None] * len(pair), "Int64") for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        nothing |= {c: np.full(len(pair), None, object) for c in ("groups_sha256", "links")}
        return pd.DataFrame({"block": np.full(len(pair), block)} | nothing | {"a": pair // SECOND, "b": pair % SECOND, "docs": n})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner, context = Aligner(first, second), TaskContext.get()
        part, number, filled, found = context.partitionId() if context else 0, 0, 0, []
        for frame in frames:
            sizes = frame["text"].str.len().to_numpy()
            cuts = np.unique(np.concatenate([np.flatnonzero(np.diff(np.cumsum(sizes) // slice_bytes, prepend=0)), [0, len(frame)]]))
            for at, to in zip(cuts[:-1], cuts[1:]):
                rows = frame.iloc[at:to]
                numbers, digests, bounds, pairs, times = aligner.align(rows["text"].tolist())
                block = part << 32 | number
                links = [pack(np.diff(pairs[a:b], prepend=0).astype(np.uint32), times[a:b].astype(np.uint32)) for a, b in zip(bounds[:-1], bounds[1:])]
                none = pd.array([None] * len(rows), "Int64")
                columns = {"block": np.full(len(rows), block), "doc_id": pd.arrays.IntegerArray(rows["doc_id"].to_numpy(np.int64), rows["no_id"].to_numpy(bool))}
                columns |= dict(zip(("n_a", "n_b", "n_groups", "n_links"), numbers.T)) | {"groups_sha256": digests, "links": links}
                yield pd.DataFrame(columns | {"a": none, "b": none, "docs": none})
                found.append(pairs)
                filled += int(sizes[at:to].sum())
                if filled >= block_bytes:
                    yield pair_rows(block, found)
                    number, filled, found = number + 1, 0, []
                    give_back()
        if found:
            yield pair_rows(part << 32 | number, found)

    docs = id_text(docs).select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text")  # pandas has no null integers
    return docs.mapInPandas(run, ALIGNED)


SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, n_best_b long, count_sum long, groups_sha256 string"


def align(docs: DataFrame, first: str, second: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows by document, table of pairs): (doc_id, text) to (doc_id, n_a, n_b, n_groups, n_links, n_best, n_best_b,
    count_sum, groups_sha256), and (a, b, count: documents that link them, best_a and best_b: the highest count of either)."""
    both = Scratch(docs.sparkSession).table(aligned(docs, first, second, block_bytes))
    found = both.where("links is null").select("block", "a", "b", "docs")
    counts = found.groupBy("a", "b").agg(F.sum("docs").alias("count"))
    for side in "ab":  # windows over at most a vocabulary's ids
        counts = counts.withColumn(f"best_{side}", F.max("count").over(Window.partitionBy(side)))
    back = found.drop("docs").join(counts, ["a", "b"]).select(F.col("block").alias("of"), (F.col("a").cast("long") * SECOND + F.col("b")).alias("pair"), "count", "best_a", "best_b")

    def score(rows: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("pair")
        pair, count, *best = (known[c].to_numpy() for c in ("pair", "count", "best_a", "best_b"))
        sums = []
        for packed in rows["links"].to_pylist():
            pairs, times = unpack(packed, np.uint32, np.uint32)
            at, times = np.searchsorted(pair, np.cumsum(pairs.astype(np.int64))), times.astype(np.int64)
            sums.append([int((times * count[at]).sum()), *(int(times[count[at] == x[at]].sum()) for x in best)])
        total, best_a, best_b = np.array(sums, np.int64).reshape(-1, 3).T
        out = rows.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        for name, values in (("n_best", best_a), ("n_best_b", best_b), ("count_sum", total)):
            out = out.append_column(name, pa.array(values))
        give_back()
        return out.append_column("groups_sha256", rows["groups_sha256"])

    rows = both.where("links is not null").drop("a", "b", "docs")
    return rows.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(score, SCORED), counts


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = id_text(read(spark, sf_dir, "documents"))
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]
