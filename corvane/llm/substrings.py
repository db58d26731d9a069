"""Exact substring deduplication: every byte of a string of `least` bytes that also starts earlier is found.

Windows of `least` bytes that are equal have the same least hashed GRAM-byte string inside, so each run of windows with
one such anchor goes to the bucket of the anchor, and all copies of a window meet there. Two exchanges of packed rows
(see blocks.py) do this: first each block asks which of its anchors are found elsewhere, then it sends the text around
those only: each distinct run once a block, with the place where it stands first there; its other places stay with the
block. A bucket merges equal runs and builds suffix arrays over all distinct ones, PART_BYTES at a time. Threshold-bounded
interval expansion on the Burrows-Wheeler transform (suffix.py) gives the windows with a common prefix of `least` bytes;
in each such interval the earliest window stays and all others go, in whichever run or copy they stand. Anchors with
over HOT runs are divided further by the least second hash in the window.

Cases: a null text is empty; texts under `least` bytes hold no window. Order is by id (null last), then by place; rows
that share an id count as one document there, so none of several identical rows takes bytes from another. An empty
table gives an empty one. Other columns are carried in `rest`. Strings are judged on the input, not on what is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.blocks import answer, ask, blocked, pack, packed_table, settle, unpack
from corvane.llm.common import SLICE_BYTES, id_text, read
from corvane.llm.segments import mix
from corvane.llm.suffix import shared_groups

LEAST = 100
GRAM = 20
HOT = 4096
PART_BYTES = 1 << 20
NO_ID = np.iinfo(np.int64).max


@dataclass
class Runs:
    """Runs of windows with one anchor in consecutive rows of a block."""

    raw: bytes
    row: np.ndarray  # the row in the block
    start: np.ndarray  # in the row's bytes
    at: np.ndarray  # in raw
    count: np.ndarray  # of windows
    anchor: np.ndarray
    twice: np.ndarray  # whether the anchor stands there more than once

    def where(self, chosen: np.ndarray) -> Runs:
        return Runs(self.raw, *(c[chosen] for c in (self.row, self.start, self.at, self.count, self.anchor, self.twice)))

    def texts(self, least: int) -> list[bytes]:
        return [self.raw[a:b] for a, b in zip(self.at.tolist(), (self.at + self.count + least - 1).tolist())]

    def divided(self, least: int) -> Runs:
        """The runs cut where the least second hash in the window changes, which is in the key then."""
        raw = b"".join(self.texts(least))
        size = self.count + least - 1
        begin = np.cumsum(size) - size
        second = _least_of(mix(_gram_hashes(np.frombuffer(raw, np.uint8)) ^ np.uint64(0x5851F42D4C957F2D)), least - GRAM + 1)
        of = np.repeat(np.arange(len(size)), self.count)
        at = np.arange(len(of)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        key = mix(self.anchor[of] ^ second[begin[of] + at])
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (of[1:] != of[:-1])))
        run, at = of[first], at[first]
        return Runs(raw, self.row[run], self.start[run] + at, begin[run] + at, np.diff(np.append(first, len(of))), key[first], self.twice[run])


def _least_of(values: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """The least of each `width` consecutive values, by doubling."""
    have, acc = 1, values
    while have * 2 <= width:
        acc = pick(acc[:-have], acc[have:])
        have *= 2
    return pick(acc[: len(values) - width + 1], acc[width - have : len(values) - have + 1]) if width > have else acc


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    factors = [np.uint64(pow(0x9E3779B97F4A7C15, 1 << k, 1 << 64)) for k in range(5)]
    h = {1: data.astype(np.uint64) + np.uint64(1)}
    for k in range(4):
        n = 1 << k
        h[2 * n] = h[n][:-n] * factors[k] + h[n][n:]
    return mix(h[16][: len(data) - GRAM + 1] * factors[2] + h[4][16:])


def runs_of(rows: pa.Table, least: int) -> Iterator[Runs]:
    """The runs of a block, slice by slice."""
    texts = rows["text"].cast(pa.binary()).to_pylist()
    width, first = least - GRAM + 1, 0
    while first < len(texts):
        last, held = first, 0
        while last < len(texts) and (last == first or held + len(texts[last]) <= SLICE_BYTES):
            held += len(texts[last])
            last += 1
        raw = b"".join(texts[first:last])
        bounds = np.cumsum([0] + [len(t) for t in texts[first:last]])
        base, first = first, last
        if len(raw) < least:
            continue
        hashes = _gram_hashes(np.frombuffer(raw, np.uint8))
        anchor = _least_of(hashes, width)
        # Places that are the least of some window; between two equal ones in reach of a window no other lies.
        padded = np.concatenate([np.zeros(width - 1, np.uint64), anchor, np.zeros(width - 1, np.uint64)])
        place = np.flatnonzero(_least_of(padded, width, np.maximum) == hashes)
        same = (hashes[place[1:]] == hashes[place[:-1]]) & (place[1:] - place[:-1] <= width)  # at width no window holds both, but one run does
        tie = place[:-1][same]
        row = np.searchsorted(bounds, np.arange(len(anchor)), "right") - 1
        inside = np.arange(len(anchor)) + least <= bounds[row + 1]
        cut = np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))
        at = np.flatnonzero(cut & inside)
        ends = np.append(np.flatnonzero(cut), len(anchor))
        end = np.minimum(ends[np.searchsorted(ends, at, "right")], bounds[row[at] + 1] - least + 1)
        twice = np.searchsorted(tie, end + width - 1) > np.searchsorted(tie, at)
        yield Runs(raw, row[at] + base, at - bounds[row[at]], at, end - at, anchor[at], twice)


def _by_bucket(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the values by bucket, and where each bucket begins in it."""
    bucket = (values % np.uint64(n)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def whole_characters(text: bytes, starts: list[int], ends: list[int]) -> str:
    """The text without the characters that lie in the spans with all their bytes."""
    kept, at = [], 0
    for a, b in zip(starts, ends):
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b < len(text) and b > a and text[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            kept.append(text[at:a])
            at = b
    return b"".join([*kept, text[at:]]).decode("utf-8", "replace")


def repeated_spans(docs: DataFrame, least: int = LEAST, with_text: bool = False) -> DataFrame:
    """(doc_id, text, ...) to (doc_id, n_bytes long, kept binary, spans array<struct<start,length>>, rest struct).

    with_text: also the column text, the input without characters that spans cover as a whole."""
    if least < GRAM:
        raise ValueError(f"strings of {GRAM} bytes at least")
    base, n = blocked(docs)

    def anchors(runs: list[Runs]) -> tuple[np.ndarray, np.ndarray]:
        """A block's distinct anchors in order, and what is known of each: found there once, or more."""
        values, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *(r.anchor for r in runs)]), return_counts=True)
        again = np.zeros(len(values), bool)
        for r in runs:
            again[np.searchsorted(values, r.anchor[r.twice])] = True
        return values, np.where(again, np.maximum(times, 2), times)

    def which(rows: pa.Table) -> Iterator[tuple[int, bytes]]:
        values, times = anchors(list(runs_of(rows, least)))
        order, begins = _by_bucket(values, n)
        for b in range(n):
            mine = order[begins[b] : begins[b + 1]]
            if len(mine):
                yield b, pack(values[mine], np.minimum(times[mine], 65535).astype(np.uint16))

    def counted(questions: list[bytes]) -> list[bytes]:
        parts = [unpack(q, np.uint64, np.uint16) for q in questions]
        distinct, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([p[1] for p in parts]).astype(np.float64))[inverse]
        level, ends = ((total > 1).astype(np.uint8) + (total > HOT)), np.cumsum([0] + [len(p[0]) for p in parts])
        return [pack(level[a:b]) for a, b in zip(ends, ends[1:])]

    def send(rows: pa.Table, levels: dict[int, bytes]) -> pa.Table:
        runs = list(runs_of(rows, least))
        values, _ = anchors(runs)
        order, begins = _by_bucket(values, n)
        level = np.zeros(len(values), np.uint8)
        for b, data in levels.items():
            level[order[begins[b] : begins[b + 1]]] = unpack(data, np.uint8)[0]
        seen: dict[bytes, int] = {}
        keys, of, row, start = [], [], [], []
        while runs:
            r = runs.pop(0)
            at = level[np.searchsorted(values, r.anchor)]
            for part in (r.where(at == 1), r.where(at == 2).divided(least) if (at == 2).any() else None):
                if part is not None and len(part.row):
                    known = len(seen)
                    mine = np.array([seen.setdefault(t, len(seen)) for t in part.texts(least)])
                    new = np.flatnonzero(mine >= known)
                    keys.append(part.anchor[new[np.unique(mine[new], return_index=True)[1]]])
                    of.append(mine), row.append(part.row), start.append(part.start)
        if not seen:
            return packed_table([])
        keys, of, row, start = map(np.concatenate, (keys, of, row, start))
        texts, block = list(seen), rows["block"][0].as_py()
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        ids = rows["doc_id"].fill_null(NO_ID).to_numpy()
        places = np.lexsort((start, ids[row], of))
        first = places[np.append(True, of[places][1:] != of[places][:-1])]
        leads = (ids[row] == ids[row[first]][of]) & (start == start[first][of])
        result = [(n + block, block, pack(size.astype(np.uint32), of.astype(np.uint32), row.astype(np.uint32), start.astype(np.uint32), leads))]
        order, begins = _by_bucket(keys, n)
        for b in range(n):
            mine = order[begins[b] : begins[b + 1]]
            if len(mine):
                anchor = (keys[mine] >> np.uint64(32)).astype(np.uint32)
                result.append((b, block, pack(anchor, size[mine].astype(np.uint32), mine.astype(np.uint32), ids[row[first[mine]]], start[first[mine]].astype(np.uint32), b"".join(texts[i] for i in mine.tolist()))))
        return packed_table(result)

    def judged(questions: list[bytes]) -> list[bytes]:
        return _judge(questions, least)

    def result(rows: pa.Table, answers: dict[int, bytes]) -> pa.Table:
        own = answers.pop(n + rows["block"][0].as_py(), None)
        row = start = length = np.zeros(0, np.int64)
        if own is not None:
            size, of, row, start, leads = (x.astype(np.int64) for x in unpack(own, np.uint32, np.uint32, np.uint32, np.uint32, bool))
            parts = [unpack(a, np.uint32, np.uint32, np.uint32) for a in answers.values()]
            run, offset, part = (np.concatenate([np.zeros(0, np.uint32), *(p[k] for p in parts)]).astype(np.int64) for k in range(3))
            by = np.argsort(run, kind="stable")
            run, offset, part = run[by], offset[by], part[by]
            # What stands first here loses what the bucket says, what stands later here loses all.
            mine, other = np.flatnonzero(leads), np.flatnonzero(leads == 0)
            lo, hi = np.searchsorted(run, of[mine]), np.searchsorted(run, of[mine], "right")
            at = np.repeat(mine, hi - lo)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
            row, start, length = np.append(row[at], row[other]), np.append(start[at] + offset[nth], start[other]), np.append(part[nth], size[of[other]])
        order = np.lexsort((start, row))
        row, start, end = row[order], start[order], (start + length)[order]
        kept, spans, left = [], [], []
        begins = np.searchsorted(row, np.arange(len(rows) + 1))
        for i, text in enumerate(rows["text"].cast(pa.binary()).to_pylist()):
            mine = slice(begins[i], begins[i + 1])
            a, b = start[mine], np.maximum.accumulate(end[mine]) if begins[i + 1] > begins[i] else end[mine]
            fresh = np.append(True, a[1:] > b[:-1]) if len(a) else np.zeros(0, bool)
            a, b = a[fresh], b[np.append(fresh[1:], True)] if len(a) else b
            spans.append([{"start": int(x), "length": int(y - x)} for x, y in zip(a, b)])
            cuts = [0, *(z for pair in zip(a.tolist(), b.tolist()) for z in pair), len(text)]
            kept.append(b"".join(text[x:y] for x, y in zip(cuts[::2], cuts[1::2])))
            left.append(whole_characters(text, a.tolist(), b.tolist()) if with_text else None)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        sizes = pa.array([len(t) for t in rows["text"].cast(pa.binary()).to_pylist()], pa.int64())
        columns = {"doc_id": rows["doc_id"], "n_bytes": sizes, "kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, kind), "rest": rows["rest"]}
        return pa.table(columns | ({"text": pa.array(left, pa.string())} if with_text else {}))

    levels = answer(ask(base, which), counted)
    runs = settle(base, levels, send, "bucket int, block int, data binary")
    schema = T.StructType.fromDDL("doc_id long, n_bytes long, kept binary, spans array<struct<start: long, length: long>>")
    schema = schema.add("rest", base.schema["rest"].dataType)
    return settle(base, answer(runs, judged, n), result, schema.add("text", "string") if with_text else schema)


def _judge(questions: list[bytes], least: int) -> list[bytes]:
    """For each block's runs, the stretches (run, offset, length) whose strings start earlier elsewhere."""
    known: dict[bytes, int] = {}
    anchors, of, numbers, ids, starts, source = [], [], [], [], [], []
    for k, q in enumerate(questions):
        anchor, size, number, doc, start, text = unpack(q, np.uint32, np.uint32, np.uint32, np.int64, np.uint32, bytes)
        ends = np.cumsum(size).tolist()
        before = len(known)
        mine = np.array([known.setdefault(text[a:b], len(known)) for a, b in zip([0, *ends], ends)])
        anchors.append(anchor[mine >= before])  # a block sends a run once
        of.append(mine), numbers.append(number), ids.append(doc), starts.append(start.astype(np.int64)), source.append(np.full(len(mine), k))
    anchors, of, numbers, ids, starts, source = map(np.concatenate, (anchors, of, numbers, ids, starts, source))
    texts, sizes = list(known), np.fromiter(map(len, known), np.int64, len(known))
    del known
    order = np.lexsort((starts, ids, of))
    first = order[np.append(True, of[order][1:] != of[order][:-1])]  # of each run: where it stands first
    first_id, first_start = ids[first], starts[first]
    leads = (ids == first_id[of]) & (starts == first_start[of])
    # Runs with different anchors share no window, so a part holds all that may match.
    parts = 1 + int(sizes.sum()) // PART_BYTES
    part = anchors % np.uint32(parts)
    by_part = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[by_part], np.arange(parts + 1))
    late = [_late_stretches([texts[i] for i in mine.tolist()], first_id[mine], first_start[mine], least, mine) for a, b in zip(cuts, cuts[1:]) if len(mine := by_part[a:b])]
    run, offset, length = (np.concatenate([x[k] for x in late]) for k in range(3))
    by = np.argsort(run, kind="stable")
    run, offset, length = run[by], offset[by], length[by]
    # A run that does not lead stands later with every window; a leading one where an interval has an earlier window.
    mine, other = np.flatnonzero(leads), np.flatnonzero(~leads)
    lo, hi = np.searchsorted(run, of[mine]), np.searchsorted(run, of[mine], "right")
    entry = np.repeat(mine, hi - lo)
    nth = np.arange(len(entry)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
    entry, offset, length = np.append(entry, other), np.append(offset[nth], np.zeros(len(other), np.int64)), np.append(length[nth], sizes[of[other]])
    order = np.argsort(source[entry], kind="stable")
    entry, offset, length = entry[order], offset[order], length[order]
    begins = np.searchsorted(source[entry], np.arange(len(questions) + 1))
    return [pack(numbers[entry[a:b]], offset[a:b].astype(np.uint32), length[a:b].astype(np.uint32)) for a, b in zip(begins, begins[1:])]


def _late_stretches(texts: list[bytes], doc: np.ndarray, start: np.ndarray, least: int, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name of the run, offset, length) of the stretches of distinct runs whose windows have an equal one that starts
    earlier, by (doc, start), in another of the runs or in the same."""
    joined, size = b"\0".join(texts), np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size + 1) - size - 1
    symbols = np.frombuffer(joined + b"\0\0", np.uint8).astype(np.uint16) + 2
    symbols[begin + size] = 1
    symbols[-1] = 0
    places, group = shared_groups(symbols, least)
    several = np.bincount(group) > 1
    places, group = places[several[group]], group[several[group]]
    run = np.searchsorted(begin, places, "right") - 1
    offset = places - begin[run]
    window = offset + least <= size[run]
    group, run, offset = group[window], run[window], offset[window]
    place = start[run] + offset
    order = np.lexsort((place, doc[run], group))
    group, run, offset, place = group[order], run[order], offset[order], place[order]
    head = np.maximum.accumulate(np.where(np.append(True, group[1:] != group[:-1]), np.arange(len(group)), 0))
    late = (doc[run] != doc[run[head]]) | (place != place[head])
    run, offset = run[late], offset[late]
    order = np.lexsort((offset, run))
    run, offset = run[order], offset[order]
    new = np.flatnonzero(np.append(True, (run[1:] != run[:-1]) | (offset[1:] > offset[:-1] + least))) if len(run) else np.zeros(0, np.int64)
    length = offset[np.append(new[1:], len(run)) - 1] + least - offset[new] if len(run) else np.zeros(0, np.int64)
    return name[run[new]], offset[new], length


def op8_substrings(spark, sf_dir: str) -> DataFrame:
    spans = repeated_spans(id_text(read(spark, sf_dir, "documents")))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["length"])
    return spans.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
