"""Cross-entropy difference: how much more a target model than a background model expects each document.

Two bigram models are counted over all documents, the target's over those that are labelled good and not toxic, the
background's over all. They share one vocabulary, every word of the corpus, and count every pair of neighbouring words;
they are matched: the background's counts are scaled to the target's tokens before both are smoothed alike. With Q(w)
the word's share of all tokens, P(w) = (1 - SHARE) * c(w) / N + SHARE * Q(w), and
P(w | v) = (c(v, w) + STRENGTH * P(w)) / (c(v) + STRENGTH).
A document's losses are the means of -log P over its tokens (the first has no v), its score the mean of the differences,
target less background: the lower, the more like the target.

Counts travel as packed rows between blocks of texts and buckets of keys (blocks.py), so a frequent word or pair costs
one entry a block, and nothing but two sums comes to the driver. Words are white-space runs in lower case; words and
pairs are told apart by 64-bit hashes.

Cases: a null or blank text has no tokens, and null losses and score. Null ids have no label. Repeated rows count and
are scored each. An id that any label row calls good and none toxic is in the target. Without targets all scores are
0. An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.blocks import PACKED, answer, blocked, pack, packed_table, rows_of, settle, unpack
from corvane.llm.common import give_back, id_text, read, slices
from corvane.llm.quality import Texts
from corvane.llm.segments import mix

SHARE = 0.2
STRENGTH = 4.0
WORD = r"[^\x20\x09-\x0D]+"


def tokens_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a block in order, and the row of each."""
    words, of, first = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for batch in slices(rows.select(["text"]).to_batches()):
        texts = Texts([t.lower() for t in batch.column("text").to_pylist()])
        words.append(texts.word_hash)
        of.append(texts.word_text + first)
        first += texts.n
    return np.concatenate(words), np.concatenate(of)


class Keys:
    """A block's tokens by the distinct keys of its words and pairs, and the keys, ascending, by bucket."""

    def __init__(self, rows: pa.Table, buckets: int):
        words, self.of = tokens_of(rows)
        self.after = np.flatnonzero(self.of[1:] == self.of[:-1]) + 1  # tokens that follow another of their text
        pairs = mix(mix(words[self.after - 1]) + words[self.after])
        self.keys, inverse = np.unique(np.concatenate([mix(words), pairs]), return_inverse=True)
        self.word, self.pair = inverse[: len(words)], inverse[len(words) :]
        bucket = ((self.keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        ends = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64)).tolist()
        self.places = lambda b: slice(ends[b], ends[b + 1])

    def count(self, weight: np.ndarray | None = None) -> np.ndarray:
        """Of each key, the number of its tokens, or of those with the weight 1."""
        found = np.bincount(self.word, weight, len(self.keys))
        return (found + np.bincount(self.pair, None if weight is None else weight[self.after], len(self.keys))).astype(np.uint32)


def steps(keys: np.ndarray) -> bytes:
    """Ascending keys as their differences, byte by byte of all: the high ones are small and pack well."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def from_steps(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def _asked(base: DataFrame, targets: DataFrame, n: int) -> DataFrame:
    """Each block's counts by key, packed by bucket: (key, in the target, in all)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return packed_table([])
        rows, block = rows_of(left), left["block"][0].as_py()
        good = pc.is_in(rows["doc_id"], right["doc_id"].combine_chunks(), skip_nulls=True).to_numpy(zero_copy_only=False)
        found = Keys(rows, n)
        target, total = found.count(good[found.of]), found.count()
        parts = ((b, found.places(b)) for b in range(n))
        out = packed_table([(b, block, pack(steps(found.keys[i]), target[i], total[i])) for b, i in parts if i.start < i.stop])
        give_back()
        return out

    return base.groupBy("block").cogroup(targets.groupBy("block")).applyInArrow(run, PACKED)


def _reply(questions: list[bytes]) -> list[bytes]:
    """The counts over all blocks, for each question in the order of its keys."""
    parts = [unpack(q, bytes, np.uint32, np.uint32) for q in questions]
    asked = [from_steps(p[0]) for p in parts]
    keys, inverse = np.unique(np.concatenate(asked), return_inverse=True)
    target, total = (np.bincount(inverse, np.concatenate([p[k] for p in parts]), len(keys)).astype(np.uint64) for k in (1, 2))
    ends = np.cumsum([0] + [len(k) for k in asked]).tolist()
    return [pack(target[inverse[a:b]], total[inverse[a:b]]) for a, b in zip(ends, ends[1:])]


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text) and (doc_id, quality, toxic) to (doc_id, n_tokens long, loss_target, loss_background, score)."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("good"), F.coalesce(F.max("toxic"), F.lit(0)).alias("toxic"))
    targets = marks.where("good = 1 and toxic = 0").select("doc_id")
    sizes = docs.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(WORD))).alias("n"))
    marked = sizes.join(targets.withColumn("target", F.lit(1)), "doc_id", "left")
    every, tokens = (x or 0 for x in marked.agg(F.sum("n"), F.sum(F.expr("n * target"))).head())
    by = F.xxhash64(F.coalesce("doc_id", F.xxhash64("text")))
    base, n = blocked(docs.select("doc_id", "text"), by=by)
    targets = targets.select(F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("block"), "doc_id").repartition(n, "block")

    def use(rows: pa.Table, replies: dict[int, bytes]) -> pa.Table:
        found = Keys(rows, n)
        counts = np.zeros((2, len(found.keys)))
        for b, data in replies.items():
            counts[:, found.places(b)] = unpack(data, np.uint64, np.uint64)
        losses, share = [], counts[1, found.word] / max(1, every)
        for scale, count in zip((1.0, tokens / max(1, every)), counts):
            count = count * scale
            c = count[found.word]
            p = (1 - SHARE) * c / tokens + SHARE * share if tokens else share.copy()
            p[found.after] = (count[found.pair] + STRENGTH * p[found.after]) / (c[found.after - 1] + STRENGTH)
            losses.append(-np.log(p))
        size = np.bincount(found.of, minlength=len(rows))
        mean = lambda x: pa.array(np.bincount(found.of, x, len(rows)) / np.maximum(size, 1), mask=size == 0)
        return pa.table({"doc_id": rows["doc_id"], "n_tokens": pa.array(size, pa.int64()), "loss_target": mean(losses[0]), "loss_background": mean(losses[1]), "score": mean(losses[0] - losses[1])})

    schema = "doc_id long, n_tokens long, loss_target double, loss_background double, score double"
    return settle(base, answer(_asked(base, targets, n), _reply), use, schema)


def op1_scoring(spark, sf_dir: str) -> DataFrame:
    return score(id_text(read(spark, sf_dir, "documents")), read(spark, sf_dir, "labels"))
