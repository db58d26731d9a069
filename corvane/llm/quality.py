"""Quality rules: repetition counts and a calibrated logistic regression over hashed word and character n-grams.

The classifier is fitted on a bounded sample of labelled rows (`sample_rows`, those of the least hashed ids) and
calibrated on a held-out quarter of it; counts, scores and thresholds cover every row and every whole text.

Cases: a null text has no words and fails the base rules. A null id stays null. Repeated rows are judged each, alike.
Of several labels or texts of one id the least counts; null labels are ignored. Without labelled rows of both classes the
classifier keeps every document. An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import give_back, id_text, read, slices
from corvane.llm.segments import code_points, mix, segment_hashes

SAMPLE_ROWS = 4096  # labelled rows that the classifier is fitted on, at most
BUCKETS = 1 << 15  # of the hashed features
KEEP_AT = 0.5  # least calibrated probability of good quality
WINDOW = 8
CHAR_GRAMS = (3, 5)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"


class Texts:
    """Words and lines of several texts, as arrays over their code points."""

    def __init__(self, texts: list[str]):
        self.n = len(texts)
        self.codes, bounds = code_points([t + "\n" for t in texts])  # no word or line crosses texts
        self.starts, self.ends = bounds[:-1], bounds[1:]
        self.space = (self.codes == 32) | ((self.codes >= 9) & (self.codes <= 13))
        edge = np.diff(self.space.astype(np.int8), prepend=1)
        self.word_starts = np.flatnonzero(edge == -1)
        self.word_ends = np.flatnonzero(edge == 1)
        self.word_text = np.searchsorted(self.ends, self.word_starts, "right")
        self.word_hash = segment_hashes(self.codes, self.word_starts, self.word_ends)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[self.ends] - sums[self.starts]

    def repeats(self, keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key, whether it is found in its text before, and whether it is found there twice or more."""
        keys = mix(keys + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        later, many = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        later[order[1:]] = same
        many[order[1:]] |= same
        many[order[:-1]] |= same
        return later, many

    def counts(self) -> dict[str, np.ndarray]:
        by_word = np.bincount(self.word_text, minlength=self.n)
        symbol = np.isin(self.codes, np.array([ord(c) for c in SYMBOLS], np.uint32))
        line_ends = np.flatnonzero(self.codes == 10)
        line_starts = np.concatenate([[0], line_ends[:-1] + 1]) if len(line_ends) else line_ends
        worded = np.searchsorted(self.word_starts, line_ends) > np.searchsorted(self.word_starts, line_starts)
        line_starts, line_ends = line_starts[worded], line_ends[worded]
        line_text = np.searchsorted(self.ends, line_starts, "right")
        again, _ = self.repeats(segment_hashes(self.codes, line_starts, line_ends), line_text)
        first = np.arange(max(0, len(self.word_text) - WINDOW + 1))
        first = first[self.word_text[first] == self.word_text[first + WINDOW - 1]]
        _, many = self.repeats(segment_hashes(self.word_hash, first, first + WINDOW), self.word_text[first])
        cover = np.zeros(len(self.word_text) + 1, np.int32)
        cover[first[many]] += 1
        cover[first[many] + WINDOW] -= 1
        covered = np.cumsum(cover[:-1]) > 0
        values = by_word, self.per_text(~self.space), self.per_text(symbol), np.bincount(line_text[again], minlength=self.n), np.bincount(self.word_text[covered], minlength=self.n)
        return {name: v.astype(np.int64) for name, v in zip(COUNTS, values)}

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(bucket, text) of the n-grams of each kind: words, word pairs, and runs of characters within a text."""
        h = self.word_hash
        yield (h % np.uint64(BUCKETS)).astype(np.int32), self.word_text
        pair = self.word_text[1:] == self.word_text[:-1]
        yield (mix(h[:-1] + mix(h[1:] + np.uint64(7)))[pair] % np.uint64(BUCKETS)).astype(np.int32), self.word_text[1:][pair]
        which = np.repeat(np.arange(self.n), self.ends - self.starts)
        for n in CHAR_GRAMS:
            size = max(0, len(self.codes) - n + 1)
            acc = np.zeros(size, np.uint32)
            for k in range(n):
                acc = acc * np.uint32(0x01000193) + self.codes[k : k + size]
            acc = (acc ^ (acc >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(n)
            inside = which[:size] == which[n - 1 :]
            yield ((acc ^ (acc >> np.uint32(13)))[inside] % np.uint32(BUCKETS)).astype(np.int32), which[:size][inside]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of the buckets
    slope: float  # calibration: P(good) = 1 / (1 + exp(-(slope * score + offset)))
    offset: float

    def probabilities(self, texts: Texts) -> np.ndarray:
        score = np.zeros(texts.n)
        for bucket, text in texts.grams():
            total = np.bincount(text, self.weights[bucket], texts.n)
            score += total / np.maximum(1, np.bincount(text, minlength=texts.n))
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.offset, -30, 30)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = {"doc_id": batch.column("doc_id"), "quality": batch.column("quality"), "at": [], "value": []}
        for text in batch.column("text").to_pylist():
            x = np.zeros(BUCKETS)
            for bucket, _ in Texts([text]).grams():
                x += np.bincount(bucket, minlength=BUCKETS) / max(1, len(bucket))
            at = np.flatnonzero(x)
            rows["at"].append(at.astype(np.int16))
            rows["value"].append(x[at].astype(np.float32))
        kinds = [("doc_id", pa.int64()), ("quality", pa.int32()), ("at", pa.list_(pa.int16())), ("value", pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_pydict(rows, pa.schema(kinds))


class Examples:
    """Rows of sparse features by id, in pieces, so that wide copies are only made of one at a time. Takes a table of
    one chunk: taking from several would copy all of them each time."""

    def __init__(self, got: pa.Table, piece: int = 256):
        self.pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (features of each row, features, values)
        order = np.argsort(got["doc_id"].to_numpy())
        for i in range(0, len(order), piece):
            at, value = (got[c].chunk(0).take(pa.array(order[i : i + piece])) for c in ("at", "value"))
            self.pieces.append((np.diff(at.offsets.to_numpy()), at.flatten().to_numpy(), value.flatten().to_numpy()))
        self.labels, self.ids = (got[c].to_numpy()[order] for c in ("quality", "doc_id"))
        self.scale = np.sqrt(sum(np.bincount(at, value**2, BUCKETS) for _, at, value in self.pieces) / max(1, len(order))) + 1e-3
        for i, (sizes, at, value) in enumerate(self.pieces):  # rare features count less than frequent ones
            self.pieces[i] = sizes, at, value / self.scale[at].astype(np.float32)

    def dot(self, w: np.ndarray) -> np.ndarray:
        out, w = [], w.astype(np.float32)
        for sizes, at, value in self.pieces:
            some, sums = sizes > 0, np.zeros(len(sizes))
            if len(at):
                sums[some] = np.add.reduceat(w[at] * value, (np.cumsum(sizes) - sizes)[some], dtype=np.float64)
            out.append(sums)
        return np.concatenate(out)

    def transposed(self, error: np.ndarray) -> np.ndarray:
        out, first = np.zeros(BUCKETS), 0
        for sizes, at, value in self.pieces:
            out += np.bincount(at, np.repeat(error[first : first + len(sizes)].astype(np.float32), sizes) * value, BUCKETS)
            first += len(sizes)
        return out


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, better: Callable[[np.ndarray], float], memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton steps; ends early once `better` (a held-out loss) has risen in three steps. Returns
    where that was least."""
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    (value, slope), best, risen = loss(x), (better(x), x), 0
    for _ in range(steps):
        move, back = -slope, []
        for s, y, r in reversed(pairs):
            back.append(r * (s @ move))
            move = move - back[-1] * y
        if pairs:
            move = move * ((pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]))
        for (s, y, r), k in zip(pairs, reversed(back)):
            move = move + (k - r * (y @ move)) * s
        size, down = (1.0 if pairs else min(1.0, 1 / (np.abs(slope).sum() + 1e-12))), slope @ move
        for _ in range(12):
            new = x + size * move
            new_value, new_slope = loss(new)
            if new_value <= value + 1e-4 * size * down:
                break
            size /= 2
        else:
            break
        s, y = new - x, new_slope - slope
        if s @ y > 1e-12:
            pairs = [*pairs[1 - memory :], (s, y, 1 / (s @ y))]
        x, value, slope = new, new_value, new_slope
        now = better(x)
        best, risen = ((now, x), 0) if now < best[0] else (best, risen + 1)
        if risen == 3:
            break
    return best[1]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, steps: int = 30) -> Model:
    """Fits on at most `sample_rows` labelled documents; the sample's size does not grow with the tables."""
    ids = docs.select("doc_id").where("doc_id is not null").distinct()
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
        .join(ids, "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))  # ids of several rows
    got = rows.mapInArrow(_features, "doc_id long, quality int, at array<smallint>, value array<float>").toArrow()
    if len(set(got["quality"].to_pylist())) < 2:
        return Model(np.zeros(BUCKETS), 0.0, 30.0)
    got = got.combine_chunks()
    examples = Examples(got)
    del got
    give_back()
    y = examples.labels.astype(float)
    # A quarter is held out for calibration and to end the fit.
    deal = mix(examples.ids.view(np.uint64)).argsort(kind="stable").argsort() % 4 == 0
    weigh = lambda mine: np.where(mine, np.where(y > 0, 0.5 / max(1, y[mine].sum()), 0.5 / max(1, (1 - y[mine]).sum())), 0)
    train, aside = weigh(~deal), weigh(deal)
    cost = lambda z, weight: (weight * np.logaddexp(0, np.where(y > 0, -z, z))).sum()
    score = np.zeros(len(y))

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        score[:] = examples.dot(x[:-1]) + x[-1]
        error = train * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y)
        return cost(score, train) + 0.5e-4 * (x[:-1] @ x[:-1]), np.append(examples.transposed(error) + 1e-4 * x[:-1], error.sum())

    # The held-out loss is asked for right after the loss at the same place, so the scores are at hand.
    x = minimise(loss, np.zeros(BUCKETS + 1), steps, lambda x: cost(score, aside))
    w = x[:-1]
    score = examples.dot(w)[deal]
    # Platt's targets keep the two parameters finite where the classes are separable.
    good = y[deal]
    target = np.where(good > 0, (good.sum() + 1) / (good.sum() + 2), 1 / ((1 - good).sum() + 2))
    middle, spread = score.mean(), score.std() + 1e-9
    x, theta = np.stack([(score - middle) / spread, np.ones_like(score)], 1), np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * theta)
        theta -= move * min(1, 1 / (np.abs(move).max() + 1e-9))  # short steps, so that it can't run away
    return Model(w / examples.scale, float(theta[0] / spread), float(theta[1] - theta[0] * middle / spread))


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text, ...) with the counts, base_failed, the calibrated probability and kept added; columns of these names
    are replaced."""
    docs = docs.drop(*COUNTS, "base_failed", "probability", "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = Texts([t or "" for t in batch.column("text").to_pylist()])
            counts, p = texts.counts(), model.probabilities(texts)
            failed = (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])
            new = counts | {"base_failed": failed, "probability": p, "kept": ~failed & (p >= KEEP_AT)}
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, new.values())], [*batch.schema.names, *new])

    schema = T.StructType(list(docs.schema.fields))
    for name in COUNTS:
        schema = schema.add(name, "long")
    for name, kind in (("base_failed", "boolean"), ("probability", "double"), ("kept", "boolean")):
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = id_text(read(spark, sf_dir, "documents"))
    return judge(docs, fit(docs, read(spark, sf_dir, "labels"))).drop("text")
